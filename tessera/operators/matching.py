"""Fuzzy matching of names: likeness joins with blocking, grouping of candidates, ranked merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import artist_keys, credit_names, name_key, name_keys
from tessera.functions.text import bigrams, dice
from tessera.functions.titles import variant_of
from tessera.operators.stash import Stash


def contains(a: Column, b: Column) -> Column:
    """One in the other, the shorter having at least 6 characters and 60 % of the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) >= 6) & (F.length(short) >= 0.6 * F.length(long)) & F.contains(long, short)


def dice_pairs(rows: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """Pairs of ids (a < b) whose names are alike by at least `least`, with their likeness. Names meet on shared character pairs
    of a prefix: of a name's rarest distinct pairs as many as a partner must share one of; equal names are one node first."""
    keyed = rows.select(F.col(id_col).alias("id"), name_key(F.col(text_col)).alias("key")).filter("key <> ''")
    keys = keyed.select("key").distinct()
    # each copy of a pair counts for itself: "ab" twice is ("ab", 1) and ("ab", 2)
    grams = bigrams(F.col("key"))
    numbered = keys.select("key", F.posexplode(grams).alias("i", "g")).select("key", "g", F.row_number().over(Window.partitionBy("key", "g").orderBy("i")).alias("copy"))
    counts = numbered.groupBy("g", "copy").agg(F.count("*").alias("n"))
    ranked = numbered.join(counts, ["g", "copy"]).select("key", "g", "copy", F.row_number().over(Window.partitionBy("key").orderBy("n", "g", "copy")).alias("r"), F.count("*").over(Window.partitionBy("key")).alias("size"))
    # 2 * shared / (m + n) >= t needs shared >= t * m / (2 - t) in a name of m pairs
    prefix = ranked.filter(F.col("r") <= F.col("size") - F.ceil(least * F.col("size") / (2 - least) - 1e-9) + 1)
    x, y = prefix.select("g", "copy", F.col("key").alias("x"), F.col("size").alias("m")), prefix.select("g", "copy", F.col("key").alias("y"), F.col("size").alias("n"))
    near = x.join(y, ["g", "copy"]).filter((F.col("x") < F.col("y")) & (2 * F.least("m", "n") >= least * (F.col("m") + F.col("n")))).select("x", "y").distinct()
    like = near.select("x", "y", dice(F.col("x"), F.col("y")).alias("likeness")).filter(F.col("likeness") >= least)
    same = keys.select(F.col("key").alias("x"), F.col("key").alias("y"), F.lit(1.0).alias("likeness"))
    links = like.union(same)
    a, b = keyed.select(F.col("id").alias("a"), F.col("key").alias("x")), keyed.select(F.col("id").alias("b"), F.col("key").alias("y"))
    found = links.join(a, "x").join(b, "y").filter("(x = y AND a < b) OR x <> y")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def grouped_candidates(found: DataFrame, most: int = 5) -> DataFrame:
    """Hits (query, pos, artist, title, date, releases, score, variant, match) as songs: one group for each artist and title
    key; its main hit is the earliest that is no variant; groups with variants only count 0.85; the `most` best of a query."""
    keyed = found.withColumn("artist_key", name_key(F.col("artist"))).withColumn("title_key", name_key(F.regexp_replace("title", r"\s*[(\[][^()\[\]]*[)\]]", "")))
    order = F.struct(F.col("variant").cast("int"), F.coalesce("date", F.lit("9999")), -F.col("releases"), -F.col("score"), F.col("pos"))
    groups = keyed.groupBy("query", "artist_key", "title_key").agg(
        F.min_by(F.struct("artist", "title", "date", "pos"), order).alias("main"), F.max("score").alias("score"), F.max("match").alias("best"), F.min(F.col("variant").cast("int")).alias("only_variants")
    )
    match = F.floor(F.col("best") * F.when(F.col("only_variants") == 1, 0.85).otherwise(1.0) * 1000 + 0.5) / 1000
    ranked = groups.select("query", "main.*", "artist_key", "score", match.alias("match"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("match"), F.desc("score"), "pos"))
    return ranked.withColumn("place", place).filter(F.col("place") <= most)


def ambiguous(candidates: DataFrame) -> DataFrame:
    """Queries whose two best candidates score almost the same and are of different artists."""
    one = candidates.filter("place <= 2").groupBy("query").agg(
        F.max(F.when(F.col("place") == 1, F.col("match"))).alias("m1"), F.max(F.when(F.col("place") == 2, F.col("match"))).alias("m2"), F.countDistinct("artist_key").alias("artists")
    )
    return one.select("query", F.coalesce((F.col("m1") - F.col("m2") < 0.05) & (F.col("artists") > 1), F.lit(False)).alias("ambiguous"))


def likest(ours: Column, theirs: Column) -> Column:
    """The largest likeness of any name of one list with any of the other; keys."""
    return F.array_max(F.flatten(F.transform(ours, lambda x: F.transform(theirs, lambda y: dice(x, y)))))


def _blocks(key: Column, loose: Column) -> Column:
    """What two keys share if they are equal or, both loose, one contains the other: the key, or any six characters in a row."""
    n = F.length(key)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n - 5, F.lit(1))), lambda i: F.substring(key, i, F.lit(6)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), key)), F.when(loose & (n >= 6), parts).otherwise(F.array().cast("array<string>"))))


def _like_keys(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Distinct pairs (key, other) of ours (key, loose) and theirs (key) that are equal or, where ours is loose, one in the other."""
    left = ours.distinct().select("key", "loose", F.explode(_blocks(F.col("key"), F.col("loose"))).alias("block"))
    right = theirs.distinct().select(F.col("key").alias("other"), F.explode(_blocks(F.col("key"), F.lit(True))).alias("block"))
    like = (F.col("key") == F.col("other")) | (F.col("loose") & contains(F.col("key"), F.col("other")))
    return left.join(right, "block").filter(like).select("key", "loose", "other").distinct()


def names_version(title: Column) -> Column:
    """Whether a bracket or what follows a dash names one version of a song."""
    parts = F.concat(F.regexp_extract_all(title, F.lit(r"[(\[]([^()\[\]]*)[)\]]"), 1), F.slice(F.split(title, r"\s+[-–—]\s+"), 2, F.length(title)))
    return F.exists(parts, lambda p: variant_of(p).isNotNull())


def _credited(songs: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct (song, end) of songs (song, artist, title) and ends (end, artist, title, title_aliases, artist_aliases) that match."""
    listed = lambda *cs: F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in cs))
    flat = lambda keys, loose: F.transform(keys, lambda k: F.struct(k.alias("key"), loose.alias("loose")))
    own = ends.select("end", name_keys(listed(F.array("title"), F.col("title_aliases"))).alias("titles"), artist_keys(listed(credit_names(F.col("artist")), F.col("artist_aliases"))).alias("each"), artist_keys(F.array("artist")).alias("whole"))
    bare = F.trim(F.regexp_replace("title", r"\s*[(\[][^()\[\]]*[)\]]\s*", " "))
    asked = songs.filter("trim(artist) <> '' AND trim(title) <> ''").select("song", names_version(F.col("title")).alias("version"), name_keys(F.array("title")).alias("t"), name_keys(F.array(bare)).alias("b"), artist_keys(credit_names(F.col("artist"))).alias("each"), artist_keys(F.array("artist")).alias("whole"))
    ours_t = asked.select("song", F.explode(F.when(F.col("version"), flat(F.col("t"), F.lit(False))).otherwise(flat(F.array_union("t", "b"), F.lit(True)))).alias("x")).select("song", "x.*")
    ours_a = asked.select("song", F.explode(F.array_union(flat(F.col("each"), F.lit(False)), flat(F.col("whole"), F.lit(True)))).alias("x")).select("song", "x.*")
    theirs_t = own.select("end", F.explode("titles").alias("key"))
    theirs_a = own.select("end", F.explode(F.array_union(flat(F.col("each"), F.lit(False)), flat(F.col("whole"), F.lit(True)))).alias("x")).select("end", "x.*")
    pair = {"on": ["key", "loose"]}
    titles = ours_t.join(_like_keys(ours_t.select("key", "loose"), theirs_t.select("key")), **pair).select("song", F.col("other").alias("title"))
    whole = _like_keys(ours_a.filter("loose").select("key", "loose"), theirs_a.filter("loose").select("key")).select("key", F.col("other").alias("credit"))
    equal = ours_a.select("song", F.col("key").alias("credit"))
    artists = equal.union(ours_a.filter("loose").join(whole, "key").select("song", "credit")).distinct()
    right = theirs_t.withColumnRenamed("key", "title").join(theirs_a.select("end", F.col("key").alias("credit"), "loose").distinct(), "end")
    # a part of a credit meets equal names only; a whole one also what it holds
    exact = artists.join(equal.distinct().withColumn("same", F.lit(True)), ["song", "credit"], "left")
    found = titles.distinct().join(exact, "song").join(right, ["title", "credit"]).filter(F.col("loose") | F.col("same"))
    return found.select("song", "end").distinct()


def _classed(rows: DataFrame, ids: list[str], texts: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows (ids, texts) as members (ids, class) and classes (class, texts): one class for all ids with the same texts. Where ids have
    several rows, each id is a class with all of its rows. An id is a member once."""
    real = rows.filter(F.forall(F.array(*(F.col(c).isNotNull() for c in ids)), lambda x: x))
    several = real.groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    marked = real.withColumn(name, F.unhex(F.md5(F.to_json(F.struct(*(ids if several else texts))))))
    members = marked.select(*ids, name)
    return (members.distinct() if several else members), marked.select(name, *texts).distinct()


def catalog_matches(songs: DataFrame, catalog: DataFrame) -> DataFrame:
    """songs (song, artist, title); catalog (entry, relation, artist, title, aliases: artist and title lists, and the same of its source with the prefix source_).
    One row (song, entry, side) for each song that is an entry's own (forward) or its source (backward): a title and an artist match.

    Titles match if their keys are equal or, with or without its brackets, the song's is in the entry's or holds it; one that names a version matches
    nothing but the same. Artists match if any name of one credit is one of the other, or if one whole credit holds the other. Songs of one title
    and credit are one while they are compared, and entries' sides too: distinct keys first, and only those that share six characters. Songs and entries are
    put in their places last, so that each pair, of which there may be very many, is made once and moves nowhere."""
    texts = ["artist", "title", "title_aliases", "artist_aliases"]
    side = lambda name, pre: catalog.select("entry", F.lit(name).alias("side"), *(F.col(pre + c).alias(c) for c in texts))
    ours, asked = _classed(songs, ["song"], ["artist", "title"], "own")
    theirs, ends = _classed(side("forward", "").union(side("backward", "source_")), ["entry", "side"], texts, "end")
    met = Stash(songs.sparkSession).put(_credited(asked.withColumnRenamed("own", "song"), ends).withColumnRenamed("song", "own"), "met")
    return met.join(ours, "own").select("song", "end").join(theirs, "end").select("song", "entry", "side")


def first_year(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """song and the year that the first entry with it gives, its own side first."""
    years = matches.join(catalog.select("entry", "year", "source_year"), "entry").withColumn("found", F.when(F.col("side") == "forward", F.col("year")).otherwise(F.col("source_year")))
    return years.groupBy("song").agg(F.min_by("found", F.struct("entry", (F.col("side") == "backward").cast("int").alias("s"))).alias("year"))
