"""Titles of uploads and what people type, read as songs.

A title is taken apart into rows (its brackets and what stands between; then its segments), each row gets a class, and the rows of a title come
together again. Possible readings of it (the channel's own track, segments in either order, a quoted title, the whole) are then a list in order of precedence,
of which the first that applies is taken. Each step is written, so that no step's expressions are repeated inside of the next one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions import titles as T
from tessera.functions.text import dice
from tessera.operators.stash import Stash

# Marks around a title, in order of precedence; signs between artist and title, in titles and when typed; words that no artist is.
QUOTES = (("「", "」"), ("『", "』"), ("《", "》"), ("〈", "〉"), ("【", "】"))
BREAK, TOPIC_BREAK, COLON = r"\s+[-–—|~]\s+", r"\s+[-–—]\s+", r"^(.+?): (.*)$"
TYPED_BREAKS = (" – ", " — ", " - ", " | ")
NO_ARTIST = ("me", "you", "us", "them", "her", "him", "it", "myself", "yourself", "the", "a")
# What each sign of a reading adds to the confidence, and how like names must be.
BASE, OFFICIAL, TOPIC, SPLIT, QUOTED, OWN, SWAPPED, ALIKE = 0.2, 0.05, 0.6, 0.3, 0.25, 0.25, 0.2, 0.85
TYPED = {"typed-split": 0.8, "typed-by": 0.75, "typed-quoted": 0.8, "bare": 0.2}

_NONE = "CAST(array() AS array<string>)"
_NO_NAMES = "CAST(NULL AS string)"


def _first(parts: Column, value) -> Column:
    """The first value of a list's parts that is not null."""
    return F.get(F.filter(F.transform(parts, value), lambda v: v.isNotNull()), 0)


def without_brackets(df: DataFrame) -> DataFrame:
    """df (id, text, ...) with the text without those brackets that only describe the upload, name a guest, a producer or a version, or speak against it;
    said: what those brackets say (official, guests, variant, remixer, signals)."""
    pieces = df.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[(\[【][^()\[\]【】]*[)\]】]|[^(\[【]+|[(\[【]"), 0)).alias("pos", "piece"))
    inner = F.when(F.col("piece").rlike(r"^[(\[【].*[)\]】]$"), F.trim(F.expr("substr(piece, 2, length(piece) - 2)")))
    seen = pieces.withColumn("inner", inner).withColumn("guests", T.bracket_guests(F.col("inner"))).withColumn("variant", T.variant_of(F.col("inner")))
    kind = F.when(F.col("inner").isNull(), "text").when(T.is_decoration(F.col("inner")), "describes").when(F.col("guests").isNotNull(), "guest").when(T.names_producer(F.col("inner")), "producer")
    seen = seen.withColumn("kind", kind.when(T.has_sign(F.col("inner")), "sign").when(F.col("variant").isNotNull(), "version").otherwise("text"))
    is_kind = lambda k, c: F.when(F.col("kind") == k, c)
    part = F.struct("pos", F.when(F.col("kind") == "text", F.col("piece")).otherwise(" ").alias("piece"), F.coalesce(is_kind("describes", T.is_official(F.col("inner"))), F.lit(False)).alias("official"), is_kind("guest", F.col("guests")).alias("guests"),
        is_kind("version", F.col("variant")).alias("variant"), is_kind("version", T.remixer_of(F.col("inner"))).alias("remixer"), is_kind("describes", F.lit("decoration")).alias("describes"))
    whole = seen.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    p = F.col("parts")
    said = F.struct(
        F.exists(p, lambda x: x["official"]).alias("official"), F.flatten(F.transform(p, lambda x: F.coalesce(x["guests"], F.expr(_NONE)))).alias("guests"), _first(p, lambda x: x["variant"]).alias("variant"),
        _first(p, lambda x: x["remixer"]).alias("remixer"), F.array_compact(F.flatten(F.transform(p, lambda x: F.array(x["describes"], x["variant"])))).alias("signals"),
    )
    text = F.trim(F.regexp_replace(F.array_join(F.transform(p, lambda x: x["piece"]), ""), r"\s+", " "))
    nothing = F.struct(F.lit(False).alias("official"), F.expr(_NONE).alias("guests"), F.expr(_NO_NAMES).alias("variant"), F.expr(_NO_NAMES).alias("remixer"), F.expr(_NONE).alias("signals"))
    return df.drop("text").join(whole.select("id", text.alias("text"), said.alias("said")), "id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("said", F.coalesce("said", nothing))


def quoted(t: Column) -> Column:
    """Artist and title (a struct) of a text with a title in quotation marks; null if it has none."""
    found = lambda pattern, a, b, c: F.when(names.has_words(F.regexp_extract(t, pattern, b)), F.struct(F.trim(F.coalesce(F.nullif(F.trim(F.regexp_extract(t, pattern, a)), F.lit("")), F.regexp_extract(t, pattern, c))).alias("artist"), F.trim(F.regexp_extract(t, pattern, b)).alias("title")))
    double, single = r'^(.*?)\s*["“]([^"“”]+)["”]\s*(.*)$', r"^(.*?)(?:^|\s)['‘]([^'‘’]+)['’](?=\s|$)\s*(.*)$"
    return F.coalesce(*(found(f"^([^{o}]*){o}([^{c}]+){c}(.*)$", 1, 2, 3) for o, c in QUOTES), found(double, 1, 2, 3), found(single, 1, 2, 3))


def _segments(df: DataFrame) -> DataFrame:
    """df (id, text, topic, said, ...) with segs, the segments that are left of the text, and said with what the others say."""
    parts = F.when(F.col("topic"), F.split("text", TOPIC_BREAK)).otherwise(F.split("text", BREAK))
    colon = F.array(F.regexp_extract("text", COLON, 1), F.regexp_extract("text", COLON, 2))
    parts = F.when(~F.col("topic") & (F.size(F.filter(parts, lambda s: F.trim(s) != "")) < 2) & (colon[0] != ""), colon).otherwise(parts)
    rows = df.select("id", "topic", F.posexplode(parts).alias("pos", "seg")).withColumn("seg", T.trim_symbols(F.trim("seg"))).filter(names.has_words(F.col("seg")))
    own = Window.partitionBy("id")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("pos")) - 1).withColumn("n", F.count("*").over(own))
    describes, cover = (F.col("n") > 1) & T.is_decoration(F.col("seg")), (F.col("place") > 0) & T.is_cover(F.col("seg"))
    version = F.when((F.col("place") >= F.when(F.col("topic"), 1).otherwise(2)) & (F.size(F.split("seg", " ")) <= 6), T.variant_of(F.col("seg")))
    kind = F.when(describes, "decoration").when(cover, "cover").otherwise(version)
    rows = rows.withColumn("kind", kind)
    seen = F.struct("place", "seg", "kind", F.when(F.col("kind").isNotNull() & (F.col("kind") == version), T.remixer_of(F.col("seg"))).alias("remixer"), ((F.col("kind") == "decoration") & T.is_official(F.col("seg"))).alias("official"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(seen)).alias("all"))
    a, said = F.coalesce("all", F.filter(F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("seg"), F.lit("").alias("kind"), F.lit("").alias("remixer"), F.lit(False).alias("official"))), lambda x: F.lit(False))), F.col("said")
    left = F.transform(F.filter(a, lambda x: x["kind"].isNull()), lambda x: x["seg"])
    out = df.join(whole, "id", "left").withColumn("segs", F.when(F.size(left) > 0, left).otherwise(F.array("text")))
    last = F.element_at("segs", -1)
    cut = T.without_end(last)
    out = out.withColumn("cut", cut)
    more = F.transform(F.filter(a, lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    trailing = F.substring(last, F.length("cut") + 1, F.length(last))
    shorter = F.length("cut") < F.length(last)
    said = F.struct(
        (said["official"] | F.exists(a, lambda x: x["official"]) | (shorter & T.is_official(trailing))).alias("official"), said["guests"].alias("guests"), F.coalesce(said["variant"], F.get(F.filter(more, lambda k: k != "decoration"), 0)).alias("variant"),
        F.coalesce(said["remixer"], _first(a, lambda x: x["remixer"])).alias("remixer"), F.concat(said["signals"], more, F.when(shorter, F.array(F.lit("decoration"))).otherwise(F.expr(_NONE))).alias("signals"),
    )
    return out.withColumn("said", said).withColumn("segs", F.concat(F.slice("segs", 1, F.size("segs") - 1), F.array("cut"))).drop("all", "cut")


def _reading(when: Column, artist: Column, title: Column, score: Column | float, *signals: str) -> Column:
    return F.when(when, F.struct(artist.alias("artist"), title.alias("title"), (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"), F.array(*map(F.lit, signals)).alias("signals")))


def _finished(df: DataFrame, stash: Stash) -> DataFrame:
    """df (id, text, said, read, score, hashtags, how: 'title', 'typed' or 'bare'): names apart, guests together, and the confidence. Words of reaction leave
    titles of uploads only; a text that is taken as it is keeps guests too."""
    df = df.select("id", "text", "said", "hashtags", "score", "how", F.col("read.artist").alias("artist"), F.col("read.title").alias("title"), F.col("read.signals").alias("signals"))
    title, t_guests = T.without_guests(F.when(F.col("how") == "title", T.without_reaction(F.col("title"))).otherwise(F.col("title")))
    bare = F.col("how") == "bare"
    title, t_guests = F.when(bare, F.col("title")).otherwise(title), F.when(bare, F.expr(_NONE)).otherwise(t_guests)
    artist, a_guests = T.without_guests(F.regexp_replace("artist", T.LEADING_SIGN, ""))
    df = stash.put(df.select("*", title.alias("t"), t_guests.alias("tg"), T.trim_symbols(artist).alias("credit"), a_guests.alias("ag")), "credits")
    name, alias = T.artist_and_alias(F.col("credit"))
    df = df.withColumn("t", T.trim_symbols(T.unquoted(F.col("t")))).withColumn("main", name).withColumn("aliases", alias)
    each = names.split_names(F.col("main"))
    return df.select(
        "id", F.col("main").alias("artist"), F.when(F.col("t") != "", F.col("t")).otherwise(T.trim_symbols(F.col("text"))).alias("title"), "aliases", F.when(F.size(each) > 1, each).otherwise(F.expr(_NONE)).alias("names"),
        F.array_distinct(F.concat("said.guests", "tg", "ag")).alias("featured"), F.col("said.variant").alias("variant"), F.col("said.remixer").alias("remixer"), F.array_sort(F.array_distinct(F.concat("said.signals", "signals"))).alias("signals"), "hashtags",
        (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * 100 + 0.5) / 100).alias("confidence"),
    )


def read_titles(uploads: DataFrame) -> DataFrame:
    """uploads (id: unique, title, channel, shorts) to the song of each: artist, title, aliases and names of the artist, featured, variant, remixer, signals, hashtags
    and confidence. Null titles read as empty."""
    stash = Stash(uploads.sparkSession)
    base = T.read_channels(uploads.select("id", T.prepared(F.coalesce("title", F.lit(""))).alias("raw"), F.coalesce("shorts", F.lit(False)).alias("shorts"), "channel"))
    base = base.withColumn("shorts", F.col("shorts") | F.col("raw").rlike(r"(?i)#shorts\b"))
    tags = F.slice(F.filter(F.regexp_extract_all("raw", F.lit(r"#([\p{L}\p{N}_]+)"), 1), lambda t: ~F.lower(t).isin("short", "shorts", "fyp")), 1, 10)
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?:\s*#[\p{L}\p{N}_]+)+\s*$", ""), r"(?i)#shorts\b", ""))
    against = F.concat(T.signs_of(F.col("raw")), F.when(F.col("shorts"), F.array(F.lit("shorts"))).otherwise(F.expr(_NONE)))
    base = stash.put(base.select("id", F.col("_name").alias("channel"), (F.col("_topic") & F.col("_name").isNotNull()).alias("topic"), F.col("_vevo").alias("vevo"), text.alias("text"), tags.alias("hashtags"), against.alias("against"), T.penalty_of(F.col("raw"), F.col("shorts")).alias("cost")), "titles")
    bare = stash.put(without_brackets(base).withColumn("text", T.trim_symbols(F.col("text"))), "brackets")
    segs = stash.put(_segments(bare).withColumn("left", F.col("segs")[0]).withColumn("right", F.array_join(F.slice("segs", 2, F.size("segs")), " - ")).withColumn("quote", quoted(F.col("segs")[0])), "segments")
    marked = F.struct(T.without_end(T.trim_symbols(F.col("quote.artist"))).alias("artist"), F.col("quote.title").alias("title"))
    segs = segs.withColumn("quote", F.when(F.col("quote").isNotNull(), marked))
    who = {"channel_key": F.col("channel"), "left_key": T.without_guests(F.col("left"))[0], "right_key": T.without_guests(F.col("right"))[0], "quote_key": T.artist_and_alias(F.col("quote.artist"))[0]}
    segs = stash.put(segs.withColumns({k: names.name_key(c) for k, c in who.items()}), "keys")
    like = lambda key: F.coalesce(dice(F.col("channel_key"), F.col(key)), F.lit(0.0))
    segs = stash.put(segs.withColumns({"l": like("left_key"), "r": like("right_key"), "q": like("quote_key")}).drop(*who), "likeness")
    two, marks = F.size("segs") > 1, F.col("quote").isNotNull() & (F.col("quote.artist") != "")
    channel = F.coalesce("channel", F.lit(""))
    alone = F.coalesce(F.col("quote.title"), F.col("left"))
    read = F.coalesce(
        _reading(F.col("topic"), channel, F.array_join("segs", " - "), TOPIC, "topic"),
        _reading(two & (F.col("l") >= ALIKE), F.col("left"), F.col("right"), SPLIT + OWN, "split", "channel-match"),
        _reading(two & (F.col("r") >= ALIKE) & (F.col("r") > F.col("l")), F.col("right"), F.col("left"), SPLIT + SWAPPED, "split", "swapped"),
        _reading(two, F.col("left"), F.col("right"), SPLIT, "split"),
        _reading(marks & (F.col("q") >= ALIKE), F.col("quote.artist"), F.col("quote.title"), QUOTED + OWN, "quoted", "channel-match"),
        _reading(marks, F.col("quote.artist"), F.col("quote.title"), QUOTED, "quoted"),
        _reading(F.col("vevo"), channel, alone, OWN, "channel-match"),
        _reading(F.lit(True), channel, alone, 0.0, "channel-guess"),
    )
    found = segs.withColumn("read", read).withColumn("score", BASE - F.col("cost") + F.when(F.col("said.official"), OFFICIAL).otherwise(0.0) + F.col("read.score"))
    found = found.withColumn("said", F.col("said").withField("signals", F.concat("against", "said.signals")))
    return _finished(stash.put(found.withColumn("how", F.lit("title")), "readings"), stash)


def read_typed(typed: DataFrame) -> DataFrame:
    """typed (id: unique, text) to the song that is meant, in the same columns: artist and title in either of the usual forms, or all of it as title."""
    stash = Stash(typed.sparkSession)
    base = without_brackets(typed.select("id", T.prepared(F.coalesce("text", F.lit(""))).alias("text"), F.expr(_NONE).alias("hashtags")))
    base = base.withColumn("before", T.trim_symbols(F.col("text"))).withColumn("text", T.without_end(F.col("before")))
    dropped = F.when(F.length("text") < F.length("before"), F.array(F.lit("decoration"))).otherwise(F.expr(_NONE))
    base = base.withColumn("said", F.col("said").withField("signals", F.concat("said.signals", dropped))).withColumn("text", T.unquoted(F.col("text")))
    base = stash.put(base.drop("before").withColumn("quote", quoted(F.col("text"))), "typed")
    t = F.col("text")

    def parted(sign: str) -> Column:
        at = F.instr(t, sign)
        left, right = F.trim(F.substring(t, F.lit(1), at - 1)), F.trim(F.substring(t, at + len(sign), F.length(t)))
        return _reading((at > 1) & names.has_words(left) & names.has_words(right), left, right, TYPED["typed-split"], "typed-split")

    by = [F.regexp_extract(t, r"(?i)^(.+)\s+by\s+(.+)$", k) for k in (1, 2)]
    is_by = names.has_words(by[0]) & names.has_words(by[1]) & ~F.lower(F.trim(by[1])).isin(*NO_ARTIST) & (F.length(F.trim(by[1])) > 2)
    readings = [parted(s) for s in TYPED_BREAKS]
    readings.append(_reading(is_by, by[1], by[0], TYPED["typed-by"], "typed-by"))
    readings.append(_reading(F.col("quote").isNotNull() & names.has_words(F.col("quote.artist")), F.col("quote.artist"), F.col("quote.title"), TYPED["typed-quoted"], "typed-quoted"))
    readings.append(_reading(F.lit(True), F.lit(""), t, TYPED["bare"], "bare"))
    found = base.withColumn("read", F.coalesce(*readings))
    how = F.when(F.array_contains("read.signals", "bare"), "bare").otherwise("typed")
    return _finished(stash.put(found.withColumn("score", F.col("read.score")).withColumn("how", how), "readings"), stash)
