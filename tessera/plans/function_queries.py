"""Queries over column functions: names, titles, boxes, axes, numbers, and folds that are windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import names, shapes, titles
from tessera.operators import matching, sequences
from tessera.plans.registry import query, table

_KEY = r"regexp_replace(regexp_replace(replace(strip_accents(lower({0})), '&', ' and '), '[''’‘`´.]', '', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"SELECT w AS word, {_KEY.format('w')} AS key FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def name_keys(spark, sf_dir):
    """Words without case, accents and signs."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", names.name_key(F.col("word")).alias("key"))


_TITLE = "p_brand || ' - ' || p_name || CASE p_partkey % 9 WHEN 0 THEN ' (Live at Home)' WHEN 1 THEN ' (Acoustic)' WHEN 2 THEN ' [Karaoke]' WHEN 3 THEN ' (Slowed + Reverb)' WHEN 4 THEN ' cover' WHEN 5 THEN ' (Demo)' WHEN 6 THEN ' reaction' WHEN 7 THEN ' 10 hours loop' ELSE '' END"


@query(
    f"""SELECT p_partkey, CASE WHEN regexp_matches(t, '\\bcover\\b') THEN 'cover' WHEN regexp_matches(t, '\\blive\\b') THEN 'live' WHEN regexp_matches(t, '\\bacoustic\\b') THEN 'acoustic' WHEN regexp_matches(t, '\\bdemo\\b') THEN 'demo' WHEN regexp_matches(t, '\\bkaraoke\\b') THEN 'karaoke' WHEN regexp_matches(t, '\\bslowed\\b|\\breverb\\b') THEN 'slowed' END AS variant,
greatest(CASE WHEN regexp_matches(t, '\\breaction\\b') THEN 0.5 ELSE 0.0 END, CASE WHEN regexp_matches(t, '\\b\\d+\\s*hours?\\b|\\bloop\\b') THEN 0.4 ELSE 0.0 END)::DOUBLE + CASE WHEN p_partkey % 2 = 0 THEN 0.15 ELSE 0.0 END::DOUBLE AS penalty FROM (SELECT p_partkey, lower({_TITLE}) AS t FROM part)"""
)
def title_variants(spark, sf_dir):
    """The kind of version that a title names, and what speaks against it."""
    t = F.expr(_TITLE)
    return table(spark, sf_dir, "part").select("p_partkey", titles.variant_of(t).alias("variant"), titles.penalty_of(t, F.col("p_partkey") % 2 == 0).alias("penalty"))


_HAS = "length({0}) >= 6 AND length({0}) >= 0.6 * length({1}) AND contains({1}, {0})"
_HOLDS = f"(({_HAS}) OR ({_HAS.replace('{0}', '{x}').replace('{1}', '{0}').replace('{x}', '{1}')}))"
_ARTIST_KEY = "replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), '&', ' and '), '[''’‘`´.]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^the ', ''), ' ', '')"
_CREDIT = "CASE p_partkey % 5 WHEN 1 THEN p_brand || ' feat. Guest ' || p_size WHEN 2 THEN 'Guest with ' || p_brand WHEN 3 THEN p_brand || ' vs. Nobody' WHEN 4 THEN 'The ' || p_brand ELSE p_brand END"
_ASKED = "CASE p_partkey % 7 WHEN 1 THEN p_name || ' (Deluxe)' WHEN 2 THEN p_name || ' (Live)' WHEN 3 THEN p_name || ' - Acoustic' WHEN 4 THEN 'The ' || p_name ELSE p_name END"
_LISTED = "CASE p_partkey % 3 WHEN 0 THEN p_name || ' (Live)' WHEN 1 THEN p_name || ' x' ELSE p_name END"
_NAMES = "list_filter(list_transform(list_concat([{0}], regexp_split_to_array({0}, ' (feat\\.|with|vs\\.) ')), lambda n: {1}), lambda n: n <> '')"


@query(
    f"""WITH s AS (SELECT p_partkey AS song, {_ASKED} AS title, {_CREDIT} AS artist FROM part),
k AS (SELECT song, regexp_matches(title, 'Live|Acoustic') AS version, {_KEY.format('title')} AS t, {_KEY.format("regexp_replace(title, '[(][^()]*[)]', '')")} AS b, {_ARTIST_KEY.format('artist')} AS w, {_NAMES.format('artist', _ARTIST_KEY.format('n'))} AS a FROM s),
c AS (SELECT entry, side, {_KEY.format('title')} AS t, {_ARTIST_KEY.format('artist')} AS w, {_NAMES.format('artist', _ARTIST_KEY.format('n'))} AS a FROM (
  SELECT p_partkey AS entry, 'forward' AS side, {_LISTED} AS title, 'The ' || p_brand || ' & Band' AS artist FROM part UNION ALL SELECT p_partkey, 'backward', p_type || ' ' || p_name, p_brand FROM part)),
d AS (SELECT entry, side, t, w, list_distinct(list_concat(a, CASE WHEN side = 'forward' THEN [replace(w, 'andband', ''), 'band'] ELSE [] END)) AS a FROM c)
SELECT DISTINCT song, entry, side FROM k JOIN d ON (k.t = d.t OR (NOT version AND (k.b = d.t OR {_HOLDS.format('k.t', 'd.t')} OR {_HOLDS.format('k.b', 'd.t')}))) AND (list_has_any(k.a, d.a) OR {_HOLDS.format('k.w', 'd.w')})"""
)
def song_catalog(spark, sf_dir):
    """Songs and a list of entries meet on title and artist, from both ends of an entry: guests and rivals, brackets and versions on either side."""
    part, none = table(spark, sf_dir, "part"), F.lit(None).cast("array<string>")
    songs = part.select(F.col("p_partkey").alias("song"), F.expr(_CREDIT).alias("artist"), F.expr(_ASKED).alias("title"))
    catalog = part.select(F.col("p_partkey").alias("entry"), F.lit("sample").alias("relation"), F.concat(F.lit("The "), "p_brand", F.lit(" & Band")).alias("artist"), F.expr(_LISTED).alias("title"), F.col("p_brand").alias("source_artist"), F.concat_ws(" ", "p_type", "p_name").alias("source_title"), *(none.alias(c) for c in ("title_aliases", "artist_aliases", "source_title_aliases", "source_artist_aliases")))
    return matching.catalog_matches(songs, catalog)


@query("SELECT p_partkey, p_retailprice - p_size - 10 AS width, p_size * 3 - 2 * p_size AS height, p_size AS x, p_size AS y FROM part")
def boxes_and_margins(spark, sf_dir):
    """A box from margins, and back, and again."""
    m = F.struct(F.col("p_size").alias("top"), F.col("p_size").alias("left"), F.lit(10).alias("right"), F.col("p_size").alias("bottom"))
    width, height = F.col("p_retailprice"), F.col("p_size") * 3
    box = shapes.box_from_margins(width, height, m)
    again = shapes.box_from_margins(width, height, shapes.margins_from_box(width, height, box))
    return table(spark, sf_dir, "part").select("p_partkey", again.alias("b")).select("p_partkey", "b.width", "b.height", "b.x", "b.y")


@query(
    """WITH a AS (SELECT o_custkey AS k, min(o_totalprice) AS lo, CASE WHEN max(o_totalprice) > min(o_totalprice) THEN max(o_totalprice) ELSE min(o_totalprice) + 1 END AS hi FROM orders GROUP BY 1),
s AS (SELECT *, (hi - lo) / 6 AS raw, pow(10.0, floor(log10((hi - lo) / 6))) AS mag FROM a), t AS (SELECT *, CASE WHEN mag >= raw THEN mag WHEN 2 * mag >= raw THEN 2 * mag WHEN 2.5 * mag >= raw THEN 2.5 * mag WHEN 5 * mag >= raw THEN 5 * mag ELSE 10 * mag END AS step FROM s)
SELECT k, floor(lo / step + 1e-9) * step AS first, ceil(hi / step - 1e-9) * step AS last, CAST(round((ceil(hi / step - 1e-9) - floor(lo / step + 1e-9))) AS INT) + 1 AS n FROM t"""
)
def axis_ticks(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).withColumn("a", shapes.axis(F.col("lo"), F.col("hi")))
    return found.select("k", F.col("a.lo").alias("first"), F.col("a.hi").alias("last"), F.size(shapes.ticks(F.col("a"))).alias("n"))


@query(
    """SELECT doc_id, sha256(unhex(string_agg(h, '' ORDER BY i))) AS print FROM (SELECT doc_id, 1 AS i, '4040000000000000' || hex(encode(md5(coalesce(text, '')))) AS h FROM documents UNION ALL SELECT doc_id, 2, '0000000000000000' FROM documents
UNION ALL SELECT doc_id, 3, CASE length(coalesce(lang, '')) WHEN 0 THEN '0000000000000000' WHEN 2 THEN '4000000000000000' WHEN 3 THEN '4008000000000000' END || hex(encode(coalesce(lang, ''))) FROM documents) GROUP BY doc_id"""
)
def part_fingerprints(spark, sf_dir):
    """Three parts, each with its length before it: of the whole text, an empty one, and the language."""
    return table(spark, sf_dir, "documents").select("doc_id", shapes.fingerprint(F.md5(F.coalesce("text", F.lit(""))), F.lit(""), F.coalesce("lang", F.lit(""))).alias("print"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 AND c_custkey % 5 <> 4 THEN c_name END AS payload FROM customer")
def signed_tokens(spark, sf_dir):
    """Signed, some of them expired or changed on the way, and read again."""
    k = F.col("c_custkey")
    made = shapes.token(F.col("c_name"), F.when(k % 3 == 2, 100).otherwise(1000).cast("long"), "secret")
    sent = F.when(k % 5 == 4, F.concat(F.lit("x"), made)).otherwise(made)
    return table(spark, sf_dir, "customer").select("c_custkey", shapes.token_payload(sent, F.lit(950), "secret", grace=600).alias("p"), shapes.token_payload(sent, F.lit(950), "secret").alias("payload")).drop("p")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS tool, CASE WHEN event_type = 'error' THEN 'edit-pdf' END AS editor, lower(event_type) AS ending FROM events")
def tool_slugs(spark, sf_dir):
    kind = F.col("event_type")
    path = F.when(kind.isin("view", "click"), F.concat(F.lit("/tools/"), kind)).when(kind == "error", "/editor/x").otherwise(F.concat(F.lit("/other/"), kind))
    tool = shapes.tool_of_path(path)
    return table(spark, sf_dir, "events").select("event_id", F.nullif(tool, F.lit("edit-pdf")).alias("tool"), F.when(tool == "edit-pdf", tool).alias("editor"), shapes.file_extension(F.concat(F.lit("Report.Final."), F.upper(kind))).alias("ending"))


_GUIDES = {
    "g1": ("val a", "a"), "g2": ("*/ a b c", "a * b / c"), "g3": ("+- a b c", "a + b - c"), "g4": ("+/ a b c", "(a + b) / c"), "g5": ("?: b a 7.5", "CASE WHEN b > 0 THEN a ELSE 7.5 END"), "g6": ("abs b", "abs(b)"), "g7": ("max a b", "greatest(a, b)"), "g8": ("min a b", "least(a, b)"),
    "g9": ("pin a b c", "CASE WHEN b < a THEN a WHEN b > c THEN c ELSE b END"), "g10": ("sqrt a", "sqrt(a)"), "g11": ("mod a b c", "sqrt(a * a + b * b + c * c)"), "g12": ("sin a d", "a * sin(radians(d / 60000))"), "g13": ("cos g10 d", "sqrt(a) * cos(radians(d / 60000))"),
}
_GIVEN = {"a": "CAST(p_size AS DOUBLE)", "b": "CAST(p_partkey % 100 - 50 AS DOUBLE)", "c": "CAST(p_size % 7 + 1 AS DOUBLE)", "d": "CAST(p_partkey % 360 * 60000 AS DOUBLE)"}


@query(f"SELECT p_partkey, {', '.join(f'round({sql}, 6) + 0.0 AS {name}' for name, (_, sql) in _GUIDES.items())} FROM (SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, sql in _GIVEN.items())} FROM part)")
def shape_guides(spark, sf_dir):
    """Formulas of all operators, the last one over another's result."""
    formulas = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(formula).alias("formula")) for name, (formula, _) in _GUIDES.items()))
    got = shapes.guide_values(formulas, F.create_map(*(x for name, sql in _GIVEN.items() for x in (F.lit(name), F.expr(sql)))))
    rows = table(spark, sf_dir, "part").select("p_partkey", got.alias("v"))
    return rows.select("p_partkey", *((F.round(F.col("v")[name], 6) + 0.0).alias(name) for name in _GUIDES))


_LEVEL = "event_id % 4 % 3"
_MARK = "CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'roman' ELSE 'arabic' END"


@query(
    f"""WITH RECURSIVE p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, CAST({_LEVEL} AS INT) AS level, {_MARK} AS scheme FROM events),
g AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN coalesce(max(CASE WHEN level < 1 THEN pos END) OVER w, 0) ELSE coalesce(max(CASE WHEN level < 2 THEN pos END) OVER w, 0) END AS above FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
r AS (SELECT *, sum(CASE WHEN scheme IS NOT NULL AND scheme IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, level, above ORDER BY pos) AS run FROM (SELECT *, lag(scheme) OVER (PARTITION BY user_id, level, above ORDER BY pos) AS before FROM g))
SELECT user_id, pos, CASE WHEN scheme IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, level, above, run ORDER BY pos) END AS number FROM r"""
)
def numbered_paragraphs(spark, sf_dir):
    """Counters of lists that restart below another item, after a plain paragraph, and with another scheme."""
    rows = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("pos"), F.expr(_LEVEL).cast("int").alias("level"), F.expr(_MARK).alias("scheme"))
    return sequences.numbered(rows, ["user_id"], F.lit(1)).select("user_id", "pos", "number")


@query(
    """WITH k AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'cells' WHEN event_type = 'error' THEN 'across' ELSE 'split' END AS kind FROM events)
SELECT user_id, event_id, CASE WHEN kind = 'cells' AND coalesce(lag(kind) OVER w, '') <> 'cells' AND coalesce(lead(kind) OVER w, '') <> 'cells' THEN 'split' ELSE kind END AS kind FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
)
def smoothed_kinds(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "cells").when(F.col("event_type") == "error", "across").otherwise("split")
    return sequences.smoothed(table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind")), ["user_id"], "event_id", "kind", "cells", "split")


@query(
    """WITH k AS (SELECT user_id, event_id, event_type IN ('click', 'view') AS two, event_id % 2 AS side FROM events), b AS (SELECT *, sum(CASE WHEN two AND coalesce(lag_two, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS band FROM (SELECT *, lag(two) OVER (PARTITION BY user_id ORDER BY event_id) AS lag_two FROM k))
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY band, CASE WHEN two THEN side ELSE 0 END, event_id) AS place FROM b"""
)
def columns_in_bands(spark, sf_dir):
    """Runs of rows in two columns are read left, then right; others as they come."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").isin("click", "view").alias("two"), (F.col("event_id") % 2).alias("side"))
    return sequences.banded(rows, ["user_id"], "event_id", "two", "side").select("user_id", "event_id", "place")


@query("SELECT l_orderkey, bool_and(l_linenumber = n) AS same FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS n FROM lineitem) GROUP BY l_orderkey")
def unchanged_plans(spark, sf_dir):
    """Whether an order by date is the order that was."""
    plan = F.transform(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber"))), lambda s: s["l_linenumber"])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sequences.is_identity(plan, 1).alias("same"))


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), m AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) AS n FROM (SELECT DISTINCT user_id, k FROM e WHERE event_id % 3 <> 0))
SELECT e.event_id AS event_id, e.user_id AS user_id, n AS page FROM e JOIN m ON e.user_id = m.user_id AND e.k = m.k"""
)
def remapped_pages(spark, sf_dir):
    """Each user's notes on the pages that stay (all that an event of two thirds is about), with the pages' new numbers."""
    notes = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("page"))
    return sequences.remapped(notes, notes.filter("event_id % 3 <> 0").select("user_id", "page"), ["user_id"], "page")


@query(
    """WITH f AS (SELECT user_id, event_id AS pos, CASE WHEN event_id % 11 = 0 THEN event_type || '_' || (2 + event_id % 3) ELSE event_type END AS name FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY pos) AS n FROM f), t AS (SELECT user_id, name, max(n) AS most FROM r GROUP BY ALL),
c AS (SELECT user_id, name, i FROM (SELECT user_id, name, unnest(range(2, most + 12)) AS i FROM t)), g AS (SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.name ORDER BY i) AS place FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = c.user_id AND t.name = c.name || '_' || c.i))
SELECT r.user_id AS user_id, pos, CASE WHEN n = 1 THEN r.name ELSE r.name || '_' || g.i END AS shown FROM r LEFT JOIN g ON g.user_id = r.user_id AND g.name = r.name AND g.place = r.n - 1"""
)
def merged_field_names(spark, sf_dir):
    """Fields of each user's joined documents under names that are free."""
    from tessera.operators import selection

    name = F.when(F.col("event_id") % 11 == 0, F.concat("event_type", F.lit("_"), (2 + F.col("event_id") % 3).cast("string"))).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), name.alias("name"))
    return selection.free_names(rows, keys=["user_id"]).select("user_id", "pos", "shown")


@query("SELECT p.pos AS pos, d.n_chars AS n_chars FROM (SELECT event_id AS pos, event_id * 7 % 1000 AS doc FROM events) p JOIN documents d ON d.doc_id = p.doc")
def composed_pages(spark, sf_dir):
    """Pages of several documents by the places of a plan."""
    plan = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 1000).alias("doc_id"))
    return plan.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("pos", "n_chars")


@query("SELECT doc_id, n - (n + 1) // 3 AS same, (n + 1) // 3 AS gone, 1 AS new FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)")
def line_diff(spark, sf_dir):
    """A document's numbered lines against the same without every third one and with one more."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, lambda t, i: F.concat_ws(": ", i, t)).alias("a"))
    rows = rows.withColumn("b", F.concat(F.filter("a", lambda x, i: i % 3 != 1), F.array(F.lit("the end"))))
    pairs = sequences.matched_lines(F.col("a"), F.col("b"), most=None)
    return rows.select("doc_id", F.size(pairs).cast("long").alias("same"), (F.size("a") - F.size(pairs)).cast("long").alias("gone"), (F.size("b") - F.size(pairs)).cast("long").alias("new"))


@query("SELECT page_id, string_agg(CASE WHEN k > 0 AND k < m THEN repeat(' ', 4 - length(w) % 4) ELSE '' END, '') AS blanks FROM (SELECT page_id, u.k AS k, ws[u.k] AS w, len(ws) AS m FROM (SELECT page_id, string_split(url, '/') AS ws FROM pages), unnest(range(1, len(ws) + 1)) AS u(k)) GROUP BY page_id")
def tab_stops(spark, sf_dir):
    """The blanks that tabs between the parts of an address become."""
    line = F.replace("url", F.lit("/"), F.lit("\t"))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(shapes.expand_tabs(line), "[^ ]", "").alias("blanks"))
