"""Queries over claims of the whole site, page breaks and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import claims, overlaps, page_breaks, song_titles
from tessera.plans.registry import query, table

CLAIMS = {"day": 2, "month": 20, "minute": 1, "site": 110, "unanswered": 1}
_KIND = "CASE event_type WHEN 'error' THEN 'refund' WHEN 'signup' THEN 'unsent' ELSE 'claim' END"

# One row for each event in order, with all counts of the site and its subjects after it; x is the subject's state, y the same for this event's windows.
_CLAIMS_SQL = f"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS i, event_id, user_id, {_KIND} AS kind, CAST(ts AS DATE) AS d, CAST(date_trunc('month', ts) AS DATE) AS m, date_trunc('minute', ts) AS mi FROM events),
step AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS remaining,
    CAST(NULL AS DATE) AS site_d, CAST(0 AS BIGINT) AS site_n, CAST(MAP {{}} AS MAP(BIGINT, STRUCT(d DATE, dn BIGINT, m DATE, mn BIGINT, mi TIMESTAMP, un BIGINT, ok BOOLEAN))) AS own
  UNION ALL
  SELECT i, event_id, user_id, outcome, CASE WHEN outcome = 'ok' THEN least({CLAIMS["day"]} - y.dn, {CLAIMS["month"]} - y.mn) - 1 END, d,
    CASE WHEN outcome = 'ok' THEN n + 1 WHEN outcome = 'given back' AND kind = 'unsent' THEN greatest(n - 1, 0) ELSE n END,
    map_concat(own, MAP {{user_id: {{'d': d, 'dn': CASE outcome WHEN 'ok' THEN y.dn + 1 WHEN 'given back' THEN greatest(y.dn - 1, 0) ELSE y.dn END,
      'm': m, 'mn': CASE outcome WHEN 'ok' THEN y.mn + 1 WHEN 'given back' THEN greatest(y.mn - 1, 0) ELSE y.mn END,
      'mi': CASE WHEN outcome = 'ok' THEN mi ELSE y.mi END, 'un': CASE WHEN outcome = 'given back' AND kind = 'refund' THEN y.un + 1 ELSE y.un END,
      'ok': CASE WHEN kind = 'claim' THEN outcome = 'ok' ELSE false END}}}})
  FROM (
    SELECT *, CASE WHEN kind = 'claim' THEN CASE WHEN y.dn >= {CLAIMS["day"]} THEN 'day' WHEN y.mn >= {CLAIMS["month"]} THEN 'month' WHEN y.mi IS NOT DISTINCT FROM mi THEN 'minute' WHEN n >= {CLAIMS["site"]} THEN 'site' ELSE 'ok' END
      WHEN NOT y.ok THEN 'nothing' WHEN kind = 'refund' AND y.un >= {CLAIMS["unanswered"]} THEN 'kept' ELSE 'given back' END AS outcome
    FROM (
      SELECT e.*, own, CASE WHEN site_d = e.d THEN site_n ELSE 0 END AS n,
        {{'dn': CASE WHEN x.d = e.d THEN x.dn ELSE 0 END, 'mn': CASE WHEN x.m = e.m THEN x.mn ELSE 0 END, 'mi': x.mi, 'un': CASE WHEN x.d = e.d THEN x.un ELSE 0 END, 'ok': coalesce(x.ok, false)}} AS y
      FROM (SELECT s.i, s.site_d, s.site_n, s.own FROM step s) s JOIN e ON e.i = s.i + 1, LATERAL (SELECT s.own[e.user_id] AS x))))
SELECT event_id, user_id, outcome, remaining FROM step WHERE i > 0"""


@query(_CLAIMS_SQL)
def site_claims(spark, sf_dir):
    """Claims over a subject's day, month and minute and the whole site's day; errors give the last claim back, signups say that it was never sent."""
    kind = F.expr(_KIND)
    before = F.last(F.when(F.col("kind") == "claim", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("kind")).withColumn("claim_id", F.when(F.col("kind") != "claim", before))
    return claims.site_claims(events.withColumnRenamed("user_id", "subject"), **CLAIMS).withColumnRenamed("subject", "user_id")


_PIECES = """
p AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), ', ') AS t FROM documents)),
q AS (SELECT doc_id, pos // (1 + doc_id % 3) + 1 AS page, pos % (1 + doc_id % 3) + 1 AS block_no, CASE WHEN length(text) % 7 = 0 THEN 'list' ELSE 'paragraph' END AS type, text FROM p),
blocks AS (SELECT * FROM q UNION ALL SELECT DISTINCT doc_id, page, 9, 'paragraph', 'Page ' || page FROM q WHERE doc_id % 2 = 0 UNION ALL SELECT DISTINCT doc_id, page, 0, 'paragraph', '- ' || page || ' -' FROM q WHERE doc_id % 5 = 0)"""


def _pieces(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), ", ")).alias("pos", "text"))
    per = 1 + F.col("doc_id") % 3
    kind = F.when(F.length("text") % 7 == 0, "list").otherwise("paragraph")
    real = pieces.select("doc_id", (F.floor(F.col("pos") / per) + 1).alias("page"), (F.col("pos") % per + 1).alias("block_no"), kind.alias("type"), "text")
    pages = real.select("doc_id", "page").distinct()
    mark = lambda n, text: (F.col("doc_id"), F.col("page"), F.lit(n).cast("long").alias("block_no"), F.lit("paragraph").alias("type"), text.alias("text"))
    feet = pages.filter("doc_id % 2 = 0").select(*mark(9, F.concat(F.lit("Page "), F.col("page").cast("string"))))
    heads = pages.filter("doc_id % 5 = 0").select(*mark(0, F.concat(F.lit("- "), F.col("page").cast("string"), F.lit(" -"))))
    return real.union(feet).union(heads)


@query(
    rf"""WITH RECURSIVE {_PIECES},
real AS (SELECT * FROM blocks WHERE NOT (type = 'paragraph' AND regexp_matches(text, '{page_breaks.PAGE_NUMBER}'))),
ends AS (SELECT doc_id, page, arg_min({{'no': block_no, 'type': type, 'text': text}}, block_no) AS head, arg_max({{'no': block_no, 'type': type, 'text': text}}, block_no) AS tail, count(*) AS n FROM real GROUP BY ALL),
first AS (SELECT doc_id, min(page) AS page FROM ends GROUP BY doc_id),
walk AS (
  SELECT e.*, false AS joins, CAST(NULL AS BIGINT) AS into_no FROM ends e JOIN first USING (doc_id, page)
  UNION ALL
  SELECT doc_id, page, head, tail, n, ok, CASE WHEN ok THEN no END FROM (
    SELECT e.*, w.tail.no AS no, e.page = w.page + 1 AND NOT (w.n = 1 AND w.joins) AND w.tail.type = 'paragraph' AND NOT regexp_matches(w.tail.text, '{page_breaks.SENTENCE_END.replace("'", "''")}') AND e.head.type = 'paragraph' AND regexp_matches(e.head.text, '^\p{{Ll}}') AS ok
    FROM walk w JOIN ends e ON e.doc_id = w.doc_id AND e.page = (SELECT min(page) FROM ends x WHERE x.doc_id = w.doc_id AND x.page > w.page))),
gain AS (SELECT doc_id, page - 1 AS page, into_no AS block_no, head.text AS more FROM walk WHERE joins),
kept AS (SELECT b.*, more FROM blocks b LEFT JOIN gain USING (doc_id, page, block_no) WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.joins AND w.doc_id = b.doc_id AND w.page = b.page AND w.head.no = b.block_no)),
shown AS (SELECT doc_id, page, block_no, type, CASE WHEN more IS NULL THEN text WHEN regexp_matches(text, '\pL-\z') THEN trim(text[:-2] || more) ELSE trim(text || ' ' || more) END AS text FROM kept)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no) - 1 AS block_no, type, md5(text) AS digest FROM shown"""
)
def paragraphs_over_pages(spark, sf_dir):
    """Documents in pages of one to three pieces, some with numbers at their head or foot; what runs on over a break is one paragraph."""
    return page_breaks.joined_paragraphs(_pieces(spark, sf_dir)).select("doc_id", "page", "block_no", "type", F.md5("text").alias("digest"))


_TABLES = """SELECT l_suppkey AS doc_id, (no - 1) // 4 + 1 AS page, no AS block_no, CASE WHEN l_partkey % 8 < 3 THEN 'paragraph' ELSE 'table' END AS type,
  CASE l_partkey % 8 WHEN 0 THEN 'Page ' || ((no - 1) // 4 + 1) WHEN 1 THEN 'Report line ' || l_linenumber WHEN 2 THEN 'Order ' || l_orderkey || repeat(' and more of it', 8) END AS text,
  CASE WHEN l_returnflag = 'A' THEN [['part', 'price'], [l_partkey::VARCHAR, l_linenumber::VARCHAR]] ELSE [['part', 'line', 'order'], [l_partkey::VARCHAR, l_linenumber::VARCHAR, l_orderkey::VARCHAR]] END AS rows
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS no FROM lineitem)"""


@query(
    rf"""WITH b AS ({_TABLES}),
k AS (SELECT doc_id, lower(trim(regexp_replace(text, '\d+', '#', 'g'))) AS key FROM b WHERE type = 'paragraph' AND length(text) <= 80 GROUP BY ALL HAVING count(DISTINCT page) > 1),
real AS (SELECT b.* FROM b WHERE NOT (type = 'paragraph' AND length(text) <= 80 AND (regexp_matches(text, '{page_breaks.PAGE_NUMBER}') OR (doc_id, lower(trim(regexp_replace(text, '\d+', '#', 'g')))) IN (SELECT (doc_id, key) FROM k)))),
near AS (SELECT *, lag(type) OVER w AS before, lag(page) OVER w AS before_page, lag(len(rows[1])) OVER w AS before_width FROM real WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
runs AS (SELECT *, sum(CASE WHEN before = 'table' AND before_page = page - 1 AND before_width = len(rows[1]) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS table_no FROM near WHERE type = 'table'),
parts AS (SELECT *, first_value(rows[1]) OVER w AS head, row_number() OVER w AS part FROM runs WINDOW w AS (PARTITION BY doc_id, table_no ORDER BY block_no)),
flat AS (SELECT doc_id, table_no, page, block_no, CASE WHEN part > 1 AND rows[1] = head THEN rows[2:] ELSE rows END AS rows FROM parts)
SELECT doc_id, table_no, min(page) AS page, md5(string_agg(array_to_string([array_to_string(r, '|') for r in rows], chr(10)), chr(10) ORDER BY block_no)) AS digest, sum(len(rows))::BIGINT AS n_rows FROM flat GROUP BY doc_id, table_no"""
)
def tables_over_pages(spark, sf_dir):
    """A supplier's items as one small table each, four blocks a page, with running text and other paragraphs between; tables that run on are one."""
    no = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    page, part = F.floor((F.col("no") - 1) / 4) + 1, F.col("l_partkey") % 8
    cell = lambda *c: F.array(*(F.col(x).cast("string") for x in c))
    head = lambda *c: F.array(*map(F.lit, c))
    text = F.when(part == 0, F.concat(F.lit("Page "), page.cast("string"))).when(part == 1, F.concat(F.lit("Report line "), F.col("l_linenumber").cast("string")))
    text = text.when(part == 2, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.repeat(F.lit(" and more of it"), 8)))
    rows = F.when(F.col("l_returnflag") == "A", F.array(head("part", "price"), cell("l_partkey", "l_linenumber"))).otherwise(F.array(head("part", "line", "order"), cell("l_partkey", "l_linenumber", "l_orderkey")))
    kind = F.when(part < 3, "paragraph").otherwise("table")
    blocks = table(spark, sf_dir, "lineitem").withColumn("no", no).select(F.col("l_suppkey").alias("doc_id"), page.alias("page"), F.col("no").alias("block_no"), kind.alias("type"), text.alias("text"), rows.alias("rows"))
    found = page_breaks.tables_over_pages(blocks)
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select("doc_id", "table_no", "page", F.md5(lines).alias("digest"), F.size("rows").cast("long").alias("n_rows"))


@query(
    """WITH c AS (SELECT l_suppkey AS t, l_orderkey * 8 + l_linenumber AS no, l_orderkey AS row_no, l_linenumber, l_quantity * 10 AS x, l_quantity * 10 + l_partkey % 40 + (CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END) AS r FROM lineitem),
m AS (SELECT c.t, c.row_no, c.no, a.no AS anchor FROM c JOIN c a ON a.t = c.t AND a.l_linenumber = 1 AND c.x - 3 <= a.r AND c.r + 3 >= a.x WHERE c.l_linenumber > 1),
n AS (SELECT t, row_no, count(*) AS n_cells FROM c WHERE l_linenumber > 1 GROUP BY ALL)
SELECT n.t AS table_no, n.row_no, n_cells, count(DISTINCT m.no) AS aligned, count(DISTINCT anchor) AS claimed FROM n LEFT JOIN m ON m.t = n.t AND m.row_no = n.row_no GROUP BY n.t, n.row_no, n_cells"""
)
def cells_under_anchors(spark, sf_dir):
    """A supplier's first items as anchors, the others as cells of rows by order: how many of each touch."""
    x = F.col("l_quantity").cast("double") * 10
    right = x + F.col("l_partkey") % 40 + F.when(F.col("l_returnflag") == "R", 200).otherwise(0)
    no = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_no"), F.col("l_orderkey").alias("row_no"), no.alias("no"), "l_linenumber", x.alias("x"), right.alias("right"))
    cells = items.filter("l_linenumber > 1").select("table_no", "row_no", F.col("no").alias("cell_no"), "x", "right", F.lit(3.0).alias("slack"))
    anchors = items.filter("l_linenumber = 1").select("table_no", F.col("no").alias("anchor_no"), "x", "right")
    return overlaps.cells_under_anchors(cells, anchors)


@query(
    """WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, word_no) AS k FROM (
  SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS word_no, floor(l_extendedprice / 10) AS y0, floor(l_extendedprice / 10) + l_quantity AS y1, l_partkey AS x0 FROM lineitem)),
step AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS word_no, CAST([] AS STRUCT(a DOUBLE, b DOUBLE)[]) AS firsts, CAST(NULL AS BIGINT) AS line_no FROM w
  UNION ALL
  SELECT page, k, word_no, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(firsts, {'a': y0::DOUBLE, 'b': y1::DOUBLE}) ELSE firsts END, CASE WHEN hit IS NULL OR hit = 0 THEN len(firsts) ELSE hit - 1 END
  FROM (SELECT w.page, w.k, w.word_no, w.y0, w.y1, s.firsts, list_position([least(f.b, w.y1) - greatest(f.a, w.y0) > least(f.b - f.a, w.y1 - w.y0) * 0.5 for f in s.firsts], true) AS hit FROM step s JOIN w ON w.page = s.page AND w.k = s.k + 1))
SELECT page, word_no, line_no FROM step WHERE k > 0"""
)
def word_lines(spark, sf_dir):
    """A supplier's items as words of a page, by price and quantity; each joins the first line whose first word it overlaps by half."""
    y0 = F.floor(F.col("l_extendedprice").cast("double") / 10).cast("double")
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("word_no"), F.col("l_partkey").alias("x0"), y0.alias("y0"), (y0 + F.col("l_quantity").cast("double")).alias("y1"))
    return overlaps.line_words(words, ["page"]).select("page", "word_no", "line_no")


_SONG = {"brand": "replace(p_brand, '#', ' ')", "case": "p_partkey % 8"}
_SONG_TITLE = (
    "CASE {case} WHEN 0 THEN {brand} || ' - ' || p_name || ' (Official Video)' WHEN 1 THEN p_name || ' | ' || {brand} WHEN 2 THEN {brand} || ' - ' || p_name || ' (Live at Home)' WHEN 3 THEN p_name || ' - Remastered 2009' "
    "WHEN 4 THEN {brand} || ' - ' || p_name || ' ft. Guest ' || p_size || ' & Friend' WHEN 5 THEN {brand} || ' - ' || p_name || ' (DJ ' || p_size || ' Remix)' WHEN 6 THEN {brand} || ' \"' || p_name || '\" REACTION' ELSE '★ ' || {brand} || ' - ' || p_name || ' #shorts #no' || p_size END"
).format(**_SONG)
_SONG_CHANNEL = "CASE {case} WHEN 0 THEN replace(p_brand, '#', '') || 'VEVO' WHEN 1 THEN {brand} WHEN 3 THEN {brand} || ' - Topic' WHEN 5 THEN 'Someone' END".format(**_SONG)


@query(
    f"""SELECT p_partkey, {_SONG["brand"]} AS artist, p_name AS title, CASE {_SONG["case"]} WHEN 2 THEN 'live' WHEN 5 THEN 'remix' END AS variant, CASE WHEN {_SONG["case"]} = 5 THEN 'DJ ' || p_size END AS remixer,
CASE WHEN {_SONG["case"]} = 4 THEN 'Guest ' || p_size || '|Friend' ELSE '' END AS featured, CASE WHEN {_SONG["case"]} = 7 THEN 'no' || p_size ELSE '' END AS hashtags,
CASE {_SONG["case"]} WHEN 0 THEN 'channel-match decoration split' WHEN 1 THEN 'split swapped' WHEN 2 THEN 'live split' WHEN 3 THEN 'decoration topic' WHEN 4 THEN 'split' WHEN 5 THEN 'remix split' WHEN 6 THEN 'quoted reaction' ELSE 'shorts split' END AS signals,
CASE {_SONG["case"]} WHEN 0 THEN 80 WHEN 1 THEN 70 WHEN 3 THEN 80 WHEN 6 THEN 0 WHEN 7 THEN 35 ELSE 50 END AS percent FROM part"""
)
def title_songs(spark, sf_dir):
    """Parts as uploads under all kinds of titles; the song is the part's, however it is written."""
    uploads = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SONG_TITLE).alias("title"), F.expr(_SONG_CHANNEL).alias("channel"), F.lit(False).alias("shorts"))
    read = song_titles.read_titles(uploads)
    return read.select(F.col("id").alias("p_partkey"), "artist", "title", "variant", "remixer", F.array_join("featured", "|").alias("featured"), F.array_join("hashtags", "|").alias("hashtags"), F.array_join("signals", " ").alias("signals"), F.round(F.col("confidence") * 100).cast("int").alias("percent"))


_TYPED = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' by ' || {brand} WHEN 1 THEN {brand} || ' – ' || p_name WHEN 2 THEN {brand} || ' “' || p_name || '” (Lyrics)' ELSE p_name || ' ' || {brand} END".format(**_SONG)


@query(
    f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE {_SONG['brand']} END AS artist, CASE WHEN p_partkey % 4 = 3 THEN p_name || ' ' || {_SONG['brand']} ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN 75 WHEN 3 THEN 20 ELSE 80 END AS percent FROM part"
)
def typed_songs(spark, sf_dir):
    """The same as people type it."""
    read = song_titles.read_typed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_TYPED).alias("text")))
    return read.select(F.col("id").alias("p_partkey"), "artist", "title", F.round(F.col("confidence") * 100).cast("int").alias("percent"))
