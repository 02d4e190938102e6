"""Queries over Markdown, links, previews, form fields, sizes and page lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import links
from tessera.operators import graph, markdown, placements
from tessera.sources import posts
from tessera.plans.registry import query, table

_MARKS = ("'# '", "'- '", "'  - '", "'    '", "'3. '", "''")


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, regexp_replace('x ' || replace(unnest(t), chr(9), '    '), '\\s+$', '') AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))
SELECT doc_id, i AS line_no, CASE i % 6 WHEN 0 THEN 'heading' WHEN 3 THEN 'paragraph' WHEN 5 THEN 'paragraph' ELSE 'item' END AS type, CASE WHEN i % 6 IN (2, 3) THEN i - 1 END AS parent,
CASE WHEN i % 6 IN (1, 2, 4) THEN i END AS list_no, CASE i % 6 WHEN 4 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS start, md5(s) AS digest FROM l"""
)
def markdown_blocks(spark, sf_dir):
    """Lines of documents under six kinds of marks in turn: a heading, an item, one under it, more of that, a numbered one, a paragraph."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.struct(i.alias("i"), s.alias("s"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.element_at(F.array(*map(F.expr, _MARKS)), x["i"] % 6 + 1), F.lit("x "), x["s"])), "\n")
    found = markdown.markdown_blocks(lines.select("doc_id", text.alias("text")))
    return found.select("doc_id", "line_no", "type", "parent", "list_no", "start", F.md5("text").alias("digest"))


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
f AS (SELECT *, count(*) FILTER (WHERE i % 7 = 3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1 AS inside FROM l)
SELECT doc_id, i AS line_no, md5(CASE WHEN i % 7 = 3 THEN '```' WHEN inside THEN repeat('> ', i % 30) || repeat(' ', (doc_id * i) % 60) || 'x' || s
  ELSE CASE WHEN i % 30 = 0 THEN '' WHEN i % 30 >= 20 THEN repeat('> ', 19) || '>' ELSE repeat('> ', i % 30 - 1) || '>' END || CASE WHEN (CASE WHEN i % 30 = 0 THEN 0 ELSE 1 END) + (doc_id * i) % 60 > 40 THEN repeat(' ', 40) ELSE repeat(' ', (CASE WHEN i % 30 = 0 THEN 0 ELSE 1 END) + (doc_id * i) % 60) END || 'x' || s END) AS digest FROM f"""
)
def limited_nesting(spark, sf_dir):
    """Lines under up to 29 quotes and 59 blanks, every seventh one a fence; what is over the limits is cut, but not in fences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.struct(i.cast("long").alias("i"), s.alias("s"))).alias("t"))
    line = lambda x: F.when(x["i"] % 7 == 3, "```").otherwise(F.concat(F.repeat(F.lit("> "), (x["i"] % 30).cast("int")), F.repeat(F.lit(" "), ((F.col("doc_id") * x["i"]) % 60).cast("int")), F.lit("x"), x["s"]))
    found = markdown.limited_nesting(docs.select("doc_id", F.array_join(F.transform("t", line), "\n").alias("text")))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"))


_ID = "CAST(10000000 + event_id AS VARCHAR)"
_YT = "left('v' || user_id || '_' || event_id || 'abcdefghijk', 11)"
_LINK = f"""CASE event_id % 9 WHEN 0 THEN 'https://youtu.be/' || {_YT} || '?t=3' WHEN 1 THEN 'http://m.youtube.com/watch?a=b&v=' || {_YT} WHEN 2 THEN 'https://www.youtube.com/shorts/' || {_YT} WHEN 3 THEN 'www.tiktok.com/@some.one/video/' || {_ID} WHEN 4 THEN 'https://vm.tiktok.com/ZM' || event_id || 'x/'
WHEN 5 THEN 'https://instagram.com/reel/ab' || {_ID} || '/?img_index=' || user_id WHEN 6 THEN 'https://twitter.com/who/status/' || {_ID} || '/video/' || (1 + user_id % 9) WHEN 7 THEN 'https://x.com.evil.org/i/status/' || {_ID} ELSE ' https://mobile.x.com/i/web/status/' || {_ID} END"""


@query(
    f"""SELECT event_id, CASE WHEN k < 3 THEN 'youtube' WHEN k < 5 THEN 'tiktok' WHEN k = 5 THEN 'instagram' WHEN k IN (6, 8) THEN 'x' END AS platform, CASE WHEN k < 3 THEN yt WHEN k = 4 THEN 'ZM' || event_id || 'x' WHEN k = 5 THEN 'ab' || id WHEN k <> 7 THEN id END AS id,
CASE k WHEN 3 THEN 'https://www.tiktok.com/@some.one/video/' || id WHEN 4 THEN 'https://vm.tiktok.com/ZM' || event_id || 'x/' WHEN 5 THEN 'https://www.instagram.com/p/ab' || id || '/' || CASE WHEN user_id BETWEEN 1 AND 20 THEN '?img_index=' || user_id ELSE '' END
  WHEN 6 THEN 'https://x.com/i/status/' || id || '/video/' || (1 + user_id % 9) WHEN 8 THEN 'https://x.com/i/status/' || id WHEN 7 THEN NULL ELSE 'https://www.youtube.com/watch?v=' || yt END AS canonical,
CASE WHEN k = 5 AND user_id BETWEEN 1 AND 20 THEN user_id WHEN k = 6 THEN 1 + user_id % 9 END AS index FROM (SELECT event_id, user_id, event_id % 9 AS k, {_ID} AS id, {_YT} AS yt FROM events)"""
)
def media_links(spark, sf_dir):
    """Links of all platforms' forms, and one of another host."""
    rows = table(spark, sf_dir, "events").select("event_id", links.media_link(F.expr(_LINK.replace("VARCHAR", "STRING"))).alias("m"))
    return rows.select("event_id", "m.platform", "m.id", "m.canonical", F.col("m.index").cast("long").alias("index"))


@query(
    """SELECT page_id, CASE WHEN error IS NULL THEN 'Page ' || page_id END AS title, CASE WHEN error IS NULL AND page_id % 3 <> 0 THEN 'Author ' || page_id % 10 END AS channel, CASE WHEN error IS NULL AND page_id % 2 = 0 THEN 'https://i1.ytimg.com/' || page_id END AS thumbnail, error,
CASE WHEN error IS NULL THEN 'Page ' || page_id WHEN page_id % 11 = 0 THEN 'second' END AS answer, CASE WHEN error IS NOT NULL AND page_id % 11 <> 0 THEN CASE WHEN error = 'unreachable' THEN 'gone' ELSE error END END AS reason
FROM (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'blocked' WHEN 2 THEN 'private' WHEN 3 THEN 'unreachable' WHEN 4 THEN 'unreachable' END AS error FROM pages)"""
)
def previews(spark, sf_dir):
    """Answers of a preview service, some refused or broken, and what a second source says then."""
    i, k = F.col("page_id"), F.col("page_id") % 7
    body = F.to_json(F.struct(F.when(k != 4, F.concat(F.lit(" Page​  "), i)).alias("title"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Author "), i % 10)).alias("author_name"), F.concat(F.when(i % 2 == 0, "https://i1.ytimg.com/").otherwise("https://i1.ytimg.com.evil.org/"), i).alias("thumbnail_url")))
    status = F.when(k == 1, 403).when(k == 2, 404).when(k == 3, 500).otherwise(200)
    got = table(spark, sf_dir, "pages").select("page_id", links.preview(body, status).alias("p")).select("page_id", "p.*")
    first = F.when(F.col("error") != "unreachable", F.col("error"))
    answer, reason = links.first_answer([(F.col("title"), first), (F.when(i % 11 == 0, "second"), F.lit("gone"))])
    return got.select("*", answer.alias("answer"), reason.alias("reason"))


@query(
    """SELECT doc_id, CASE WHEN b = 0 THEN '0 B' ELSE regexp_replace(format('{:.1f}', floor(b / pow(1024.0, u) * 10 + 0.5) / 10), '\\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][u + 1] END AS size
FROM (SELECT *, CASE WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS u FROM (SELECT doc_id, coalesce(n_chars, 0) * (1 + doc_id * doc_id * 13) % 200000000000 AS b FROM documents))"""
)
def size_texts(spark, sf_dir):
    b = F.coalesce("n_chars", F.lit(0)) * (1 + F.col("doc_id") * F.col("doc_id") * 13) % 200_000_000_000
    return table(spark, sf_dir, "documents").select("doc_id", links.size_text(b).alias("size"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 AND a > n THEN 'Page ' || a || ' isn''t in this PDF (' || n || CASE WHEN n = 1 THEN ' page).' ELSE ' pages).' END WHEN k = 1 AND least(a, b) > n THEN 'Page ' || least(a, b) || ' isn''t in this PDF (' || n || CASE WHEN n = 1 THEN ' page).' ELSE ' pages).' END
WHEN k = 2 THEN 'Use commas between ranges, like 1-3, 5.' WHEN k = 3 AND b > n THEN 'Page ' || b || ' isn''t in this PDF (' || n || CASE WHEN n = 1 THEN ' page).' ELSE ' pages).' END END AS problem
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS k, l_partkey % 12 + 1 AS a, l_suppkey % 12 + 1 AS b, l_linenumber AS n FROM lineitem)"""
)
def page_list_problems(spark, sf_dir):
    """Lists of a page, a range, a word, an open range, nothing."""
    a, b, k = F.col("l_partkey") % 12 + 1, F.col("l_suppkey") % 12 + 1, F.col("l_partkey") % 5
    typed = F.when(k == 0, a.cast("string")).when(k == 1, F.concat_ws(" - ", a, b)).when(k == 2, F.concat(F.lit("1, x"), a)).when(k == 3, F.concat(F.lit("1;"), b, F.lit("-"))).otherwise("  ")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", links.page_list_problem(typed, F.col("l_linenumber")).alias("problem"))


@query(
    """WITH f AS (SELECT *, l_partkey % 6 AS k, 10.0 * l_quantity AS h, 100.0 + l_quantity AS x1, 400.0 - l_linenumber * 5 AS y1 FROM lineitem WHERE l_partkey % 13 <> 0),
t AS (SELECT *, CASE k WHEN 0 THEN 'typed ' || l_orderkey WHEN 2 THEN 'a' || l_suppkey || ', b' WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN '☒' END WHEN 4 THEN CASE WHEN l_suppkey % 3 = 0 THEN '◉' END END AS text, least(14.0, CASE WHEN l_linenumber > 3 THEN l_linenumber * 3.0 ELSE 0.7 * 2 * h END) AS size FROM f)
SELECT l_orderkey AS doc_id, l_linenumber AS page, l_suppkey AS pos, text, (2 * x1 + 7)::DOUBLE AS x, (900.0 - (2 * (y1 + h) + 9) + greatest(0.0, (2 * h - size * 0.7) / 2))::DOUBLE AS y, 60.0::DOUBLE AS width, size::DOUBLE AS font_size, count(*) AS n FROM t WHERE text IS NOT NULL GROUP BY ALL"""
)
def form_fields(spark, sf_dir):
    """Items as fields: typed, a password, chosen, boxes and buttons set or not, others; some are hidden."""
    k, s = F.col("l_partkey") % 6, F.col("l_suppkey")
    none = F.lit(None).cast("string")
    value = F.when(k == 0, F.array(F.concat(F.lit(" typed "), F.col("l_orderkey")))).when(k == 1, F.array(F.lit("secret"))).when(k == 2, F.array(F.concat(F.lit("a"), s), F.lit("b"))).when(k == 3, F.array(F.when(s % 2 == 0, "Yes").otherwise("Off"))).when(k == 4, F.array(F.when(s % 3 == 0, "1").otherwise("2"))).otherwise(F.array(F.lit("x")))
    x1, y1, h = 100.0 + F.col("l_quantity"), 400.0 - F.col("l_linenumber") * 5, F.col("l_quantity") * 10.0
    fields = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), s.alias("pos"), F.lit("Widget").alias("subtype"), (F.col("l_partkey") % 13 == 0).alias("hidden"), F.array(x1 + 30.0, y1, x1, y1 + h).alias("rect"),
        F.when(k < 2, "Tx").when(k == 2, "Ch").when(k < 5, "Btn").otherwise("Sig").alias("field_type"), value.alias("value"), F.when(k == 1, links.PASSWORD).otherwise(0).alias("flags"), (k == 3).alias("check_box"), (k == 4).alias("radio_button"), F.lit("Yes").alias("export_value"), F.coalesce(none, F.lit("1")).alias("button_value"),
        F.when(F.col("l_linenumber") > 3, F.col("l_linenumber") * 3.0).alias("font_size"), F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 7.0, 9.0))).alias("transform"), F.lit(900.0).alias("view_height"),
    )
    return links.field_spans(fields).groupBy("doc_id", "page", "pos", "text", "x", "y", "width", "font_size").agg(F.count("*").alias("n"))


_DEEP = """CASE event_id % 5 WHEN 0 THEN '{"a":[1,{"b":{"found":' || event_id || '}}],"found2":1}' WHEN 1 THEN '{"x":{"found":0,"y":{"found":5}},"z":[[],{"found":"s' || user_id || '"}]}' WHEN 2 THEN '[{"q":{"q":{"q":{"found":' || props || '}}}},{"found":1}]' WHEN 3 THEN '{"other":' || props || '}' ELSE '{"broken":"found"' END"""


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN nullif(event_id, 0)::VARCHAR WHEN 1 THEN '\"s' || user_id || '\"' WHEN 2 THEN replace(props, ' ', '') END AS found FROM events")
def nested_values(spark, sf_dir):
    """The first value of a key in nested records, depth first; zeros are passed, broken records have none."""
    return table(spark, sf_dir, "events").select("event_id", links.nested_value(F.expr(_DEEP), "found").alias("found"))


@query(
    """WITH o AS (SELECT o_custkey, bool_and(o_totalprice < 480000 AND o_custkey <> 7) AS good FROM orders GROUP BY ALL), c AS (SELECT c_custkey, c_nationkey, c_custkey % 97 <> 0 AS ok, c_custkey % 97 <> 0 AND coalesce(good, true) AS good FROM customer LEFT JOIN o ON o_custkey = c_custkey),
n AS (SELECT n_nationkey, n_regionkey, bool_and(coalesce(c.good, true)) AS good FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'o' || o_orderkey AS id, o_totalprice < 480000 AND o_custkey <> 7 AS sound FROM orders UNION ALL SELECT 'c' || c_custkey, good FROM c UNION ALL SELECT 'n' || n_nationkey, good FROM n"""
)
def sound_graph(spark, sf_dir):
    """Nations, customers and orders, of which some are broken and some refer to what is not there: whether all below each is whole."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda df, letter, key, ok: df.select(F.concat(F.lit(letter), F.col(key)).alias("id"), ok.alias("ok"))
    nodes = node(t("orders"), "o", "o_orderkey", F.col("o_totalprice") < 480_000).union(node(t("customer"), "c", "c_custkey", F.col("c_custkey") % 97 != 0)).union(node(t("nation"), "n", "n_nationkey", F.lit(True)))
    edge = lambda df, a, src, b, dst: df.select(F.concat(F.lit(a), F.col(src)).alias("src"), F.concat(F.lit(b), F.col(dst)).alias("dst"))
    edges = edge(t("customer"), "n", "c_nationkey", "c", "c_custkey").union(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey")).union(edge(t("orders").filter("o_custkey = 7"), "o", "o_orderkey", "gone", "o_orderkey"))
    return graph.sound(nodes, edges).select("id", "sound")


@query(
    """WITH o AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity AS s, l_partkey % 10 AS image FROM lineitem),
m AS (SELECT a.l_suppkey, a.image, a.s * CASE WHEN a.l_linenumber % 2 = 0 THEN 2.0 ELSE 1.0 END AS w, a.s * 3 AS h FROM o a)
SELECT 'im' || image AS image, max(w * (1 + l_suppkey % 4)) AS width, max(h * (1 + l_suppkey % 4)) AS height FROM m GROUP BY image"""
)
def image_placements(spark, sf_dir):
    """A supplier's items as a program: each draws an image under its own matrix, every second one inside a form of twice the width; pages have units of their own."""
    item = table(spark, sf_dir, "lineitem")
    base = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) * 4
    s, nil, image = F.col("l_quantity"), F.lit(None).cast("array<double>"), F.concat(F.lit("im"), F.col("l_partkey") % 10)
    odd, zero = F.col("l_linenumber") % 2 == 1, F.lit(0.0)
    step = lambda k, op, args=nil, name=F.lit(None).cast("string"): F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), args.alias("args"), name.alias("name"))  # noqa: B008, E731
    called = F.when(odd, image).otherwise(F.concat(F.lit("form"), image))
    steps = F.array(step(0, "q"), step(1, "cm", F.array(s, zero, zero, s * 3, F.lit(5.0), F.lit(6.0))), step(2, "Do", nil, called), step(3, "Q"))
    own = item.select(F.concat(F.lit("page"), F.col("l_suppkey")).alias("program"), base.alias("base"), F.explode(steps).alias("x")).select("program", (F.col("base") + F.col("x.k")).alias("pos"), "x.op", "x.args", "x.name")
    names = item.select(image.alias("image")).distinct()
    forms = names.select(F.concat(F.lit("form"), "image").alias("form"), F.array(*map(F.lit, (2.0, 0.0, 0.0, 1.0, 0.0, 0.0))).alias("matrix"))
    inside = names.select(F.concat(F.lit("form"), "image").alias("program"), F.lit(1).alias("pos"), F.lit("Do").alias("op"), nil.alias("args"), F.col("image").alias("name"))
    pages = item.select(F.concat(F.lit("page"), F.col("l_suppkey")).alias("program"), (1 + F.col("l_suppkey") % 4).alias("unit")).distinct()
    return placements.shown_sizes(own.unionByName(inside), pages, forms, names)


@query(
    """SELECT event_id, CASE k WHEN 0 THEN 'syndication' WHEN 1 THEN 'fx' WHEN 2 THEN 'fx' WHEN 3 THEN 'vx' END AS service, CASE k WHEN 0 THEN event_type WHEN 1 THEN 'Video by @u' || user_id WHEN 2 THEN 'X video' WHEN 3 THEN 'X video' END AS title, CASE WHEN k = 0 THEN 1 + event_id % 2 END AS index,
CASE k WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 720 ELSE 360 END WHEN 1 THEN 480 WHEN 3 THEN user_id END AS height, CASE WHEN k < 4 THEN 1 END AS files, CASE k WHEN 4 THEN 'unavailable' WHEN 5 THEN 'no-video' WHEN 6 THEN 'unreachable' END AS error FROM (SELECT *, event_id % 7 AS k FROM events)"""
)
def post_videos(spark, sf_dir):
    """Answers of three services about posts, refused, empty or without a video in turn; the first good one is taken."""
    k, file = F.col("event_id") % 7, lambda n: F.concat(F.lit("https://video.twimg.com/vid/" + n), F.col("event_id"), F.lit(".mp4"))
    text = lambda parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    own = lambda size: '{"type":"video","video_info":{"variants":[{"content_type":"video/mp4","url":"https://video.twimg.com/' + size + '/a.mp4","bitrate":1}]}}'
    first = F.when(k == 0, text(['{"text":"', F.col("event_type"), ' https://t.co/x","mediaDetails":[{"type":"photo"},' + own("1280x720") + "," + own("640x360") + "]}"])).when(k == 4, '{"__typename":"TweetTombstone"}').when(k == 5, '{"mediaDetails":[{"type":"photo"}]}').otherwise("{}")
    second = F.when(k == 1, text(['{"status":{"author":{"screen_name":"u', F.col("user_id"), '"},"media":{"all":[{"type":"video","url":"', file("f"), '","width":800,"height":480}]}}}']))
    second = second.when(k == 2, text(['{"tweet":{"media":{"videos":[{"type":"video","url":"', file("o"), '"}]}}}'])).when(k == 4, '{"code":404}').otherwise("nothing")
    third = F.when(k == 3, text(['{"media_extended":[{"type":"video","url":"', file("v"), '","size":{"width":1,"height":', F.col("user_id"), "}}]}"])).otherwise("{}")
    events = table(spark, sf_dir, "events")
    raw = [events.select("event_id", F.lit(s).alias("service"), body.alias("body"), (2 + F.col("event_id") % 2).cast("int").alias("wanted")) for s, body in zip(posts.SERVICES, (first, second, third))]
    found = posts.post_videos(raw[0].union(raw[1]).union(raw[2]).withColumnRenamed("event_id", "id"))
    a = F.col("answer")
    return found.select(F.col("id").alias("event_id"), "service", a["title"].alias("title"), a["index"].alias("index"), a["variants"][0]["height"].alias("height"), F.when(a.isNotNull(), F.size(a["variants"])).alias("files"), "error")
