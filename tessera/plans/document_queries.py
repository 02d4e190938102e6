"""Queries over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents, layout
from tessera.plans.registry import query, table

_STRIPPED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g'),
  '(?is)<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)|<template\b.*?(</template\s*>|\z)', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
  '(?i)</?({T.LINE_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
_NAMES = ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in T.ENTITIES.items())


@query()
def page_chunks(spark, sf_dir):
    """Pages to chunks under heading paths; the flagship."""
    pages = table(spark, sf_dir, "pages")
    out = documents.chunks(documents.html_blocks(pages, "page_id", "html"))
    return out.select(F.col("doc_id").alias("page_id"), "chunk_no", "path", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    rf"""WITH t AS (SELECT page_id, regexp_extract_all({_STRIPPED}, '(?i)&(#\d{{1,7}}|#x[0-9a-f]{{1,6}}|[a-z]+);|[^&]+|&') AS parts FROM pages),
d AS (SELECT page_id, list_transform(parts, lambda p: CASE
   WHEN regexp_matches(p, '(?i)^&#x[0-9a-f]{{1,6}};$') THEN chr(('0x' || p[4:-2])::INT)
   WHEN regexp_matches(p, '^&#\d{{1,7}};$') THEN chr(p[3:-2]::INT)
   WHEN regexp_matches(p, '(?i)^&[a-z]+;$') THEN coalesce(map {{{_NAMES}}}[lower(p[2:-2])], p) ELSE p END) AS parts FROM t),
j AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(parts, ''), '[ \t]+', ' ', 'g'), ' *\n+ *', chr(10), 'g'), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS body FROM d)
SELECT page_id, length(body) AS n_chars, sha256(body) AS digest FROM j"""
)
def html_visible_text(spark, sf_dir):
    body = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))
    return body.select("page_id", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("digest"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"


@query(
    rf"""SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path, contains(url, '?') AS has_query,
regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source, {_HOST} LIKE '%.example.com' AND starts_with(url, 'https://') AS allowed FROM pages"""
)
def url_canonical(spark, sf_dir):
    u, host = F.col("url"), T.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), T.url_path(u).alias("path"), u.contains("?").alias("has_query"), F.regexp_extract(u, "[?&]utm_source=([^&#]*)", 1).alias("utm_source"), (host.like("%.example.com") & u.startswith("https://")).alias("allowed"))


@query(f"SELECT host, n FROM (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, host LIMIT 20")
def url_host_counts(spark, sf_dir):
    """Top 20 hosts; the limit is the query's purpose."""
    hosts = table(spark, sf_dir, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return hosts.orderBy(F.desc("n"), "host").limit(20)


@query(r"SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g') AS t FROM documents)")
def doc_clean_text(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query("SELECT line_sha, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, sha256(lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g'), ' '))) AS line_sha FROM documents) GROUP BY line_sha HAVING count(DISTINCT doc_id) > 1")
def doc_line_dupes(spark, sf_dir):
    """Line keys, digits set aside, that more than one document has."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    key = F.sha2(F.lower(F.trim(F.regexp_replace("line", "[0-9]+", "#"))), 256)
    return lines.select("doc_id", key.alias("line_sha")).groupBy("line_sha").agg(F.countDistinct("doc_id").alias("n_docs")).filter("n_docs > 1")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY 2")
def doc_exact_dupes(spark, sf_dir):
    """Keep-first by content."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query()
def doc_split_pieces(spark, sf_dir):
    """Documents as paragraphs packed into chunks of at most 1,200 characters."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    empty = lambda kind: F.lit(None).cast(kind)
    blocks = F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("type"), empty("int").alias("level"), x.alias("text"), empty("boolean").alias("ordered"), empty("array<string>").alias("items"), empty("array<array<string>>").alias("rows"), F.lit(1).alias("page")))
    out = documents.chunks(table(spark, sf_dir, "documents").select("doc_id", blocks.alias("blocks")))
    return out.select("doc_id", "chunk_no", F.length("text").cast("long").alias("n_chars"))


@query("SELECT source, count(*) AS kept, max(doc_id) AS last_doc, max(total)::BIGINT AS n_chars FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents) WHERE total <= 150000 GROUP BY source")
def doc_fit_budget(spark, sf_dir):
    """Whole documents from the start of each source while they fit 150,000 characters."""
    total = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))
    kept = table(spark, sf_dir, "documents").select("source", "doc_id", total.alias("total")).filter("total <= 150000")
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.max("doc_id").alias("last_doc"), F.max("total").alias("n_chars"))


_TURNS = "SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''"


@query(
    f"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ({_TURNS})) WHERE back <= 40),
start AS (SELECT *, coalesce(min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), 0) AS first_user FROM last)
SELECT conv_id, turn, role, length(substr(text, 1, 8000)) AS n_chars FROM start WHERE turn >= first_user"""
)
def conv_fit_history(spark, sf_dir):
    """The newest 40 messages from the first question on, cut to 8,000 characters."""
    turns = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant') AND text <> ''")
    one = Window.partitionBy("conv_id")
    last = turns.withColumn("back", F.row_number().over(one.orderBy(F.desc("turn")))).filter("back <= 40")
    start = last.withColumn("first_user", F.coalesce(F.min(F.when(F.col("role") == "user", F.col("turn"))).over(one), F.lit(0)))
    return start.filter("turn >= first_user").select("conv_id", "turn", "role", F.length(F.substring("text", 1, 8000)).cast("long").alias("n_chars"))


@query(
    f"""SELECT conv_id, turn, length(text) AS asked, length(answer) AS answered FROM
(SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM ({_TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
)
def conv_turn_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant') AND text <> ''")
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return both.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"), F.length("answer").cast("long").alias("answered"))


@query("SELECT lang, list_sort(list(n_chars))[(count(*) // 2) + 1] AS upper_median, quantile_disc(n_chars, 0.5) AS lower_median FROM documents GROUP BY lang")
def upper_median(spark, sf_dir):
    """Element n/2 of the sorted values, counted from 0. Ranks instead of one list: a group never sits in one array."""
    docs = table(spark, sf_dir, "documents")
    w = Window.partitionBy("lang")
    ranked = docs.select("lang", "n_chars", F.row_number().over(w.orderBy("n_chars")).alias("r"), F.count("*").over(w).alias("n"))
    pick = lambda at: F.max(F.when(F.col("r") == at, F.col("n_chars")))
    return ranked.groupBy("lang").agg(pick(F.floor(F.col("n") / 2) + 1).alias("upper_median"), pick(F.floor((F.col("n") + 1) / 2)).alias("lower_median"))


@query(
    """WITH b AS (SELECT DISTINCT n_chars // 64 AS bin FROM documents), g AS (SELECT bin, lead(bin) OVER (ORDER BY bin) AS nxt FROM b)
SELECT bin + 1 AS first_empty, nxt - bin - 1 AS n_bins FROM g WHERE nxt - bin > 1 ORDER BY n_bins DESC, first_empty LIMIT 1"""
)
def histogram_gap(spark, sf_dir):
    """The longest run of empty bins of document lengths, the first on ties. Bins, not rows, are ordered in one task."""
    bins = table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 64).alias("bin")).distinct()
    gaps = bins.select("bin", F.lead("bin").over(Window.orderBy("bin")).alias("nxt")).filter("nxt - bin > 1")
    return gaps.select((F.col("bin") + 1).alias("first_empty"), (F.col("nxt") - F.col("bin") - 1).alias("n_bins")).orderBy(F.desc("n_bins"), "first_empty").limit(1)


@query(
    r"""WITH c AS (SELECT doc_id, string_split(text, chr(10))[1] AS cell FROM documents), s AS (SELECT doc_id, cell, CASE WHEN regexp_matches(cell, '^[=+\-@\t\r]') AND NOT regexp_matches(cell, '^-([\d.,]+%?)?$') THEN '''' || cell ELSE cell END AS safe FROM c)
SELECT doc_id, CASE WHEN regexp_matches(safe, '[",\r\n]') THEN '"' || replace(safe, '"', '""') || '"' ELSE safe END AS cell FROM s"""
)
def csv_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_cell(F.split("text", "\n")[0]).alias("cell"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(u.w, ' ') AS s FROM documents, unnest(regexp_extract_all(text, '\S+')) AS u(w)), n AS (SELECT doc_id, s, regexp_replace(s, '[^0-9.]', '', 'g') AS d FROM t
WHERE regexp_matches(s, '^\(?-?\d{1,3}(,\d{3})*(\.\d+)?\)?$') OR regexp_matches(s, '^\(?-?\d+(\.\d+)?\)?$')),
k AS (SELECT doc_id, s, starts_with(s, '(') AS neg, regexp_replace(s, '[(),]', '', 'g')::DOUBLE AS v FROM n WHERE starts_with(s, '(') = ends_with(s, ')') AND NOT regexp_matches(d, '^0\d') AND length(regexp_replace(replace(d, '.', ''), '^0+', '')) <= 15)
SELECT doc_id, count(*) AS n_numbers, max(CASE WHEN neg THEN -abs(v) ELSE v END) AS largest FROM k GROUP BY doc_id"""
)
def numeric_cell(spark, sf_dir):
    """Numbers among the words of each document."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("w"))
    found = words.filter(F.col("w").rlike("[0-9]")).select("doc_id", T.parse_numeric(F.col("w")).alias("v")).filter("v IS NOT NULL")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_numbers"), F.max("v").alias("largest"))


@query(
    """SELECT doc_id, pos // 4 AS sheet, pos % 4 AS cell, 'page-' || lpad((pos + 1)::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') AS name FROM
(SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)"""
)
def page_numbering(spark, sf_dir):
    """Four pages to a sheet, zero-padded names."""
    w = Window.partitionBy("source")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
    name = F.concat(F.lit("page-"), F.expr("lpad(CAST(pos + 1 AS STRING), greatest(2, length(CAST(n AS STRING))), '0')"))
    return rows.select("doc_id", F.floor(F.col("pos") / 4).alias("sheet"), (F.col("pos") % 4).alias("cell"), name.alias("name"))


@query("SELECT doc_id, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.55 THEN 'medium' ELSE 'low' END AS band FROM (SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(1, length(text)) AS share FROM documents)")
def bands(spark, sf_dir):
    share = F.length(F.regexp_replace("text", "[^a-z]", "")) / F.greatest(F.lit(1), F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(share >= 0.8, "high").when(share >= 0.55, "medium").otherwise("low").alias("band"))


@query(
    """WITH w AS (SELECT doc_id, upper(regexp_replace(source || '-' || doc_id, '[^0-9A-Za-z]', '', 'g')) AS code FROM documents)
SELECT doc_id, code, concat_ws('-', substr(code, 1, 4), substr(code, 5, 4), substr(code, 9, 4), substr(code, 13, 4)) AS shown, sha256(code) AS code_hash FROM w"""
)
def access_code_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("raw"))
    return docs.select("doc_id", T.normal_code(F.col("raw")).alias("code"), T.shown_code(F.col("raw")).alias("shown"), F.sha2(T.normal_code(F.col("raw")), 256).alias("code_hash"))


@query(
    """WITH b AS (SELECT page_id, string_split(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1), '<[^>]*>', '', 'g'), ' ') AS ws FROM pages)
SELECT page_id, len(ws) AS n_words, list_aggregate(list_transform(ws, lambda x: length(x)), 'max') AS longest FROM b"""
)
def page_title_words(spark, sf_dir):
    title = F.regexp_replace(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1", 1), "<[^>]*>", "")
    words = table(spark, sf_dir, "pages").select("page_id", F.split(title, " ").alias("ws"))
    return words.select("page_id", F.size("ws").cast("long").alias("n_words"), F.array_max(F.transform("ws", lambda x: F.length(x))).cast("long").alias("longest"))


@query(
    """WITH l AS (SELECT doc_id, u.i AS i, trim(regexp_replace(string_split(text, chr(10))[u.i + 1], '\\s+', ' ', 'g'), ' ') AS body FROM documents, unnest(range(0, len(string_split(text, chr(10))))) AS u(i))
SELECT doc_id, (i // 50 + 1)::INT AS page, count(*) AS n_lines, sum(length(body))::BIGINT AS n_chars FROM l WHERE body <> '' GROUP BY 1, 2""".replace("\\\\", "\\")
)
def layout_lines(spark, sf_dir):
    """Documents laid out at 50 lines a page, two spans to a line, and read back as lines."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    clean = lines.select("doc_id", "i", F.trim(F.regexp_replace("t", r"\s+", " ")).alias("t")).filter("t <> ''")
    cut = F.floor(F.length("t") / 2).cast("int")
    part = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.substring(F.col("t"), F.lit(1), cut).alias("text")), F.struct(F.lit(1).alias("k"), F.substring(F.col("t"), cut + 1, F.length("t")).alias("text"))))
    spans = clean.select("doc_id", "i", cut.alias("cut"), part.alias("s")).select(
        "doc_id", F.floor(F.col("i") / 50 + 1).cast("int").alias("page"), (F.col("i") * 2 + F.col("s.k")).cast("long").alias("pos"), F.col("s.text").alias("text"),
        F.when(F.col("s.k") == 0, 60.0).otherwise(60.0 + F.col("cut") * 5.0).alias("x"), (780.0 - F.col("i") % 50 * 14.0).alias("y"), (F.length("s.text") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"), F.lit("f").alias("font_name"), F.lit(False).alias("bold"), F.lit(False).alias("field"),
    )
    found = layout.lines(spans)
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "page").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
