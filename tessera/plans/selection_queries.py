"""Queries over orders, firsts and groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.plans.registry import query, table

_YEAR = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END"


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")
def profile_by_key(spark, sf_dir):
    """Three columns of one key; both reach the scan."""
    return table(spark, sf_dir, "customer").filter("c_custkey = 42").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey = 7)")
def owner_rows(spark, sf_dir):
    """What one owner may read: own rows whose owner exists."""
    mine = table(spark, sf_dir, "customer").filter("c_custkey = 7").select("c_custkey")
    orders = table(spark, sf_dir, "orders").filter("o_custkey = 7")
    return orders.join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT v.uid AS uid, c_name, c_acctbal FROM (VALUES (CAST(3 AS BIGINT)), (CAST(-1 AS BIGINT))) v(uid) LEFT JOIN customer ON c_custkey = v.uid")
def parameter_left_join(spark, sf_dir):
    """A relation of parameters, kept whole."""
    given = spark.createDataFrame([(3,), (-1,)], "uid long")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return given.join(people, F.col("uid") == F.col("c_custkey"), "left").select("uid", "c_name", "c_acctbal")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC NULLS FIRST, event_id) AS place, event_id FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS t FROM events)")
def newest_first_nulls_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_type") != "error", F.col("ts")))
    w = Window.partitionBy("user_id").orderBy(selection.newest_first("t"), "event_id")
    return rows.select("user_id", F.row_number().over(w).alias("place"), "event_id")


@query(
    f"""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC NULLS LAST, o_orderkey) AS newest, row_number() OVER (PARTITION BY o_custkey ORDER BY y ASC NULLS LAST, o_orderkey) AS oldest
FROM (SELECT o_custkey, o_orderkey, {_YEAR} AS y FROM orders)"""
)
def year_nulls_last_both_ways(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("y", F.expr(_YEAR))
    place = lambda newest: F.row_number().over(Window.partitionBy("o_custkey").orderBy(selection.by_year("y", newest), "o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", place(True).alias("newest"), place(False).alias("oldest"))


@query(
    f"""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END, y NULLS LAST, o_orderkey) AS place
FROM (SELECT *, {_YEAR} AS y FROM orders)"""
)
def role_then_year(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(selection.in_custom_order("o_orderstatus", ["P", "O", "F"]), selection.by_year("y", False), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("y", F.expr(_YEAR)).select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def at_most_one_row(spark, sf_dir):
    """The order of customers who have only one; a second one would be an error."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    single = orders.groupBy("o_custkey").count().filter("count = 1").select("o_custkey")
    return selection.at_most_one(orders.join(single, "o_custkey", "left_semi"), ["o_custkey"])


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY ORDER BY ts, event_id LIMIT 500")
def vacuum_batch(spark, sf_dir):
    """The next 500 rows to go."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return selection.batch_to_delete(events, F.col("ts") < F.lit(now) - F.expr("INTERVAL 20 DAYS"), ["ts", "event_id"], 500).select("event_id")


@query("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n BETWEEN 2 AND 4")
def alternatives_top3(spark, sf_dir):
    """The three best after the main one."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return rows.withColumn("n", F.row_number().over(w)).filter("n BETWEEN 2 AND 4").select("c_nationkey", "c_custkey")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(p_size, 5), 0) DESC, p_retailprice DESC, p_partkey) AS place FROM part")
def variants_by_height(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.coalesce(F.nullif("p_size", F.lit(5)), F.lit(0))), F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("place"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def sample_page(spark, sf_dir):
    """The longest text, the first one on ties; partial sums, no sort."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", "doc_id", F.length("text").alias("n"))
    return docs.groupBy("source").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"))


@query(
    """SELECT p_partkey, list_slice(list_distinct_ordered, 1, 4) AS related FROM (SELECT p_partkey, list_filter([p_partkey % 5, p_partkey % 3 + 2, p_partkey % 7, 1], lambda x, i: x <> p_partkey % 10 AND list_position([p_partkey % 5, p_partkey % 3 + 2, p_partkey % 7, 1], x) = i) AS list_distinct_ordered FROM part)"""
)
def related_tools(spark, sf_dir):
    """Two lists one after another, each value once, without the own one."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", selection.related([F.array(k % 5, k % 3 + 2), F.array(k % 7, F.lit(1).cast("long"))], k % 10, 4).alias("related"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 50")
def lru_kept(spark, sf_dir):
    return selection.recently_used(table(spark, sf_dir, "events"), "user_id", "ts", 50)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50")
def first_fifty(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(50)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS place FROM events")
def stable_boost(spark, sf_dir):
    """Purchases first, both parts in their old order."""
    return selection.stable_partition(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_type") == "purchase", "event_id").drop("event_type")


@query("SELECT event_id, CASE WHEN n = 1 THEN event_type ELSE event_type || '-' || n END AS shown FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)")
def numbered_labels(spark, sf_dir):
    return selection.numbered_repeats(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("event_id", "shown")


@query(
    """WITH o AS (SELECT DISTINCT p_brand, unnest([min(p_size), max(p_size), CAST(floor(avg(p_size)) AS BIGINT)]) AS offered FROM part GROUP BY p_brand),
j AS (SELECT p_partkey, offered, offered BETWEEN p_size * 0.85 AND p_size * 1.15 AS near, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - offered), offered) AS n FROM part JOIN o ON o.p_brand = part.p_brand)
SELECT p_partkey, offered FROM (SELECT *, bool_or(near) OVER (PARTITION BY p_partkey) AS any_near FROM j) WHERE near OR (NOT any_near AND n = 1)"""
)
def nearest_quality(spark, sf_dir):
    """Each part's size among the least, the largest and the mean size of its brand."""
    part = table(spark, sf_dir, "part")
    sizes = F.array(F.min("p_size").cast("long"), F.max("p_size").cast("long"), F.floor(F.avg("p_size")))
    offered = part.groupBy("p_brand").agg(sizes.alias("s")).select("p_brand", F.explode(F.array_distinct("s")).alias("offered"))
    wanted = part.select("p_brand", "p_partkey", F.col("p_size").alias("wanted"))
    return selection.nearest_within(wanted, offered, "p_brand", "wanted").select("p_partkey", "offered")


@query(
    """SELECT o.o_orderkey AS o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS found FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'Customer#' || o_custkey END AS code, o_custkey % 11 AS other FROM orders) o
LEFT JOIN (SELECT 'Customer#' || c_custkey AS code, c_custkey FROM customer) a ON a.code = o.code LEFT JOIN (SELECT min(c_custkey) AS c_custkey, c_custkey % 11 AS other FROM customer WHERE c_custkey < 11 GROUP BY 2) b ON b.other = o.other"""
)
def customer_by_codes(spark, sf_dir):
    """By the first code, then by the second."""
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.concat(F.lit("Customer#"), k)).alias("code"), (k % 11).alias("other"))
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("Customer#"), F.col("c_custkey")).alias("code"), F.when(F.col("c_custkey") < 11, F.col("c_custkey") % 11).alias("other"), F.col("c_custkey").alias("found"))
    return selection.coalesced_lookup(rows, users, ["code", "other"], "found").select("o_orderkey", "found")


@query("SELECT k, item, CASE WHEN bool_or(own) THEN max(CASE WHEN own THEN v END) ELSE max(v) END AS v FROM (SELECT n_regionkey AS k, n_nationkey % 4 AS item, n_name AS v, true AS own FROM nation WHERE n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey, n_nationkey % 4) UNION ALL SELECT r_regionkey, i, r_name, false FROM region, (SELECT unnest([0, 1, 2, 3, 4]) AS i)) GROUP BY k, item")
def inherited_resources(spark, sf_dir):
    """A nation's own name for an item, and otherwise its region's."""
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k"), (F.col("n_nationkey") % 4).alias("item")).agg(F.min_by("n_name", "n_nationkey").alias("v"))
    inherited = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("item"), F.col("r_name").alias("v"))
    return selection.overlay(own, inherited, ["k", "item"], "v")


@query("SELECT user_id, count(*) FILTER (WHERE change) = count(DISTINCT kind) AS contiguous FROM (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS change FROM (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE event_type END AS kind FROM events)) GROUP BY user_id")
def contiguous_groups(spark, sf_dir):
    """Half of the users' events by day, which are contiguous, the others by kind, which hardly are."""
    kind = F.when(F.col("user_id") % 2 == 0, F.to_date("ts").cast("string")).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"))
    return selection.contiguous(rows, ["user_id"], "kind", "event_id")


@query(
    """WITH s AS (SELECT n_regionkey AS k, n_nationkey AS sec, n_nationkey % 4 + 1 AS size FROM nation), b AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY sec) AS e FROM s),
r AS (SELECT c_nationkey % 5 AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS place FROM customer)
SELECT c_custkey, sec AS section FROM r LEFT JOIN b ON b.k = r.k AND r.place > e - size AND r.place <= e"""
)
def section_slices(spark, sf_dir):
    """Customers by position into sections of given sizes."""
    sizes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("sec"), (F.col("n_nationkey") % 4 + 1).alias("size"))
    place = F.row_number().over(Window.partitionBy(F.col("c_nationkey") % 5).orderBy("c_custkey"))
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("k"), "c_custkey", place.alias("place"))
    return selection.sections(sizes, rows, ["k"], "size", "sec", "place").select("c_custkey", "section")


@query("SELECT source, coalesce(sum(length(text)), 0) = 0 OR 2 * count(*) FILTER (WHERE coalesce(length(text), 0) < 200) >= count(*) AS scanned FROM documents GROUP BY source")
def scanned_documents(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("source", F.length("text").alias("n")).withColumn("scan", F.coalesce("n", F.lit(0)) < 200)
    return selection.scanned(pages, "source", "n", "scan")


@query(
    """SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 1 AS odd, l_linenumber % 2 = 0 AS even, l_linenumber = 2 AS cur, (l_linenumber BETWEEN 1 AND 2 OR l_linenumber BETWEEN 5 AND 9) AND l_linenumber <= 6 AS spans FROM lineitem"""
)
def page_scopes(spark, sf_dir):
    page, count = F.col("l_linenumber"), F.lit(6)
    scope = lambda name, **k: selection.in_scope(page, F.lit(7), name, **k).alias
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scope("odd")("odd"), scope("even")("even"), scope("current", current=F.lit(2))("cur"), selection.in_scope(page, count, "range", spans=[(1, 2), (5, 9)]).alias("spans"))


@query(
    """SELECT user_id, day, CASE WHEN list_has_any(k, ['purchase']) THEN 'shop' WHEN list_has_any(k, ['click', 'signup']) THEN 'visit' WHEN list_has_any(k, ['error']) THEN 'help' END AS route
FROM (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type) AS k FROM events GROUP BY ALL)"""
)
def route_any_of(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", "day", selection.any_of(F.col("k"), [("shop", ["purchase"]), ("visit", ["click", "signup"]), ("help", ["error"])]).alias("route"))


@query(
    """WITH c AS (SELECT user_id, event_id % 30 AS x, date_part('hour', ts) AS y FROM events),
h AS (SELECT user_id, min(x) AS l, max(x) AS r FROM (SELECT user_id, x FROM c GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1), v AS (SELECT user_id, min(y) AS t, max(y) AS b FROM (SELECT user_id, y FROM c GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
SELECT h.user_id AS user_id, l AS "left", r AS "right", t AS top, b AS bottom FROM h JOIN v ON h.user_id = v.user_id"""
)
def content_box(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 30).alias("x"), F.hour("ts").cast("long").alias("y"))
    return selection.box_profile(cells, ["user_id"], "x", "y", 2)


@query("SELECT user_id, least(count(DISTINCT json_extract_string(props, '$.k')), 17) AS n FROM events GROUP BY user_id")
def colours_up_to_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    return selection.distinct_up_to(rows, ["user_id"], "k", 16)


@query(
    """WITH f AS (SELECT p_partkey % 50 AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 10 END AS width, CASE WHEN p_partkey % 4 <> 0 THEN 200 END AS height, CASE WHEN p_partkey % 3 = 0 THEN 'avc1' ELSE 'vp9' END AS codec, CAST(p_retailprice AS INT) AS bitrate, p_partkey AS bytes, p_partkey % 5 = 0 AS has_audio FROM part),
p AS (SELECT k, least(width, height) AS side, bytes, has_audio, row_number() OVER (PARTITION BY k, least(width, height) ORDER BY codec = 'avc1' DESC, bitrate DESC, bytes DESC) AS n FROM f WHERE width IS NOT NULL),
a AS (SELECT k, bytes, row_number() OVER (PARTITION BY k ORDER BY bitrate DESC, bytes DESC) AS n FROM f WHERE width IS NULL)
SELECT p.k AS k, side, p.bytes + CASE WHEN has_audio THEN 0 ELSE coalesce(a.bytes, 0) END AS bytes FROM p LEFT JOIN a ON a.k = p.k AND a.n = 1 WHERE p.n = 1"""
)
def sizes_by_height(spark, sf_dir):
    k, video = F.col("p_partkey"), F.col("p_partkey") % 4 != 0
    formats = table(spark, sf_dir, "part").select((k % 50).alias("k"), F.when(video, F.col("p_size") * 10).alias("width"), F.when(video, 200).alias("height"), F.when(k % 3 == 0, "avc1").otherwise("vp9").alias("codec"), F.floor("p_retailprice").cast("int").alias("bitrate"), k.alias("bytes"), (k % 5 == 0).alias("has_audio"))
    return selection.best_sizes(formats, "k")


@query("SELECT DISTINCT a, role, b FROM (SELECT l_partkey AS a, 'sells' AS role, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, 'soldBy', l_partkey FROM lineitem)")
def relations_both_ways(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lit("sells").alias("role"), F.col("l_suppkey").alias("b")).distinct()
    return selection.edges_both_ways(edges, {"sells": "soldBy"})


@query("SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase') AS oldest, date_diff('day', min(ts), min(ts) FILTER (WHERE event_type = 'purchase')) AS apart FROM events GROUP BY user_id")
def oldest_of_kind(spark, sf_dir):
    """The first row of one kind, and how far it lies from the first of all."""
    first = F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first.alias("oldest"), F.date_diff(first, F.min("ts")).cast("long").alias("apart"))


@query("SELECT user_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS pages FROM (SELECT user_id, list(CAST(json_extract_string(props, '$.k') AS INT) ORDER BY event_id) AS k FROM events GROUP BY user_id)")
def pages_once_in_order(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_distinct(listed["k"]).alias("pages"))


@query("SELECT doc_id, min(len) AS bytes, arg_min(way, len * 10 + place) AS way FROM (SELECT doc_id, unnest(['plain', 'folded', 'squeezed']) AS way, unnest([1, 2, 3]) AS place, unnest([octet_length(encode(t)), octet_length(encode(lower(t))), octet_length(encode(replace(t, ' ', '')))]) AS len FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) GROUP BY doc_id")
def smallest_encoding(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    ways = [("plain", t), ("folded", F.lower(t)), ("squeezed", F.replace(t, F.lit(" "), F.lit("")))]
    best = F.array_min(F.array(*(F.struct(F.octet_length(c).cast("long").alias("bytes"), F.lit(i).alias("place"), F.lit(n).alias("way")) for i, (n, c) in enumerate(ways))))
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.bytes", "b.way")


@query("SELECT l.doc_id AS doc_id, 2 * len(list_filter(string_split(b.text, ' '), lambda x: list_contains(string_split(coalesce(d.text, ''), ' '), x))) >= len(string_split(b.text, ' ')) AS agrees FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN benchmark b ON b.item_id = l.doc_id % 20")
def words_agree(spark, sf_dir):
    """At least half of the read words are words of the own text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("own")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    read = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.split("text", " ").alias("read"))
    both = docs.join(read, F.col("doc_id") % 20 == F.col("i"))
    return both.select("doc_id", (2 * F.size(F.filter("read", lambda w: F.array_contains("own", w))) >= F.size("read")).alias("agrees"))


@query("SELECT source, count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS chars, max(CASE lang WHEN 'en' THEN 600000 WHEN 'de' THEN 300000 ELSE 150000 END) AS budget FROM documents GROUP BY source")
def totals_and_budget(spark, sf_dir):
    """Files, their size, and the largest allowance of any of their tiers."""
    tier = F.when(F.col("lang") == "en", 600_000).when(F.col("lang") == "de", 300_000).otherwise(150_000)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.max(tier).alias("budget"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, greatest(max(ts) FILTER (WHERE event_type = 'purchase'), max(ts) FILTER (WHERE event_type = 'signup')) AS until FROM events GROUP BY ALL")
def later_of_two(spark, sf_dir):
    """The later one of two times of a day, either of which may be missing."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.greatest(last("purchase"), last("signup")).alias("until"))
