"""Queries over the star schema: entitlements, joins, variants, graph, merging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, matching, relational, variants
from tessera.plans.registry import query, table

_NOW = "TIMESTAMP '1998-01-01 00:00:00'"
# Orders stand for subscriptions and prepaid terms: the newest order of a customer by kind.
_PROFILES = f"""SELECT c_custkey AS id, max_by(CASE WHEN o_totalprice > 200000 THEN 'team' ELSE 'pro' END, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS subscription_plan,
max_by(CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'attention' ELSE 'cancelled' END, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS subscription_status,
max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS current_period_end, max_by(CASE WHEN o_totalprice > 150000 THEN 'team' ELSE 'pro' END, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 1) AS prepaid_plan,
max(o_orderdate) FILTER (o_orderkey % 2 = 1) AS paid_until, max(o_orderdate) FILTER (o_orderkey % 7 = 0) AS team_until, max(o_orderdate) FILTER (o_orderkey % 5 = 0) AS pro_until
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
_OWN = f"""WITH p AS ({_PROFILES}), r AS (SELECT *, CASE WHEN (subscription_status IN ('active', 'attention') AND current_period_end + INTERVAL 3 DAY > {_NOW}) OR (subscription_status = 'cancelled' AND current_period_end > {_NOW})
 THEN CASE subscription_plan WHEN 'team' THEN 2 ELSE 1 END ELSE 0 END AS s, CASE WHEN paid_until > {_NOW} THEN CASE prepaid_plan WHEN 'team' THEN 2 ELSE 1 END ELSE 0 END AS q, CASE WHEN team_until > {_NOW} THEN 2 WHEN pro_until > {_NOW} THEN 1 ELSE 0 END AS t FROM p),
m AS (SELECT *, greatest(s, q, t) AS r FROM r) SELECT id, CASE r WHEN 2 THEN 'team' WHEN 1 THEN 'pro' ELSE 'free' END AS plan,
CASE WHEN r = 0 THEN NULL WHEN s = r THEN 'subscription' WHEN q = r THEN 'prepaid' ELSE 'tester' END AS source FROM m"""


def _now(spark, sf_dir) -> object:
    return F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")


def _profiles(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    when, even, odd = F.struct("o_orderdate", "o_orderkey"), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1
    newest = lambda cond, v: F.max_by(F.when(cond, v), F.when(cond, when))
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "attention").otherwise("cancelled")
    rows = o.groupBy(F.col("o_custkey").alias("id")).agg(
        newest(even, F.when(F.col("o_totalprice") > 200000, "team").otherwise("pro")).alias("subscription_plan"), newest(even, status).alias("subscription_status"), F.max(F.when(even, F.col("o_orderdate"))).alias("current_period_end"),
        newest(odd, F.when(F.col("o_totalprice") > 150000, "team").otherwise("pro")).alias("prepaid_plan"), F.max(F.when(odd, F.col("o_orderdate"))).alias("paid_until"),
        F.max(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate"))).alias("team_until"), F.max(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate"))).alias("pro_until"),
    )
    return c.join(rows, "id", "left")


@query(_OWN)
def entitlement_asof(spark, sf_dir):
    return relational.own_plans(_profiles(spark, sf_dir), _now(spark, sf_dir)).select("id", "plan", "source")


@query(
    f"""WITH own AS ({_OWN}), seats AS (SELECT c_custkey AS owner_id, lower(replace(c_name, '#', '')) || (c_custkey % 50) AS email FROM customer),
users AS (SELECT c_custkey AS id, upper(replace(c_name, '#', '')) || (c_custkey * 7 % 50) AS email, c_acctbal > 0 AS confirmed FROM customer)
SELECT u.id, CASE WHEN u.confirmed AND EXISTS (SELECT 1 FROM seats s JOIN own o ON o.id = s.owner_id AND o.plan = 'team' WHERE s.email = lower(u.email) AND s.owner_id <> u.id) THEN 'team' ELSE own.plan END AS plan FROM users u JOIN own ON own.id = u.id"""
)
def team_seat_semi(spark, sf_dir):
    c, name = table(spark, sf_dir, "customer"), F.replace("c_name", F.lit("#"), F.lit(""))
    plans = relational.own_plans(_profiles(spark, sf_dir), _now(spark, sf_dir)).select("id", "plan")
    seats = c.select(F.col("c_custkey").alias("owner_id"), F.concat(F.lower(name), (F.col("c_custkey") % 50).cast("string")).alias("email"))
    users = c.select(F.col("c_custkey").alias("id"), F.concat(F.upper(name), (F.col("c_custkey") * 7 % 50).cast("string")).alias("email"), F.when(F.col("c_acctbal") > 0, F.lit(1)).alias("email_confirmed_at"))
    return relational.effective_plans(users, plans, seats)


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'revoked' WHEN o_orderdate <= {_NOW} - INTERVAL 1000 DAY THEN 'expired' WHEN o_orderkey % 7 >= 5 THEN 'used up' ELSE 'active' END AS status, greatest(0, 5 - o_orderkey % 7)::BIGINT AS remaining FROM orders"""
)
def code_status_case(spark, sf_dir):
    codes = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("revoked_at"), F.expr("o_orderdate + INTERVAL 1000 DAYS").alias("expires_at"), (F.col("o_orderkey") % 7).alias("uses"), F.lit(5).cast("long").alias("max_uses"))
    return relational.code_status(codes, _now(spark, sf_dir)).select("o_orderkey", "status", F.col("remaining").cast("long").alias("remaining"))


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderdate, o_orderkey), '') AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def listagg_scalar(spark, sf_dir):
    """An ordered list of each customer's orders, as a left join on a grouped list."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string")), ", ").alias("orders"), F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit("")).alias("orders"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT DISTINCT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def in_subquery_semi(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query(
    """SELECT 'customer without orders' AS finding, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT 'order without lines', o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT 'line of an unknown part', l_orderkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
UNION ALL SELECT 'negative balance', c_custkey FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'empty document', doc_id FROM documents WHERE text IS NULL OR text = ''"""
)
def audit_union(spark, sf_dir):
    """What is out of order, from all tables."""
    c, o, line, p, d = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "part", "documents"))
    named = lambda df, what, key: df.select(F.lit(what).alias("finding"), F.col(key).alias("id"))
    parts = [
        named(c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "customer without orders", "c_custkey"),
        named(o.join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "order without lines", "o_orderkey"),
        named(line.join(p, F.col("p_partkey") == F.col("l_partkey"), "left_anti"), "line of an unknown part", "l_orderkey"),
        named(c.filter("c_acctbal < 0"), "negative balance", "c_custkey"),
        named(d.filter("text IS NULL OR text = ''"), "empty document", "doc_id"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


@query("SELECT l_orderkey, coalesce(max(l_quantity) FILTER (l_quantity <= 24), min(l_quantity)) AS chosen FROM lineitem GROUP BY l_orderkey")
def floor_lookup(spark, sf_dir):
    return variants.floor_lookup(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", F.lit(24.0))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_extendedprice DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def group_argmax(spark, sf_dir):
    """The best line of each order."""
    order = [(F.col("l_returnflag") == "R").cast("int"), F.col("l_extendedprice"), F.col("l_linenumber")]
    return variants.best_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, ["l_linenumber", "l_partkey"])


@query("SELECT l_orderkey, p.l_linenumber, s.size_band FROM lineitem p JOIN (SELECT * FROM (VALUES (1, 10, 'small'), (11, 30, 'medium'), (26, 50, 'large')) v(a, b, size_band)) s ON p.l_quantity BETWEEN s.a AND s.b")
def range_join_pages(spark, sf_dir):
    """Intervals and points; the intervals are three constants."""
    spans = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("size_band")) for a, b, n in ((1, 10, "small"), (11, 30, "medium"), (26, 50, "large"))))))
    return table(spark, sf_dir, "lineitem").join(F.broadcast(spans), F.col("l_quantity").between(F.col("a"), F.col("b"))).select("l_orderkey", "l_linenumber", "size_band")


@query("SELECT l_orderkey, l_linenumber, o_orderkey AS last_order FROM (SELECT l.*, o_custkey AS cust FROM lineitem l JOIN orders ON o_orderkey = l_orderkey) l ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON o.o_custkey = l.cust AND o.o_orderdate <= l.l_shipdate")
def asof_price(spark, sf_dir):
    """For each line the customer's last order up to its shipping date: both sides in one sorted union, no range join."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = line.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("cust"), F.col("l_shipdate").alias("at"), F.lit(1).alias("side"), "l_orderkey", "l_linenumber", F.lit(None).cast("long").alias("o_orderkey"))
    right = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), "o_orderkey")
    w = Window.partitionBy("cust").orderBy("at", "side", F.col("o_orderkey").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return left.union(right).withColumn("last_order", F.last("o_orderkey", ignorenulls=True).over(w)).filter("side = 1").select("l_orderkey", "l_linenumber", "last_order")


@query("SELECT p_partkey, floor(p_retailprice * 18.5 * 100 + 0.5) / 100 AS converted, regexp_replace(floor(p_retailprice * 1000)::BIGINT::VARCHAR, '(\\d)(\\d{3})$', '\\1' || chr(160) || '\\2') AS short FROM part".replace("\\\\", "\\"))
def price_format(spark, sf_dir):
    """Half-up rounding to cents; the last three digits set off."""
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", T.half_up(p * 18.5, 2).alias("converted"), F.regexp_replace(F.floor(p * 1000).cast("string"), r"(\d)(\d{3})$", "$1 $2").alias("short"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 2) % 400 AS dst FROM part UNION SELECT p_partkey, (p_partkey * 3 + 1) % 400 FROM part),
r(id) AS (SELECT 1::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r"""
)
def closure_reach(spark, sf_dir):
    """All that node 1 leads to in a graph with cycles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    edges = p.select("src", (F.col("src") * 2 % 400).alias("dst")).union(p.select("src", ((F.col("src") * 3 + 1) % 400).alias("dst"))).distinct()
    roots = spark.range(1).select(F.lit(0).alias("root"), F.lit(1).cast("long").alias("id"))
    return graph.reachable(edges, roots).select("id")


@query(
    """WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 10 END AS v FROM nation WHERE n_nationkey < 15), b AS (SELECT n_nationkey AS k, n_nationkey * 100 AS v FROM nation WHERE n_nationkey >= 8)
SELECT a.k, coalesce(a.v, b.v) AS v, 'first' AS origin FROM a LEFT JOIN b USING (k) UNION ALL SELECT k, v, 'extra' FROM b WHERE k NOT IN (SELECT k FROM a)"""
)
def rank_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.filter("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 10).alias("v"))
    b = n.filter("n_nationkey >= 8").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 100).alias("v"))
    return relational.merged(a, b, ["k"], ["v"])


_KEY = r"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({0})), '&', ' and ', 'g'), '[''’‘`´.]', '', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(
    f"""WITH k AS (SELECT s_suppkey AS id, {_KEY.format("'Supplier ' || (s_suppkey * 7919 % 9973)")} AS key FROM supplier),
g AS (SELECT id, key, substr(key, u.i, 2) AS g, count(*) AS n FROM k, unnest(range(1, length(key))) AS u(i) GROUP BY ALL), s AS (SELECT id, sum(n) AS m FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT p.a, p.b, 2.0 * p.shared / (x.m + y.m) AS likeness FROM p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b WHERE 2.0 * p.shared / (x.m + y.m) >= 0.9"""
)
def name_likeness(spark, sf_dir):
    """Pairs of names that are alike by 0.9 or more, found through their rarest shared character pairs."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Supplier "), (F.col("s_suppkey") * 7919 % 9973).cast("string")).alias("name"))
    return matching.dice_pairs(rows, "s_suppkey", "name", 0.9)


@query(
    """WITH k AS (SELECT DISTINCT p_name FROM part), m AS (SELECT p_name, p_brand, p_type, p_retailprice, p_partkey, (p_size % 3 = 0) AS variant, p_size FROM part),
r AS (SELECT p_brand AS query, p_type AS grp, p_partkey, variant, p_size, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY variant, p_size, p_retailprice DESC, p_partkey) AS r, max(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS best, min(variant::INT) OVER (PARTITION BY p_brand, p_type) AS alone FROM m)
SELECT query, p_partkey, place FROM (SELECT query, p_partkey, row_number() OVER (PARTITION BY query ORDER BY floor(best / 10000 * CASE WHEN alone = 1 THEN 0.85 ELSE 1.0 END * 1000 + 0.5) / 1000 DESC, best DESC, p_partkey) AS place FROM r WHERE r = 1) WHERE place <= 5"""
)
def candidate_groups(spark, sf_dir):
    """Parts of a brand as hits, types as songs."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("pos"), F.lit("x").alias("artist"), F.col("p_type").alias("title"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("date"), F.lit(0).alias("releases"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 3 == 0).alias("variant"), (F.col("p_retailprice") / 10000).alias("match"))
    # the main hit of a group is its earliest; equal dates go by position
    return matching.grouped_candidates(p).select("query", F.col("pos").alias("p_partkey"), F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, list_filter(['bad status', 'bad priority', 'free'], lambda x, i: [o_orderstatus NOT IN ('O', 'F'), NOT regexp_matches(o_orderpriority, '^[1-3]-'), o_totalprice <= 0][i]) AS broken FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR NOT regexp_matches(o_orderpriority, '^[1-3]-') OR o_totalprice <= 0")
def check_violations(spark, sf_dir):
    checks = {"bad status": F.col("o_orderstatus").isin("O", "F"), "bad priority": F.col("o_orderpriority").rlike("^[1-3]-"), "free": F.col("o_totalprice") > 0}
    return relational.violations(table(spark, sf_dir, "orders"), checks).select("o_orderkey", "broken")
