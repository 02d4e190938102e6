"""Queries over refunds, grants, pauses, caches and functions stated in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import grants
from tessera.plans.registry import query, table

_ASOF = "max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id, coalesce(date_trunc('day', spent) = date_trunc('day', ts), false) AS counts FROM (SELECT event_id, ts, event_type, {_ASOF} AS spent FROM events) WHERE event_type = 'error'")
def late_refunds(spark, sf_dir):
    """Errors refund the last purchase before them, on its day only."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").withColumn("spent", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w))
    return rows.filter("event_type = 'error'").select("event_id", grants.refund_counts(F.col("spent"), F.col("ts")).alias("counts"))


@query(
    """WITH m AS (SELECT event_id, ts, user_id, date_trunc('day', ts) AS day, CASE event_type WHEN 'click' THEN 'served' WHEN 'error' THEN 'refund' ELSE 'asked' END AS kind FROM events),
g AS (SELECT *, min(ts) OVER (PARTITION BY user_id, day) AS granted FROM m),
s AS (SELECT *, count(*) FILTER (WHERE kind = 'served') OVER w AS served FROM g WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, coalesce(bool_or(kind = 'refund' AND served = 0) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM s)
SELECT event_id, CASE kind WHEN 'refund' THEN CASE WHEN served = 0 AND NOT gone THEN 'refunded' ELSE 'kept' END WHEN 'served' THEN CASE WHEN gone THEN 'dead' WHEN served = 0 THEN 'first' ELSE 'again' END ELSE 'asked' END AS outcome FROM r"""
)
def grant_markers(spark, sf_dir):
    """Each user's day is a grant; clicks send, errors ask for a refund."""
    kind = F.when(F.col("event_type") == "click", "served").when(F.col("event_type") == "error", "refund").otherwise("asked")
    day = F.date_trunc("day", "ts")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("mark_id"), F.struct("user_id", day.alias("day")).alias("grant"), "ts", kind.alias("kind"))
    return grants.grant_outcomes(rows.withColumn("granted_at", F.min("ts").over(Window.partitionBy("grant")))).select("event_id", "outcome")


@query(
    """WITH f AS (SELECT *, (event_type IN ('error', 'view'))::INT AS failed FROM events), r AS (SELECT *, sum(1 - failed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
s AS (SELECT event_id, sum(failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS strikes FROM r) SELECT event_id, strikes, CASE WHEN strikes > 0 THEN least(300, 30 * (1 << least(strikes - 1, 20)::INT))::BIGINT ELSE 0 END AS pause FROM s"""
)
def backoff_pauses(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("call_id", F.col("event_id"))
    return grants.pauses(rows, ["user_id"], F.col("event_type").isin("error", "view")).select("event_id", "strikes", "pause")


@query("SELECT event_id, row_number() OVER (PARTITION BY date_trunc('second', ts - INTERVAL 1 SECOND * (event_id % 600)) ORDER BY ts - INTERVAL 1 SECOND * (event_id % 600), event_id) = 1 AS admitted FROM events")
def site_slots(spark, sf_dir):
    """One call a second of the whole site; events are moved together so that some meet."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), (F.col("ts") - F.make_dt_interval(secs=(F.col("event_id") % 600).cast("decimal(18,6)"))).alias("ts"))
    return grants.one_each_second(rows).select(F.col("call_id").alias("event_id"), "admitted")


@query(
    """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 900 WHEN event_id % 3 = 1 THEN 7200 ELSE 21600 END AS most, ts, max(ts) OVER () AS now FROM events) WHERE floor(epoch(now)) - floor(epoch(ts)) > most"""
)
def reaped_jobs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 3 == 0, "finished").when(F.col("event_id") % 3 == 1, "running").otherwise("referred")
    now = events.agg(F.max("ts").alias("now"))
    jobs = events.select(F.col("event_id").alias("job"), state.alias("state"), F.col("ts").alias("since")).join(F.broadcast(now))
    return grants.reaped(jobs, F.col("now")).select(F.col("job").alias("event_id"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, event_type, max(ts) OVER () AS now FROM events), f AS (SELECT user_id, max(event_id) AS v FROM e WHERE event_type = 'view' AND epoch(now) - epoch(ts) < 3600 * 6 GROUP BY 1),
b AS (SELECT user_id, max(event_id) AS v FROM e WHERE event_type = 'click' AND epoch(now) - epoch(ts) < 86400 GROUP BY 1)
SELECT coalesce(f.user_id, b.user_id) AS user_id, coalesce(f.v, b.v) AS value, CASE WHEN f.v IS NOT NULL THEN 'front' ELSE 'back' END AS layer FROM f FULL JOIN b ON f.user_id = b.user_id"""
)
def layered_cache(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    of = lambda kind, hours: events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by(F.struct(F.col("event_id").alias("value"), F.col("ts").alias("stored")), "event_id").alias("x")).select("user_id", "x.*", F.lit(hours * 3600).alias("ttl"))
    return grants.layered(of("view", 12), of("click", 24), "user_id", F.lit(now), 6 * 3600)


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 OR c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM customer"""
)
def touched_rows(spark, sf_dir):
    """New and changed rows get the time of the write."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").withColumn("updated_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    new = rows.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return grants.touched(new, rows.filter("c_custkey % 10 <> 0"), "c_custkey", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("c_custkey", "updated_at")


def _function(spark, body: str) -> str:
    """A temporary function of its own name."""
    name = f"f_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TEMPORARY FUNCTION {name}{body}")
    return name


@query("SELECT c_custkey, upper(regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g')) AS code FROM customer")
def sql_scalar_function(spark, sf_dir):
    """A function stated in SQL, which the optimizer inlines."""
    f = _function(spark, "(code STRING) RETURNS STRING RETURN upper(regexp_replace(code, '[^0-9A-Za-z]', ''))")
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"{f}(c_name)").alias("code"))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
def sql_function_over_tables(spark, sf_dir):
    """A function that reads a table, as one join for all rows."""
    view = f"v_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").createOrReplaceTempView(view)
    f = _function(spark, f"(uid BIGINT) RETURNS DOUBLE RETURN (SELECT max(o_totalprice) FROM {view} WHERE o_custkey = uid)")
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"{f}(c_custkey)").alias("best"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def sql_table_function(spark, sf_dir):
    view = f"v_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    f = _function(spark, f"(status STRING) RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM {view} WHERE o_orderstatus = status")
    return spark.sql(f"SELECT * FROM {f}('P')")


@query("SELECT doc_id, CAST(i AS INT) AS at FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents) WHERE substr(text, i, 3) = 'end'")
def end_markers(spark, sf_dir):
    """Each place of a marker in a text."""
    parts = F.split("text", "end")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda n, p: n + F.length(p) + 3) - 2)
    return table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.contains("text", F.lit("end"))).select("doc_id", F.explode(ends).alias("at"))
