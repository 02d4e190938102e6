"""Queries over events: quotas, caps, sessions, parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import usage
from tessera.operators.stash import shared_dir
from tessera.plans.registry import query, table
from tessera.streaming import usage_stream


def _quota(window: str, limit: int, where: str = "true") -> str:
    return f"""SELECT event_id, user_id, n <= {limit} AS accepted, CASE WHEN n <= {limit} THEN {limit} - n ELSE -1 END AS remaining FROM
(SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('{window}', ts) ORDER BY ts, event_id) AS n FROM events WHERE {where})"""


@query(_quota("day", 2))
def quota_daily(spark, sf_dir):
    out = usage.admitted(table(spark, sf_dir, "events"), ["user_id"], "day", 2, ["ts", "event_id"])
    return out.select("event_id", "user_id", "accepted", "remaining")


@query(" UNION ALL ".join(f"SELECT '{w}' AS period, event_id, accepted, remaining FROM ({_quota(w, n)})" for w, n in (("minute", 1), ("day", 3), ("month", 30))))
def quota_minute_month(spark, sf_dir):
    """Three windows, each for itself."""
    events = table(spark, sf_dir, "events")
    parts = [usage.admitted(events, ["user_id"], w, n, ["ts", "event_id"]).select(F.lit(w).alias("period"), "event_id", "accepted", "remaining") for w, n in (("minute", 1), ("day", 3), ("month", 30))]
    return parts[0].union(parts[1]).union(parts[2])


@query()
def quota_refunds(spark, sf_dir):
    """Errors give one use back."""
    kind = F.when(F.col("event_type") == "error", "refund").otherwise("consume")
    return usage.counters_with_refunds(table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("subject"), kind.alias("kind")), "day", 2)


@query()
def quota_multi(spark, sf_dir):
    """Day, month and minute taken together or not at all."""
    return usage.nested_claims(table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("subject")), {"day": 2, "month": 20, "minute": 1})


@query(
    """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS item, date_trunc('day', ts) AS day FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, item ORDER BY ts, event_id) = 1 AS first FROM e),
p AS (SELECT *, CASE WHEN first THEN sum(first::INT) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) END AS place FROM f),
q AS (SELECT *, min(place) OVER (PARTITION BY user_id, day, item) AS own FROM p)
SELECT event_id, CASE WHEN own > 2 THEN 'denied' WHEN first THEN 'charged' ELSE 'free' END AS outcome FROM q"""
)
def edit_first_seen(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k"))
    return usage.first_use_charged(events, "user_id", "item", 2).select("event_id", "outcome")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 3")
def frequency_cap(spark, sf_dir):
    """Each user's third event of a day that is no error."""
    w = Window.partitionBy("user_id", usage.period_start("day", F.col("ts"))).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").withColumn("n", F.row_number().over(w)).filter("n = 3").select("event_id", "user_id")


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY user_id, session"""
)
def session_gap(spark, sf_dir):
    """Sessions that end after six hours of silence."""
    runs = usage.sessions(table(spark, sf_dir, "events"), "user_id", 6 * 3600)
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_id, least(99.0, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS progress FROM events")
def progress_max(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(99.0), F.max("value").over(w)).alias("progress"))


@query("SELECT user_id, k, min(event_id) AS event_id, count(*) AS n FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'purchase') GROUP BY user_id, k")
def purchase_dedupe(spark, sf_dir):
    """One event for each purchase key, the first."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").withColumn("k", F.get_json_object("props", "$.k"))
    return bought.groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


_TYPES = ("view", "signup", "error", "click", "purchase")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def pivot_counts(spark, sf_dir):
    """Fixed columns, zeros kept."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in _TYPES))


@query(
    """SELECT event_id, least(9999, greatest(0, floor(value + 0.5)))::BIGINT AS n, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS kind,
substr(json_extract_string(props, '$.k'), 1, 100) AS k FROM events"""
)
def analytics_params(spark, sf_dir):
    """Known parameters with known values; counts between 0 and 9,999."""
    params = F.map_from_arrays(F.array(F.lit("kind"), F.lit("k")), F.array(F.col("event_type"), F.substring(F.get_json_object("props", "$.k"), 1, 100)))
    known = F.map_filter(params, lambda k, v: v.isNotNull() & ((k != "kind") | v.isin("view", "click", "purchase")))
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(9999), F.greatest(F.lit(0), F.floor(F.col("value") + 0.5))).cast("long").alias("n"), known["kind"].alias("kind"), known["k"].alias("k"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def consecutive_collapse(spark, sf_dir):
    """Runs of equal neighbours as their first row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("SELECT event_id, sha256('salt|' || user_id::VARCHAR) AS subject FROM events")
def subject_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat(F.lit("salt|"), F.col("user_id").cast("string")), 256).alias("subject"))


@query(
    """SELECT user_id, max(ts) AS last_ts, max(ts) + INTERVAL 1 MONTH AS next_month, max(ts) + INTERVAL 12 MONTH AS next_year, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d') AS shown FROM events GROUP BY user_id"""
)
def month_addition(spark, sf_dir):
    """Months keep the time of day and clamp the day."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.select("user_id", "last_ts", F.expr("last_ts + INTERVAL 1 MONTH").alias("next_month"), F.expr("last_ts + INTERVAL 12 MONTH").alias("next_year"), F.date_format(F.expr("last_ts + INTERVAL 2 HOURS"), "yyyy-MM-dd").alias("shown"))


@query("SELECT user_id, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, max(ts) OVER () AS now FROM events) WHERE back <= 20 AND ts > now - INTERVAL 7 DAY GROUP BY user_id")
def cache_snapshot(spark, sf_dir):
    """The 20 last uses of each key that are not older than seven days before the newest event."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    live = events.withColumn("back", F.row_number().over(w)).filter("back <= 20").join(F.broadcast(now), F.expr("ts > now - INTERVAL 7 DAYS"))
    return live.groupBy("user_id").agg(F.count("*").alias("kept"))


@query("SELECT event_id, CASE WHEN n <= 2 THEN 2 - n ELSE -1 END AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)")
def quota_stream(spark, sf_dir):
    """The daily quota as a stream over the events that are there now, written and read again."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    there = table(spark, sf_dir, "events")
    reader = spark.readStream.schema(there.schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        events = reader.parquet(f"{sf_dir}/events.parquet")
    else:  # a stream reads folders
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ready = events.select("event_id", "ts", F.col("user_id").alias("subject"), F.lit("consume").alias("kind"))
    out = usage_stream.admitted(ready, 2, shards=max(256, there.count() // 50_000))
    out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").select("event_id", "remaining")
