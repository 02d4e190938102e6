"""Refunds, grants, pauses and time to live: rules over what came before, stated as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.usage import period_start


def refund_counts(spent_at: Column, now: Column) -> Column:
    """A refund counts only on the UTC day of what it refunds; at midnight that day's allowance is gone."""
    return F.coalesce(period_start("day", spent_at) == period_start("day", now), F.lit(False))


def grant_outcomes(marks: DataFrame) -> DataFrame:
    """marks (mark_id, grant, ts, granted_at, kind 'asked', 'served' or 'refund') with outcome. The first refund that no serve went before, on the
    grant's day, is 'refunded', any other 'kept'; a serve after it is 'dead', the first one before it 'first', others 'again'; an ask is 'asked'."""
    w = Window.partitionBy("grant").orderBy("ts", "mark_id").rowsBetween(Window.unboundedPreceding, -1)
    served, able = F.col("kind") == "served", (F.col("kind") == "refund") & refund_counts(F.col("granted_at"), F.col("ts"))
    seen = marks.withColumn("__served", F.coalesce(F.sum(served.cast("int")).over(w), F.lit(0)))
    could = able & (F.col("__served") == 0)
    seen = seen.withColumn("__could", could).withColumn("__gone", F.coalesce(F.max(F.col("__could").cast("int")).over(w), F.lit(0)) == 1)
    outcome = (
        F.when(F.col("kind") == "refund", F.when(F.col("__could") & ~F.col("__gone"), "refunded").otherwise("kept"))
        .when(served, F.when(F.col("__gone"), "dead").when(F.col("__served") == 0, "first").otherwise("again"))
        .otherwise("asked")
    )
    return seen.withColumn("outcome", outcome).drop("__served", "__could", "__gone")


def pauses(calls: DataFrame, key: list[str], failed: Column, first: int = 30, most: int = 300) -> DataFrame:
    """calls (..., ts, call_id) with strikes and pause: failures in a row so far, and the seconds to wait after the call, twice as many
    for each failure, up to the most; a success ends the row."""
    w = Window.partitionBy(*key).orderBy("ts", "call_id")
    rows = calls.withColumn("__failed", failed.cast("int")).withColumn("__row", F.sum(1 - F.col("__failed")).over(w))
    strikes = F.sum("__failed").over(Window.partitionBy(*key, "__row").orderBy("ts", "call_id"))
    rows = rows.withColumn("strikes", strikes.cast("long")).drop("__row", "__failed")
    doubled = F.least(F.lit(most), F.lit(first) * F.call_function("shiftleft", F.lit(1), F.least(F.col("strikes") - 1, F.lit(20)).cast("int")))
    return rows.withColumn("pause", F.when(F.col("strikes") > 0, doubled).otherwise(0).cast("long"))


def one_each_second(calls: DataFrame) -> DataFrame:
    """calls (ts, call_id) with admitted: the first call of each second of the whole site."""
    firsts = calls.groupBy(F.date_trunc("second", "ts").alias("__s")).agg(F.min(F.struct("ts", "call_id")).alias("__first"))
    joined = calls.withColumn("__s", F.date_trunc("second", "ts")).join(firsts, "__s")
    return joined.withColumn("admitted", F.col("call_id") == F.col("__first.call_id")).drop("__s", "__first")


def reaped(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (job, state, since) that go: finished for 15 minutes, running for 2 hours, or only referred to for 6 hours."""
    most = F.create_map(*(F.lit(x) for pair in (("finished", 15 * 60), ("running", 2 * 3600), ("referred", 6 * 3600)) for x in pair))
    return jobs.filter(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) > most[F.col("state")])


def layered(front: DataFrame, back: DataFrame, key: str, now: Column, front_seconds: int = 3600) -> DataFrame:
    """Lookups through two caches (key, value, stored, ttl in seconds): the front one holds what it has for its own time at most; the answer and where it is from."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("stored").cast("timestamp"))
    live_front = front.filter(age < F.least(F.col("ttl"), F.lit(front_seconds))).select(key, F.col("value").alias("__f"))
    live_back = back.filter(age < F.col("ttl")).select(key, F.col("value").alias("__b"))
    both = live_front.join(live_back, key, "full")
    return both.select(key, F.coalesce("__f", "__b").alias("value"), F.when(F.col("__f").isNotNull(), "front").otherwise("back").alias("layer"))


def paced_requests(requests: DataFrame, owner: str, gap: float, longest: float) -> DataFrame:
    """requests (owner, request_id, at in seconds) with start: at least `gap` after the one before of the owner; null if it would wait longer than `longest`."""
    import pandas as pd

    from tessera.operators.usage import paced

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "request_id"])
        return rows.assign(start=paced(rows["at"], gap, longest))

    kinds = dict(requests.dtypes)
    return requests.select(owner, "request_id", "at").groupBy(owner).applyInPandas(fold, f"{owner} {kinds[owner]}, request_id {kinds['request_id']}, at double, start double")


def touched(new: DataFrame, old: DataFrame, key: str, now: Column) -> DataFrame:
    """What a write leaves in updated_at: the time of the write for rows that are new or differ from what was there, and the old time otherwise."""
    values = [c for c in new.columns if c not in (key, "updated_at")]
    was = old.select(F.col(key).alias("__key"), F.struct(*values).alias("__was"), F.col("updated_at").alias("__at"))
    same = F.struct(*values).eqNullSafe(F.col("__was"))
    return new.drop("updated_at").join(was, F.col(key) == F.col("__key"), "left").withColumn("updated_at", F.when(same, F.col("__at")).otherwise(now)).select(*new.columns)
