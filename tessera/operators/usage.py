"""Quotas over calendar windows: admission in batch as ranks, and as folds where refunds make order matter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_start(window: str, ts: Column) -> Column:
    """Start of the UTC minute, day or month, without a zone."""
    return F.date_trunc(window, ts).cast("timestamp_ntz")


def admitted(events: DataFrame, subject: list[str], window: str, limit: int, order: list[str]) -> DataFrame:
    """events with n (place among the window's uses), accepted and remaining (-1 if refused). A refused use is not counted,
    so without refunds the first `limit` of each window are the accepted ones."""
    w = Window.partitionBy(*subject, period_start(window, F.col("ts"))).orderBy(*order)
    n = F.row_number().over(w).cast("long")
    ok = F.col("n") <= limit
    return events.withColumn("n", n).withColumn("accepted", ok).withColumn("remaining", F.when(ok, limit - F.col("n")).otherwise(F.lit(-1)).cast("long"))


def first_use_charged(events: DataFrame, subject: str, item: str, limit: int) -> DataFrame:
    """The first use of an item in a day is charged while fewer than `limit` were; later uses of a charged item are free and
    those of a refused one stay refused: columns outcome ('charged', 'free', 'denied')."""
    day = period_start("day", F.col("ts"))
    own = Window.partitionBy(subject, "day", item).orderBy("ts", "event_id")
    marked = events.withColumn("day", day).withColumn("first", F.row_number().over(own) == 1)
    place = F.sum(F.col("first").cast("long")).over(Window.partitionBy(subject, "day").orderBy("ts", "event_id"))
    placed = marked.withColumn("place", F.when(F.col("first"), place))
    placed = placed.withColumn("place", F.min("place").over(Window.partitionBy(subject, "day", item)))
    return placed.withColumn("outcome", F.when(F.col("place") > limit, "denied").when(F.col("first"), "charged").otherwise("free"))


def counters_with_refunds(events: DataFrame, window: str, limit: int) -> DataFrame:
    """events (event_id, ts, subject, kind 'consume' or 'refund') with remaining after each: a refused use and a refund
    are not uses, a refund never goes below none, and each window starts anew. Order decides, so each subject is folded in
    order; subjects run in parallel."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        used, left = {}, []
        for period, kind in zip(rows["period"], rows["kind"]):
            have = used.get(period, 0)
            if kind == "refund":
                used[period] = max(0, have - 1)
                left.append(limit - used[period])
            elif have < limit:
                used[period] = have + 1
                left.append(limit - have - 1)
            else:
                left.append(-1)
        return rows.assign(remaining=left)[["event_id", "subject", "kind", "remaining"]]

    kinds = dict(events.dtypes)
    rows = events.withColumn("period", period_start(window, F.col("ts"))).select("event_id", "ts", "subject", "kind", "period")
    return rows.groupBy("subject").applyInPandas(fold, f"event_id {kinds['event_id']}, subject {kinds['subject']}, kind string, remaining long")


def nested_claims(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """A use takes one of each window in order (day, month, minute); if one refuses, those taken before are given back:
    events (event_id, ts, subject) with refused_by, the window that refused, or null."""
    order = [w for w in ("day", "month", "minute") if w in limits]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        used: dict[tuple, int] = {}
        out: list[str | None] = []
        for periods in zip(*(rows[w] for w in order)):
            keys = list(zip(order, periods))
            refused = next((w for w, p in keys if used.get((w, p), 0) >= limits[w]), None)
            if refused is None:
                for k in keys:
                    used[k] = used.get(k, 0) + 1
            out.append(refused)
        return rows.assign(refused_by=pd.Series(out, index=rows.index, dtype="object"))[["event_id", "subject", "refused_by"]]

    kinds = dict(events.dtypes)
    rows = events.select("event_id", "ts", "subject", *(period_start(w, F.col("ts")).alias(w) for w in order))
    return rows.groupBy("subject").applyInPandas(fold, f"event_id {kinds['event_id']}, subject {kinds['subject']}, refused_by string")


def sessions(events: DataFrame, subject: str, seconds: int) -> DataFrame:
    """Runs of a subject's events with gaps under `seconds`."""
    w = Window.partitionBy(subject).orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    new = F.when(F.coalesce(gap < seconds * 1_000_000, F.lit(False)), 0).otherwise(1)
    marked = events.withColumn("new", new)
    return marked.withColumn("session", F.sum("new").over(w).cast("long")).drop("new")


def stripped_thinking(pieces: DataFrame) -> DataFrame:
    """Text pieces (stream_id, pos, piece) joined, without what stands between <think> tags, split as they may be."""
    whole = pieces.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), "").alias("text"))
    return whole.select("stream_id", F.regexp_replace("text", r"(?s)<think>.*?(</think>|\z)", "").alias("text"))


def paced(arrivals: Iterator[float], gap: float, longest: float) -> list[float | None]:
    """Start of each request that are at least `gap` apart; null if it would wait longer than `longest`."""
    out, free = [], float("-inf")
    for t in arrivals:
        at = max(t, free)
        if at - t > longest:
            out.append(None)
        else:
            out.append(at)
            free = at + gap
    return out
