"""Structured Streaming forms of the event operators; each equals its batch form over the same events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long the counts of a window are kept after its start, in days.
KEEP_DAYS = {"minute": 1, "day": 2, "month": 40}


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _refunded(backs: list[bool], used: int, limit: int) -> tuple[list[int], int]:
    """What remains after each use or refund of one window, and the count in the end."""
    left = []
    for back in backs:
        if back:
            used = max(0, used - 1)
            left.append(limit - used)
        elif used < limit:
            used += 1
            left.append(limit - used)
        else:
            left.append(-1)
    return left, used


def admitted(events: DataFrame, limit: int, window: str = "day", late: str = "1 day", shards: int = 256) -> DataFrame:
    """events (event_id, ts, subject, kind 'consume' or 'refund') with remaining (-1 if refused), as folded by event time within each micro-batch.

    Python gets whole shards of (subject, window), as each group costs it about 10 ms whatever its size. A shard's state is one count for each
    of its windows, which goes with the shard's next events after the watermark has passed its keeping time, or with all others when it passed them all.
    Choose shards so that one's events of a micro-batch and its counts fit a worker easily; they can't be changed once a stream has begun."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    kind = dict(timed.dtypes)
    never = F.lit(-(2**63)).cast("long")  # events without a time are in a window of their own
    filled = lambda c: F.coalesce(c, F.lit(0).cast(kind[c]))  # noqa: E731  # a null would turn a shard's integers into floats
    keyed = timed.withColumn("period", F.coalesce(F.unix_millis(F.date_trunc(window, "ts")), never)).select(
        F.when(F.col("subject").isNull(), -1).otherwise(F.pmod(F.xxhash64("subject", "period"), F.lit(shards))).cast("int").alias("shard"),
        "ts", filled("subject").alias("subject"), "period", F.coalesce(F.unix_micros("ts"), never).alias("at"),
        filled("event_id").alias("event_id"), F.col("event_id").isNull().alias("unnamed"), F.coalesce(F.col("kind") == "refund", F.lit(False)).alias("back"),
    )
    keep = KEEP_DAYS[window] * 86_400_000

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        who, names = pd.factorize(rows["subject"])
        period, ids = rows["period"].to_numpy(), rows["event_id"].to_numpy()
        order = np.lexsort((pd.Series(ids).rank(method="first").to_numpy() if ids.dtype == object else ids, rows["unnamed"], rows["at"], period, who))
        who, period, back = who[order], period[order], rows["back"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (period[1:] != period[:-1])])
        size = np.diff(np.r_[first, len(rows)])
        used = {(s, p): n for s, p, n in zip(*state.get)} if state.exists else {}
        keys = list(zip(names[who[first]].tolist(), period[first].tolist()))
        before = np.array([used.get(k, 0) for k in keys])
        place = np.arange(len(rows)) - np.repeat(first - before, size)
        left = np.where(place < limit, limit - place - 1, -1)
        after = np.maximum(before, np.minimum(limit, before + size)).tolist()
        for k in np.flatnonzero(np.logical_or.reduceat(back, first)):
            at = slice(first[k], first[k] + size[k])
            left[at], after[k] = _refunded(back[at].tolist(), int(before[k]), limit)
        passed = state.getCurrentWatermarkMs()
        kept = {k: n for k, n in (used | dict(zip(keys, after))).items() if k[1] + keep > passed or k[1] + keep < 0}
        if kept:
            state.update(([k[0] for k in kept], [k[1] for k in kept], list(kept.values())))
            state.setTimeoutTimestamp(max(max(k[1] for k in kept) + keep, passed + 1))
        else:
            state.remove()
        subject = names[who] if key[0] >= 0 else np.full(len(rows), None)
        yield pd.DataFrame({"event_id": ids[order], "unnamed": rows["unnamed"].to_numpy()[order], "subject": subject, "remaining": left})

    found = keyed.groupBy("shard").applyInPandasWithState(fold, f"event_id {kind['event_id']}, unnamed boolean, subject {kind['subject']}, remaining long", f"subjects array<{kind['subject']}>, periods array<long>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.when(~F.col("unnamed"), F.col("event_id")).alias("event_id"), "subject", "remaining")


def first_of_each(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key's first event within the watermark; later ones go."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def session_counts(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("subject", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("subject", F.col("s.start").alias("start"), "n")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, into a table in memory; for tests and replays."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
