"""Keyed state with lists, maps, timers and time to live: event order restored, tags over chunks, claims that may be released.

State lives in RocksDB (`stateful` sets the provider for the time that a query needs to start) and in the query's checkpoint,
so a restart or a lost executor goes on where the last finished micro-batch was.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

# State in RocksDB; without checksum files, whose writers wait for each other when all tasks of an executor write their first snapshots at once.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}
_EPOCH = dt.datetime(1970, 1, 1)

#: How long the count of a window is kept after its start, in seconds.
KEEP = {"minute": 3_600, "day": 2 * 86_400, "month": 40 * 86_400}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting is put back."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _time_mode(keep_ms: int | None) -> str:
    return "None" if keep_ms is None else "ProcessingTime"


def _start(window: str, second: int) -> int:
    """Start of the UTC minute, day or month, in seconds."""
    if window != "month":
        return second - second % {"minute": 60, "day": 86_400}[window]
    t = _EPOCH + dt.timedelta(seconds=second)
    return int((dt.datetime(t.year, t.month, 1) - _EPOCH).total_seconds())


class _OrderedClaims(StatefulProcessor):
    """Events wait in a list until the watermark has passed them, and are then folded in the order of their time; so the outcome does not
    depend on how they arrived. Counts are a map by window and start, of which finished windows leave with a timer."""

    def __init__(self, limits: dict[str, int]):
        self.limits = {w: limits[w] for w in ("day", "month", "minute") if w in limits}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, event_id long")
        self.counts = handle.getMapState("counts", "window string, start long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.appendValue((r.micros, r.event_id))
            self.handle.registerTimer(r.micros // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready = [x for x in held if x[0] // 1000 < passed]
        if ready:
            if len(ready) < len(held):
                self.waiting.put(held[len(ready) :])
            else:
                self.waiting.clear()
            for micros, event_id in ready:
                yield Row(event_id=event_id, subject=key[0], refused_by=self._claim(micros // 1_000_000))
        if expiredTimerInfo.getExpiryTimeInMs() % 60_000 == 0 and self.counts.exists():  # a timer that ends windows
            for window, start in [tuple(k) for k in self.counts.keys()]:
                if (start + KEEP[window]) * 1000 <= passed:
                    self.counts.removeKey((window, start))

    def _claim(self, second: int) -> str | None:
        at = [(w, _start(w, second)) for w in self.limits]
        used = [self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0 for k in at]
        refused = next((w for (w, _), n in zip(at, used) if n >= self.limits[w]), None)
        if refused is None:
            for (w, start), n in zip(at, used):
                self.counts.updateValue((w, start), (n + 1,))
                self.handle.registerTimer((start + KEEP[w]) * 1000)
        return refused

    def close(self) -> None:
        pass


def ordered_claims(events: DataFrame, limits: dict[str, int], late: str) -> DataFrame:
    """A stream of events (event_id long, ts, subject) to event_id, subject, refused_by, as `usage.nested_claims` has them over the same events.
    They come out once the watermark, `late` behind the newest event, has passed them; what comes later than that is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("ts", "subject", F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy("subject").transformWithState(_OrderedClaims(limits), f"event_id long, subject {dict(events.dtypes)['subject']}, refused_by string", "append", "EventTime")


class _TagFilter(StatefulProcessor):
    """Pieces of a text, of which what stands between two tags goes. State: where the text stands (the next piece, inside or not, and the end of
    what was read, if it may be the beginning of a tag) and the pieces that came too early."""

    def __init__(self, opening: str, closing: str, keep_ms: int | None):
        self.tags, self.keep_ms = (opening, closing), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, inside boolean, held string", self.keep_ms)
        self.early = handle.getMapState("early", "pos long", "piece string, last boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at, inside, held = self.place.get() if self.place.exists() else (0, False, "")
        here = {r.pos: (r.piece or "", bool(r.last)) for r in rows}
        for pos in [p for p in here if p < at]:  # sent again
            del here[pos]
        while True:
            if at in here:
                piece, last = here.pop(at)
            elif self.early.exists() and self.early.containsKey((at,)):
                piece, last = self.early.getValue((at,))
                self.early.removeKey((at,))
            else:
                break
            text, inside, held = _outside(held + piece, inside, self.tags)
            if last and not inside:
                text, held = text + held, ""
            yield Row(stream_id=key[0], pos=at, text=text)
            at += 1
        for pos, value in here.items():
            self.early.updateValue((pos,), value)
        self.place.update((at, inside, held))

    def close(self) -> None:
        pass


def _outside(text: str, inside: bool, tags: tuple[str, str]) -> tuple[str, bool, str]:
    """What of the text stands outside of tags; whether it ends inside; its end, where that may begin a tag."""
    out = []
    while True:
        before, tag, after = text.partition(tags[inside])
        if not tag:
            break
        if not inside:
            out.append(before)
        text, inside = after, not inside
    begun = next((n for n in range(min(len(text), len(tags[inside]) - 1), 0, -1) if tags[inside].startswith(text[-n:])), 0)
    if not inside:
        out.append(text[: len(text) - begun])
    return "".join(out), inside, text[len(text) - begun :]


def without_tags(pieces: DataFrame, opening: str = "<think>", closing: str = "</think>", keep_ms: int | None = None) -> DataFrame:
    """A stream of pieces (stream_id, pos from 0, piece, last) to stream_id, pos and the text that the piece lets out, in order; tags
    may be split over pieces and pieces may come in any order or twice. With keep_ms a text that is
    silent for so long is forgotten; time then goes on without data, so that such a query runs until it is stopped, whatever its trigger."""
    rows = pieces.select("stream_id", F.col("pos").cast("long").alias("pos"), "piece", "last")
    return rows.groupBy("stream_id").transformWithState(_TagFilter(opening, closing, keep_ms), f"stream_id {dict(pieces.dtypes)['stream_id']}, pos long, text string", "append", _time_mode(keep_ms))


class _KeyClaims(StatefulProcessor):
    """The first claim of a key is applied, later ones are duplicates, until the key is released after a failure."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "event_id long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = holder = self.holder.get()[0] if self.holder.exists() else None
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            if r.kind == "claim":
                outcome = "applied" if holder is None else "duplicate"
                holder = r.event_id if holder is None else holder
            else:
                outcome = "nothing" if holder is None else "released"
                holder = None
            yield Row(event_id=r.event_id, key=key[0], outcome=outcome)
        if holder is None:
            self.holder.clear()
        elif holder != before:
            self.holder.update((holder,))

    def close(self) -> None:
        pass


def key_claims(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of events (event_id long, ts, key, kind 'claim' or 'failed') to event_id, key and outcome: 'applied', 'duplicate', 'released' or 'nothing'.
    Events of one key are taken in order of their time within a micro-batch. With keep_ms a claim is forgotten so long after it was made (see without_tags)."""
    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "key", "kind")
    return rows.groupBy("key").transformWithState(_KeyClaims(keep_ms), f"event_id long, key {dict(events.dtypes)['key']}, outcome string", "append", _time_mode(keep_ms))


def key_claims_batch(events: DataFrame) -> DataFrame:
    """The same over a table. Releases cut a key's events into rounds; the first claim of a round is applied."""
    over = "PARTITION BY key ORDER BY ts, event_id"
    rounds = events.withColumn("round", F.expr(f"coalesce(sum(CAST(kind <> 'claim' AS INT)) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    place = F.expr("row_number() OVER (PARTITION BY key, round ORDER BY ts, event_id)")
    outcome = F.when(F.col("kind") == "claim", F.when(place == 1, "applied").otherwise("duplicate")).when(place > 1, "released").otherwise("nothing")
    return rounds.select("event_id", "key", outcome.alias("outcome"))


def written_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """For foreachBatch: each micro-batch has a folder of its own, written anew if it is run again, so that nothing is in the table twice or
    by half; no earlier batch is read."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
