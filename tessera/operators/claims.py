"""Claims that need a place in each subject's windows and one in the whole site's day.

Two orders meet here: each subject's own events, and the site's. Neither can be folded alone, as a claim that the site refuses leaves the
subject's windows as they were. They are solved in turns: every subject is folded as if the site refused what it refused in the turn before,
then the site's day is counted over what all subjects ask of it. If a turn is right up to some moment, the next one is right beyond it,
so turns settle, and the only settled state is that of one fold over everything in order.

No task holds the site: its uses lie in ranges of time, and a range is summed up as one function of the count before it,
x -> min(high, max(low, x + step)), because taking a place while there is one and giving one back while there is one are such functions and so are their chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stash import Stash
from tessera.operators.usage import period_start

_FAR = 1 << 62


class _Own:
    """The counts of one subject. Only windows that are still open are kept, and of claims those that may be given back."""

    def __init__(self, day: int, month: int | None, minute: int, unanswered: int):
        self.limits = {"day": day, "month": month, "minute": minute, "unanswered": unanswered}
        self.counts: dict[str, tuple[object, int]] = {}
        self.taken: set = set()

    def _used(self, window: str, period: object) -> int:
        at, n = self.counts.get(window, (None, 0))
        return n if at == period else 0

    def _add(self, window: str, period: object, by: int) -> None:
        self.counts[window] = period, max(0, self._used(window, period) + by)

    def event(self, kind: str, event_id: object, claim_id: object, busy: bool, periods: dict[str, object]) -> tuple[str, int | None, int]:
        """(outcome, remaining, what it asks of the site)."""
        windows = [w for w in ("day", "month", "minute") if self.limits[w] is not None]
        if kind == "claim":
            full = next((w for w in windows if self._used(w, periods[w]) >= self.limits[w]), None)
            if full or busy:
                return full or "site", None, 0 if full else 1
            for w in windows:
                self._add(w, periods[w], 1)
            self.taken.add(event_id)
            return "ok", min(self.limits[w] - self._used(w, periods[w]) for w in windows if w != "minute"), 1
        if claim_id not in self.taken:
            return "nothing", None, 0
        self.taken.discard(claim_id)
        if kind != "unsent":
            if self._used("unanswered", periods["day"]) >= self.limits["unanswered"]:
                return "kept", None, 0
            self._add("unanswered", periods["day"], 1)
        for w in windows:
            if w != "minute":
                self._add(w, periods[w], -1)
        return "given back", None, -1 if kind == "unsent" else 0


def _subjects(rows: DataFrame, limits: tuple) -> DataFrame:
    """rows (subject, ts, event_id, kind, claim_id, busy, day, month, minute) with outcome, remaining and site."""
    columns = ["subject", "ts", "event_id", "kind", "claim_id", "busy", "day", "month", "minute"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, who = None, object()
        for b in batches:
            out = []
            for subject, _, event_id, kind, claim_id, busy, day, month, minute in zip(*(b.column(c).to_pylist() for c in columns)):
                if own is None or subject != who:
                    own, who = _Own(*limits), subject
                out.append(own.event(kind, event_id, claim_id, bool(busy), {"day": day, "month": month, "minute": minute}))
            outcome, remaining, site = zip(*out) if out else ((), (), ())
            made = [pa.array(outcome, pa.string()), pa.array(remaining, pa.int64()), pa.array(site, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("event_id", "subject", "ts")), *made], ["event_id", "subject", "ts", "outcome", "remaining", "site"])

    kinds = dict(rows.dtypes)
    ordered = rows.select(*columns).repartition("subject").sortWithinPartitions("subject", "ts", "event_id")
    return ordered.mapInArrow(run, f"event_id {kinds['event_id']}, subject {kinds['subject']}, ts {kinds['ts']}, outcome string, remaining long, site int")


def _refused(asked: DataFrame, limit: int, stash: Stash) -> DataFrame:
    """asked (event_id, ts, site: 1 takes a place, -1 gives one back) to the event_id of the claims that meet a full day."""
    ranges = asked.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    ranges = stash.put(ranges.withColumn("part", F.spark_partition_id()).withColumn("day", F.unix_date(F.to_date("ts"))), "asked")
    in_order = ranges.select("part", "day", "ts", "event_id", "site").repartition("part").sortWithinPartitions("part", "ts", "event_id")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, high, step, done = None, -_FAR, _FAR, 0, []
        for b in batches:
            for now, site in zip(zip(b.column("part").to_pylist(), b.column("day").to_pylist()), b.column("site").to_pylist()):
                if now != key:
                    done += [(*key, low, high, step)] if key else []
                    key, low, high, step = now, -_FAR, _FAR, 0
                low, high = (min(low + 1, limit), min(high + 1, limit)) if site > 0 else (max(low - 1, 0), max(high - 1, 0))
                step += site
        done += [(*key, low, high, step)] if key else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)] if done else [pa.array([], pa.int64())] * 5, ["part", "day", "low", "high", "step"])

    starts, count = {}, {}
    for part, day, low, high, step in in_order.mapInArrow(summed, "part long, day long, low long, high long, step long").orderBy("day", "part").toLocalIterator():  # one row for each range and day in it
        starts[part, day] = count.get(day, 0)
        count[day] = min(high, max(low, starts[part, day] + step))
    shared = ranges.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for b in batches:
            full = []
            for now, site in zip(zip(b.column("part").to_pylist(), b.column("day").to_pylist()), b.column("site").to_pylist()):
                if now != key:
                    key, n = now, shared.value[now]
                full.append(site > 0 and n >= limit)
                n = min(n + 1, limit) if site > 0 else max(n - 1, 0)
            yield pa.RecordBatch.from_arrays([b.column("event_id")], ["event_id"]).filter(pa.array(full, pa.bool_()))

    return in_order.mapInArrow(run, f"event_id {dict(asked.dtypes)['event_id']}")


def site_claims(events: DataFrame, day: int, month: int | None, minute: int, site: int, unanswered: int) -> DataFrame:
    """events (event_id, ts, subject, kind, claim_id) with outcome and remaining (of a claim that is accepted: what is left of the
    day or month, whichever is less).

    A 'claim' takes one of the subject's day, month (no limit if null) and minute and one of the site's day, or nothing: outcome 'ok', or the first
    window that is full ('day', 'month', 'minute', 'site'). A 'refund' of claim_id gives the subject's day and month back, but only `unanswered`
    times a day, else it is 'kept'; the site's place and the minute stay taken. 'unsent' gives the site's place back too and is not limited.
    What is given back belongs to the windows of the moment it is given back in, and never below none. A claim can be given back once; of a claim that was not
    accepted, belongs to someone else or comes later there is 'nothing' to give back. Events of one moment go by event_id.

    Null kinds and subjects count as a refund of claim_id and as one more subject; an empty table gives no rows."""
    stash = Stash(events.sparkSession)
    kinds = dict(events.dtypes)
    moment = F.col("ts").cast("timestamp_ntz")
    base = events.select("event_id", moment.alias("ts"), "subject", F.coalesce("kind", F.lit("refund")).alias("kind"), F.col("claim_id").cast(kinds["event_id"]).alias("claim_id"), *(period_start(w, moment).alias(w) for w in ("day", "month", "minute")))
    base = stash.put(base, "events")
    busy, mark = None, None
    while True:
        rows = base.withColumn("busy", F.lit(False)) if busy is None else base.join(busy.withColumn("busy", F.lit(True)), "event_id", "left")
        out = stash.put(_subjects(rows, (day, month, minute, unanswered)), "subjects")
        found = stash.put(_refused(out.filter("site <> 0").select("event_id", "ts", "site"), site, stash), "refused")
        now = found.agg(F.count("*"), F.sum(F.xxhash64("event_id").cast("decimal(38,0)"))).first()
        if now == mark or (busy is None and not now[0]):
            return out.select("event_id", "subject", "outcome", "remaining")
        stash.drop(out, *([busy] if busy is not None else []))
        busy, mark = found, now
