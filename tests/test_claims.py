import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import claims
from tessera.plans import reading_queries

SCHEMA = "event_id long, ts timestamp_ntz, subject string, kind string, claim_id long"


def one_fold(events, day, month, minute, site, unanswered):
    """Every event in order, with all counts in one place."""
    count, accepted, gone, out = {}, {}, set(), []

    def used(*key):
        return count.get(key, 0)

    for event_id, ts, subject, kind, claim_id in sorted(events, key=lambda e: (e[1], e[0])):
        d, m, mi = ts.date(), (ts.year, ts.month), ts.replace(second=0, microsecond=0)
        keys = [("day", subject, d, day), ("month", subject, m, month), ("minute", subject, mi, minute), ("site", "", d, site)]
        keys = [k for k in keys if k[3] is not None]
        if kind == "claim":
            full = next((k[0] for k in keys if used(*k[:3]) >= k[3]), None)
            if full is None:
                for k in keys:
                    count[k[:3]] = used(*k[:3]) + 1
                accepted[event_id] = subject
            left = min(k[3] - used(*k[:3]) for k in keys if k[0] in ("day", "month"))
            out.append((event_id, subject, full or "ok", left if full is None else None))
            continue
        outcome = "nothing"
        if accepted.get(claim_id) == subject and claim_id not in gone:
            gone.add(claim_id)
            if kind == "refund" and used("unanswered", subject, d) >= unanswered:
                outcome = "kept"
            else:
                outcome = "given back"
                if kind == "refund":
                    count["unanswered", subject, d] = used("unanswered", subject, d) + 1
                for k in keys:
                    if k[0] in ("day", "month") or k[0] == "site" and kind == "unsent":
                        count[k[:3]] = max(0, used(*k[:3]) - 1)
        out.append((event_id, subject, outcome, None))
    return sorted(out)


def made(seed, n, subjects, days):
    rng, events, began = random.Random(seed), [], dt.datetime(2024, 1, 30)
    for i in range(n):
        ts = began + dt.timedelta(seconds=rng.randrange(days * 86_400) // 20 * 20)
        events.append((i, ts, f"s{min(rng.randrange(subjects), rng.randrange(subjects))}", rng.choice(["claim"] * 5 + ["refund", "unsent"]), None))
    events.sort(key=lambda e: (e[1], e[0]))
    last, out = {}, []
    for i, ts, subject, kind, _ in events:
        if kind == "claim":
            last.setdefault(subject, []).append(i)
        own = last.get(subject, [])
        claim = None if kind == "claim" or not own else rng.choice(own[-3:] if rng.random() < 0.9 else last[rng.choice(list(last))])
        out.append((i, ts, subject, kind, claim))
    return out


@pytest.mark.parametrize(("seed", "limits"), [(1, (3, 12, 1, 25, 1)), (2, (50, None, 3, 7, 0)), (3, (2, 4, 9, 1000, 2))])
def test_claims_equal_one_fold_over_everything(spark, seed, limits):
    events = made(seed, 900, 12, 4)
    want = one_fold(events, *limits)
    got = claims.site_claims(spark.createDataFrame(events, SCHEMA).repartition(3), *limits).collect()
    assert sorted(tuple(r) for r in got) == want
    assert len({r[2] for r in want}) >= 5


def test_claims_at_one_moment_and_odd_rows(spark):
    t = dt.datetime(2024, 3, 1)
    events = [(i, t, "a", "claim", None) for i in range(4)] + [(9, t, None, "claim", None), (10, t, None, None, 9), (11, t, "a", "refund", None), (12, t, "a", "refund", 77)]
    got = {r.event_id: r.outcome for r in claims.site_claims(spark.createDataFrame(events, SCHEMA), 2, None, 5, 3, 1).collect()}
    assert got == {0: "ok", 1: "ok", 2: "day", 3: "day", 9: "ok", 10: "given back", 11: "nothing", 12: "nothing"}
    assert claims.site_claims(spark.createDataFrame([], SCHEMA), 2, None, 5, 3, 1).count() == 0


def test_query_equals_one_fold(spark):
    data = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/events.parquet").select("event_id", "ts", "user_id", F.expr(reading_queries._KIND)).collect()
    last, events = {}, []
    for event_id, ts, user, kind in sorted(map(tuple, rows), key=lambda e: (e[1], e[0])):
        if kind == "claim":
            last[user] = event_id
        events.append((event_id, ts, user, kind, None if kind == "claim" else last.get(user)))
    limits = reading_queries.CLAIMS
    want = one_fold(events, limits["day"], limits["month"], limits["minute"], limits["site"], limits["unanswered"])
    got = reading_queries.site_claims(spark, data).select("event_id", "user_id", "outcome", "remaining").collect()
    assert sorted(tuple(r) for r in got) == want
