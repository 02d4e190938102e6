"""Queries without SQL against plain models over the whole table."""

from collections import Counter

from tessera.plans import registry

DATA = "/root/testdata/sf0.01"


def events(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id", "event_type").collect()
    return sorted(rows, key=lambda r: (r.ts, r.event_id))


def test_quota_with_refunds(spark):
    used, want = Counter(), {}
    for r in events(spark):
        key = r.user_id, r.ts.date()
        if r.event_type == "error":
            used[key] = max(0, used[key] - 1)
            want[r.event_id] = 2 - used[key]
        elif used[key] < 2:
            used[key] += 1
            want[r.event_id] = 2 - used[key]
        else:
            want[r.event_id] = -1
    got = registry.queries()["quota_refunds"](spark, DATA).select("event_id", "remaining").collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_nested_claims(spark):
    limits, used, want = {"day": 2, "month": 20, "minute": 1}, Counter(), {}
    for r in events(spark):
        keys = {"day": r.ts.date(), "month": (r.ts.year, r.ts.month), "minute": r.ts.replace(second=0, microsecond=0)}
        full = [w for w in ("day", "month", "minute") if used[w, r.user_id, keys[w]] >= limits[w]]
        want[r.event_id] = full[0] if full else None
        for w in () if full else keys:
            used[w, r.user_id, keys[w]] += 1
    got = registry.queries()["quota_multi"](spark, DATA).select("event_id", "refused_by").collect()
    assert dict(map(tuple, got)) == want and {"day", "month", None} <= set(want.values())
