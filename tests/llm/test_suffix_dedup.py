import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import suffix_dedup


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in [0, 1, 2, 3, 4, 5, 7, 10, 50, 51, 52, 300]:
        for top in (2, 3, 200):
            s = rng.integers(1, top, n)
            got = suffix_dedup.suffix_array(s).tolist()
            assert got == sorted(range(n), key=lambda i: s[i:].tolist())


def _brute(rows, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: suffix_dedup._LAST if i is None else i
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(rank(i), first.get(w, rank(i)))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices("abé ", k=k))
    shared = [word(rng.randrange(30, 160)) for _ in range(12)]
    rows = [(None, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 51), (5, "x" * 700), (5, "y" * 60), (5, "y" * 60), (6, "y" * 61), (7, "\0" * 120), (8, "\0" * 80)]
    for i in range(20, 110):
        rows.append((i, "".join(rng.choice([word(rng.randrange(0, 40)), rng.choice(shared), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(1, 6)))))
    rows += [(200 + i, rows[40][1]) for i in range(30)] + [(None, rows[41][1]), (None, rows[42][1] + shared[0])]
    rows += [(None, word(90) + shared[k % 3] + word(60)) for k in range(40)] + [((1 << 63) - 1, shared[1] + "end of it"), (300, shared[2] * 700)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tag int")
    want = _brute(rows, 50)
    for hot in (50_000, 5):
        got = sorted((tuple(r)[:5] for r in suffix_dedup.substring_dedup(df, hot=hot).collect()), key=str)
        assert got == want
    assert suffix_dedup.substring_dedup(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 10 << 20).astype(np.uint8)).decode()
    df = spark.createDataFrame([(1, long[5000:6000]), (2, long)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.substring_dedup(df).drop("kept").collect()}
    assert got == {1: (1000, 0, 0), 2: (10 << 20, 1000, 1)}


def test_least_ids():
    rng = np.random.default_rng(4)
    runs = [bytes(rng.integers(97, 99, int(k)).astype(np.uint8)) for k in rng.integers(8, 30, 200)]
    ids = rng.permutation(200)
    for own, r in zip(np.split(suffix_dedup.least_ids(runs, ids, 8), np.cumsum([len(r) - 7 for r in runs])[:-1]), runs):
        for k, best in enumerate(own):
            assert best == min(i for i, x in zip(ids, runs) if r[k : k + 8] in x)


def test_suffix_array_of_large_letters():
    rng = np.random.default_rng(3)
    s = rng.integers(1, 1 << 30, 400)[rng.integers(0, 20, 400)]
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(400), key=lambda i: s[i:].tolist())


def test_least_ids_in_parts():
    rng = np.random.default_rng(5)
    gram = b"qqqqqqqqqqqqqqqq"
    runs = list({bytes(rng.integers(97, 99, int(a)).astype(np.uint8)) + gram + bytes(rng.integers(97, 99, int(b)).astype(np.uint8)) for a, b in rng.integers(6, 34, (3000, 2))})
    ids = rng.permutation(len(runs))
    want = suffix_dedup.least_ids(runs, ids, 20)
    for most in (1 << 20, 20_000, 500):  # one array; parts; parts of parts, until no salt is left
        assert (suffix_dedup.least_ids_in_parts(runs, ids, 20, most) == want).all()


class _Rows:
    """Stands for a DataFrame: gives the function that would run on each task's batches."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        return run


def test_memory_of_a_task_with_frequent_hashes():
    rng = np.random.default_rng(7)
    gram = bytes(rng.integers(97, 123, 16).astype(np.uint8))
    runs = [bytes(a) + gram + bytes(b) for a, b in zip(rng.integers(97, 123, (45_000, 34)).astype(np.uint8), rng.integers(97, 123, (45_000, 63)).astype(np.uint8))]
    runs = [r[k % 34 :] if k % 3 else r for k, r in enumerate(runs)]
    runs[40_000:] = [runs[k][:34] + runs[k][34:97] + b"tail of its own" + bytes([97 + k % 26]) for k in range(5_000)]  # share windows with earlier ones
    keys = [1] * len(runs) + [2] * 300
    places = [np.array([k + 7, 1, 0], np.int64).tobytes() for k in range(len(runs))]
    common = bytes(rng.integers(97, 123, 113).astype(np.uint8))
    runs += [common] * 300  # one run of 64 windows in 30,000 places
    least = [*range(7, 7 + 45_000), *range(300)]
    places += [np.array([[k + 300 * j, 2, 0] for j in range(100)], np.int64).tobytes() for k in range(300)]
    table = pa.table({"key": pa.array(keys, pa.int64()), "run": pa.array(runs, pa.binary()), "least": pa.array(least, pa.int64()), "hot": pa.array([False] * len(runs)), "places": pa.array(places, pa.binary())})
    run = suffix_dedup._covered(_Rows(), 50)
    tracemalloc.start()
    try:
        found = [tuple(r.values())[:4] for b in run(iter(table.to_batches(10_000))) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 250 << 20, f"{peak >> 20} MB"
    first: dict[bytes, int] = {}
    for r, k in zip(runs[:45_000], least):
        for i in range(len(r) - 49):
            first.setdefault(r[i : i + 50], k)
    want = [(k, 2, 0, 113) for k in range(1, 30_000)]
    for r, k in zip(runs[:45_000], least):
        on = [i for i in range(len(r) - 49) if first[r[i : i + 50]] < k]
        for i in on:
            if i - 1 not in on:
                low = i
            if i + 1 not in on:
                want.append((k, 1, low, i + 50))
    assert sorted(found) == sorted(want) and len(want) > 33_000
