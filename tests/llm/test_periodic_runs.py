import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs

DATA = "/root/testdata/sf0.01"


def slow_words(text):
    out, now = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            out += [now] if now else []
            now = ""
        else:
            now += ch
    return out + ([now] if now else [])


def slow_runs(w, least=6, copies=4):
    """Every maximal stretch of each period by walking, then those whose smallest period is that."""
    found = []
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, copies * q):
                part = w[i : j + q]
                if all(any(part[k] != part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = slow_words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
text_key = lambda r: tuple(str(x) for x in r)


def test_query_equals_brute_force(spark):
    got = periodic_runs.query(spark, DATA)
    assert got.columns == COLUMNS
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = [slow_row(d.doc_id, d.text) for d in docs if len(d.text or "") < 12_000]
    ids = {r[0] for r in want}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(docs)
    assert sorted(r for r in rows if r[0] in ids) == sorted(want)
    assert sum(r[1] for r in want) > 50


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    texts = [[rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 6, 30, 150]))] for _ in range(60)]
    texts += [[k % p for k in range(n)] for p, n in ((1, 6), (2, 8), (2, 7), (5, 20), (5, 19), (6, 25), (12, 400))]
    texts += [[*range(50), *([7, 8] * 9), 7, *range(60, 90), *([1, 1, 2] * 5)]]
    at = np.cumsum([0, *map(len, texts)])
    got = periodic_runs.runs_of(np.array([x for t in texts for x in t], np.int64), at, 6, 4)
    assert got == [slow_runs(t) for t in texts]


def test_lag_counts_are_exact_for_frequent_and_rare_words():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, k, n) for k, n in ((1, 900), (3, 777), (40, 2000), (2000, 1500), (2, 3))]
    texts[2][::2] = 0
    at = np.cumsum([0, *map(len, texts)])
    counts, base = periodic_runs.lag_counts(np.concatenate(texts), at, 4)
    for t, b in zip(texts, base):
        assert [int((t[:-q] == t[q:]).sum()) for q in range(1, len(t) // 4 + 1)] == counts[b + 1 : b + len(t) // 4 + 1].tolist()


def test_cases(spark):
    long = "x y " * 40_000 + "end"
    rows = [(None, "a " * 12, 1), (3, None, 1), (4, "", 1), (5, " \n\t ", 1), (6, "b b b b b b", 1), (6, "b b b b b b", 1), (7, "b b b b b", 1), (11, long, 2), (12, "é\u00a0é " * 6, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r.doc_id, r.n_words): r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[None, 12].collapsed == "a" and got[3, 0].collapsed == "" and got[4, 0].runs == []
    assert got[6, 6].collapsed == "b" and got[7, 5].runs == []
    assert [tuple(r) for r in got[11, 80_001].runs] == [(0, 80_000, 2)] and got[11, 80_001].collapsed == "x y end"
    assert got[12, 6].collapsed == "é\u00a0é"  # no-break space is no space
    assert periodic_runs.periodic_runs(docs).count() == len(rows)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_cases(spark, tmp_path):
    rows = [(i, "p q r s t " * (i % 9) + f"w{i}", i) for i in range(200)] + [(10, "again " * 9, 0), (10, "again " * 9, 0), (None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, start long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periodic_runs.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=text_key) == sorted((slow_row(i, t) for i, t, _ in rows), key=text_key)
