import random

import numpy as np
import pytest

from tessera.llm import minhash

DATA = "/root/testdata/sf0.01"


def slow_sets(texts, n=5):
    out = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").split(" ") if x]
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def slow_components(rows):
    sets = slow_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (doc_id, least.get(find(i))) if x is not None]
        least[find(i)] = min(ids, default=None)
    return [(d, len(s), d if not s else least[find(i)], (d if not s else least[find(i)]) == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def changed(rng, text, times):
    w = text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows(seed):
    """Groups in which links form chains, so that stars alone would miss some."""
    rng = random.Random(seed)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, words(rng.choice([1, 3, 5, 6, 9, 30, 120]))) for i in range(150)]
    base = words(160)
    rows += [(1000 + i, changed(rng, base, rng.randrange(12))) for i in range(150)]
    chain = words(140)
    for i in range(60):
        chain = changed(rng, chain, 1)
        rows.append((2000 - i, chain))
    short = words(12)
    rows += [(3000 + i, " ".join(short.split()[: 10 + i % 3])) for i in range(9)]
    rows += [(i + 9000, rows[i][1]) for i in range(0, 150, 7)] + [(1005, rows[160][1]), (4000, None), (4001, ""), (4002, "  \n"), (None, words(8)), (None, rows[3][1]), (None, None), (4003, "A B c"), (4004, "a b C")]
    return rows


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("most", [2048, 16])
def test_components_equal_brute_force(spark, most):
    rows = near_rows(4)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, node int")
    got = [tuple(r) for r in minhash.minhash_components(docs, most=most).collect()]
    want = slow_components(rows)
    want = [(d, n, c, k) for d, n, c, k in want]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[2] for r in want}) < len({r[0] for r in want}) - 100


def test_densified_bins_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(2)
    for shared, own in ((6, 1), (17, 2), (85, 9), (1000, 60)):
        same = []
        for _ in range(400):
            x = rng.integers(0, 1 << 63, shared + 2 * own).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(x[: shared + own]), np.sort(np.concatenate((x[:shared], x[shared + own :])))
            same.append((minhash.one_permutation(a) == minhash.one_permutation(b)).mean())
        assert abs(np.mean(same) - shared / (shared + 2 * own)) < 0.03


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 200, 5000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a, b = x[: n - n // 5], x[n // 5 :]
        assert int(np.bitwise_count(minhash.parity_map(a) ^ minhash.parity_map(b)).sum()) <= 2 * (n // 5)


def test_pairs_apart_are_all_pairs_that_no_bound_rules_out():
    rng = np.random.default_rng(4)
    for m in (2, 20, 90, 700):
        sets = [np.unique(rng.integers(0, 60, rng.integers(20, 30))).astype(np.uint64) for _ in range(m)]
        parity, n, label = np.stack([minhash.parity_map(s) for s in sets]), np.array([len(s) for s in sets]), rng.integers(0, 5, m)
        part = rng.integers(0, 2, m) if m == 90 else np.zeros(m, np.int64)
        i, j, _ = minhash.pairs_apart(np.ones(m, np.int64), part, label, n, parity, 60)
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        differ = np.bitwise_count(parity[:, None] ^ parity[None]).sum(2)
        differ = np.maximum(differ, np.abs(n[:, None] - n[None]))
        good = (160 * differ <= 40 * (n[:, None] + n[None])) & (label[:, None] != label[None])
        good &= (part[:, None] != part[None]) | (part.min() == part.max())
        assert got == {(a, b) for a, b in zip(*np.nonzero(good)) if a < b} and len(got) == len(i)


def test_recall_on_the_given_table(spark):
    got = {r.doc_id: r.component_id for r in minhash.query(spark, "/root/testdata/sf0.1").select("doc_id", "component_id").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    holders, sets = {}, dict(zip([d.doc_id for d in docs], [set(map(hash, s)) for s in slow_sets([d.text for d in docs])]))
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs = {(a, b) for own in holders.values() if len(own) < 60 for k, b in enumerate(own) for a in own[:k]}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(linked) > 300 and all(got[a] == got[b] for a, b in linked)


def test_empty_table_and_long_text(spark):
    assert minhash.minhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{k % 9973}" for k in range(120_000))
    got = minhash.minhash_components(spark.createDataFrame([(2, long), (1, long + " end"), (3, "other")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True)}
