import hashlib
import random
import string

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, row_no string"


def test_exact_dedup_matches_groups(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "a", "x"), (3, "A", "x"), (None, "a", "x"), (4, None, None), (5, "", "y"), (None, "zz", "")]
    rows += [(100 + i, "hot", "") for i in range(50)] + [(500 + i, f"t{i}", "") for i in range(30)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), most_heavy=4, tracked=16).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest in groups:
        kept = [r for r in got if r.text_sha256 == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def _slow_print(text, n):
    words, now = [], ""
    for ch in text or "":
        ch = ch.lower() if ch in string.ascii_uppercase else ch
        if ch in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += ch
    words += [now] if now else []
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé", k=5)) for _ in range(300)]
    rows = [(0, None, ""), (1, "", ""), (2, " \n", ""), (3, "One word", ""), (4, "two Words", "")]
    for i in range(5, 160):
        words = base[: rng.choice([40, 200, 300])]
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            words[rng.randrange(len(words))] = rng.choice(base)
        rows.append((i, " ".join(words), ""))
    got = {r.doc_id: r for r in simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [_slow_print(t, 3) for _, t, _ in rows]
    want = _components(prints, 3)
    assert len(set(want)) < len(rows) - 20
    for (i, _, _), p, c in zip(rows, prints, want):
        assert got[i].fingerprint == f"{p:016x}" and got[i].component_id == rows[c][0]


@pytest.mark.parametrize("most", [4, 8192])
def test_links_lose_nothing_in_hot_buckets(spark, most):
    from tessera.llm.common import Stash

    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = list({base ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(p, p, [p]) for p in prints], "id long, label long, words array<long>")
    found = simhash.exact_links(df, 3, Stash(spark), most=most).collect()
    assert all(bin(r.a ^ r.b).count("1") <= 3 for r in found)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in found:
        root[find(r.a)] = find(r.b)
    want = _components(prints, 3)
    assert len({find(p) for p in prints}) == len(set(want))


def _alike(s, t, n=5):
    """Restated with sets and loops."""
    if not len(s) or not len(t):
        return float(len(s) == len(t))
    a, b, share = set(s), set(t), []
    for x, other in ((s, b), (t, a)):
        firsts = [(i, h) for i, h in enumerate(x) if h not in x[:i]] if len(x) < 200 else [(i, h) for h, i in {h: i for i, h in reversed(list(enumerate(x)))}.items()]
        words = lambda some: {j for i, _ in some for j in (range(i, i + n) if len(x) > 1 else [0])}  # noqa: B023, E731
        share.append(len(words([f for f in firsts if f[1] in other])) / len(words(firsts)))
    return max(len(a & b) / len(a | b), min(share))


def _linked_pairs(lists, least=0.8):
    """All pairs that are alike; such a pair shares a shingle or has none at all."""
    held, out = {}, set()
    for i, s in enumerate(lists):
        for h in set(s) or {None}:
            held.setdefault(h, []).append(i)
    seen = {(i, j) for own in held.values() for i in own for j in own if i < j}
    for i, j in seen:
        if min(len(lists[i]), len(lists[j])) * 2 >= max(len(lists[i]), len(lists[j])) and _alike(lists[i], lists[j]) >= least:
            out.add((i, j))
    return out


def _roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_alike_equals_its_restatement():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s, t = (rng.integers(0, 12, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        assert simhash.alike(s, t, 5) == pytest.approx(_alike(s.tolist(), t.tolist()))


@pytest.mark.parametrize("exact, most", [(True, 4096), (True, 6), (False, 4096), (False, 6)])
def test_near_duplicates_against_all_pairs(spark, exact, most):
    rng = random.Random(9)
    rows = [(1, None, ""), (2, "", ""), (3, " ", ""), (4, "two words", ""), (5, "Two  words", ""), (6, "two word", "")]
    for g in range(1, 30):
        words = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(rng.choice([8, 40, 120]))]
        for k in range(6):
            copy = list(words)
            for _ in range(k * len(words) // 60):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((g * 10 + k, " ".join(copy), ""))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), exact=exact, most=most).collect()}
    lists = [simhash.shingle_hashes(t, 5).tolist() for _, t, _ in rows]
    pairs = _linked_pairs(lists)
    want = _roots(len(rows), pairs)
    assert len(pairs) > 60
    if exact:
        assert [got[i] for i, _, _ in rows] == [rows[k][0] for k in want]
    for i, j in pairs:
        assert got[rows[i][0]] == got[rows[j][0]] or not exact
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(want[i] == want[j] for i in range(len(rows)) for j in range(i) if got[rows[i][0]] == got[rows[j][0]])


def test_near_copies_of_documents_are_found(spark):
    """Recall and precision against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts[r.text or ""] = min(r.doc_id, texts.get(r.text or "", r.doc_id))
    names = list(texts.values())
    pairs = _linked_pairs([simhash.shingle_hashes(t, 5).tolist() for t in texts])
    want = dict(zip(names, _roots(len(names), pairs)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    hit = sum(got[names[i]] == got[names[j]] for i, j in pairs)
    assert len(pairs) > 50 and hit >= 0.97 * len(pairs)
    assert all(want[a] == want[got[a]] for a in names)


def test_pairs_meet_at_the_stated_rate():
    rng = np.random.default_rng(8)
    near = simhash._reach(1 / 3, 128, 0.002)
    for jaccard, least in ((0.39, 0.96), (0.5, 0.99), (0.8, 0.999)):
        own = round(200 * (1 - jaccard) / (1 + jaccard))
        hit = 0
        for _ in range(1500):
            h = rng.integers(0, 1 << 64, 200 + own, np.uint64)
            a, b = h[:200], h[own:]
            apart = np.bitwise_count(simhash.fingerprint(a, 2) ^ simhash.fingerprint(b, 2)).sum()
            hit += apart <= near and bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
        print(f"similarity {jaccard}: {hit / 1500:.4f}")
        assert hit >= least * 1500


def test_near_duplicates_count_a_repeated_phrase_once(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(108)]
    rows = [(1, " ".join(words[:104]), ""), (2, " ".join(words[:104] + words[100:105] * 60), ""), (3, " ".join(words[50:]), "")]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t, _ in rows]
    assert len(sets[0] & sets[1]) >= 0.9 * len(sets[0] | sets[1])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_text_with_many_equals_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 12, k).astype(np.int64) for k in [0, 0, 1, 1, *rng.integers(0, 40, 80)]] + [np.array([3]), np.array([3])]
    for at_once in (1, 50, 1 << 18):
        monkeypatch.setattr(simhash, "_AT_ONCE", at_once)
        whole = simhash.Lists(pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), 5)
        for i in range(len(lists)):
            others = np.array([j for j in range(len(lists)) if j != i])
            assert whole.alike(i, others).tolist() == [simhash.alike(lists[i].view(np.uint64), lists[j].view(np.uint64), 5) for j in others]


@pytest.mark.parametrize("most, long", [(4096, 1 << 20), (6, 1 << 20), (4096, 500)])
def test_near_duplicates_end_no_search_at_the_nearest(spark, monkeypatch, most, long):
    """Every pair that meets in a band and is near enough counts, also where many that are nearer are not alike."""
    monkeypatch.setattr(simhash, "_LONG", long)
    rng = random.Random(21)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=5))
    shared, rows = [word() for _ in range(70)], []
    for k in range(120):
        own = [word() for _ in range(30)]
        rows.append((10 * k + 1, " ".join(shared + own), ""))
        if k % 4 == 0:  # alike by the words that are covered, with few shingles in common
            near = shared + own
            for i in range(3, 100, 7):
                near = [*near[:i], word(), *near[i + 1 :]]
            rows.append((10 * k + 2, " ".join(near), ""))
    lists = [simhash.shingle_hashes(t, 5) for _, t, _ in rows]
    sets = [np.unique(x) for x in lists]
    keys, prints = np.stack([simhash.band_keys(s) for s in sets]), np.stack([simhash.fingerprint(s, 2) for s in sets])
    near = simhash._reach(1 / 3, 128, 0.002)
    meet = [(i, j) for j in range(len(rows)) for i in range(j) if (keys[i] == keys[j]).any() and np.bitwise_count(prints[i] ^ prints[j]).sum() <= near]
    pairs = [(i, j) for i, j in meet if simhash.alike(lists[i], lists[j], 5) >= 0.8]
    want = _roots(len(rows), pairs)
    assert len(meet) > 20 * len(rows) and len(pairs) >= 10
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), most=most).collect()}
    assert [got[i] for i, _, _ in rows] == [rows[k][0] for k in want]


def test_the_nearest_of_a_task_hold_the_nearest_of_all():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 20, 500), rng.integers(20, 30, 500)
    apart = (a * 7 + b * 3) % 11
    got = sorted((b[k], apart[k], a[k]) for k in simhash.nearest(a, b, apart, 3))
    each = sorted(set(zip(b.tolist(), apart.tolist(), a.tolist())))
    assert got == [x for k, x in enumerate(each) if sum(y[0] == x[0] for y in each[:k]) < 3]
    assert simhash.nearest(a[:0], b[:0], apart[:0], 3).tolist() == []
