import hashlib
import random

import numpy as np

from tessera.llm import best_fit_packing, line_dedup

SCHEMA = "doc_id long, text string, gone string, _id int, of int, name int, tag int, low int, _n_lines string"


def _brute(rows, t):
    order = sorted({(i is None, i or 0, hashlib.sha256((x or "").encode()).digest(), i, x) for i, x in rows}, key=lambda r: r[:3])
    seen, out = {}, {}
    for n, (*_, i, x) in enumerate(order):
        lines = (x or "").split("\n")
        solid = [k for k, v in enumerate(lines) if v.strip(" ")]
        gone = set()
        for s in range(len(solid) - t + 1):
            at = solid[s : s + t]
            key = tuple(lines[k] for k in at)
            if key in seen:
                gone.update(k for k in at if (n, k) not in seen[key])
            else:
                seen[key] = {(n, k) for k in at}
        out[i, x] = x if not gone else "\n".join(v for k, v in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    for t in (1, 2, 3):
        rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a\na\na\na\na"), (4, "a\na\na\na\na"), (4, "b\nc"), (None, "a\na\nq"), (5, "x\r\ny")]
        rows += [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "dé", f"u{i}"]) for _ in range(rng.randrange(9)))) for i in range(10, 70)]
        got = line_dedup.line_dedup(spark.createDataFrame([(*r, "k", 3, 4, 5, 6, 7, "z") for r in rows], SCHEMA), window=t).collect()
        want = _brute(rows, t)
        assert len(got) == len(rows) and all((r.gone, r._id, r.of, r.name, r.tag, r.low) == ("k", 3, 4, 5, 6, 7) and r._n_lines == (len(r.text.split("\n")) + r._n_removed if r.text is not None and not (r.text == "" and r._n_removed) else r._n_lines) for r in got)
        assert sorted(map(str, (want[r] for r in rows))) == sorted(str(r.text) for r in got)
        byid = {}
        for r in rows:
            byid.setdefault(r[0], []).append(want[r])
        for r in got:
            assert r.text in byid[r.doc_id]


def test_long_lines_are_runs_by_themselves(spark):
    rng = random.Random(6)
    long, short = [" ".join(f"w{rng.randrange(99)}" for _ in range(50)) for _ in range(4)], [" ".join(f"w{rng.randrange(99)}" for _ in range(49)) for _ in range(3)]
    rows = [(1, long[0]), (2, long[0]), (3, short[0]), (4, short[0]), (5, f"own\n{long[1]}\nlines"), (6, f"other\n{long[1]}\nends\n{long[1]}"), (None, long[2]), (7, long[2])]
    rows += [(i, "\n".join(rng.choice([*long, *short, "", f"u{i}", f"v{i}"]) for _ in range(rng.randrange(1, 6)))) for i in range(10, 60)]
    got = {(r.doc_id, r.before): r.text for r in line_dedup.line_dedup(spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id long, text string, before string"), alone=50).collect()}
    both, seen = _brute(rows, 2), set()
    for i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        single = [v for v in x.split("\n") if len(v.split()) >= 50]
        first, solid = [v for k, v in enumerate(single) if v not in seen and v not in single[:k]], got[i, x].split("\n")
        for v in set(single):
            assert solid.count(v) <= (v in first)
            assert solid.count(v) == both[i, x].split("\n").count(v) or v in seen or single.count(v) > 1
        assert [v for v in solid if len(v.split()) < 50 and v] == [v for v in both[i, x].split("\n") if len(v.split()) < 50 and v]
        seen.update(single)
    assert got[1, long[0]] == long[0] and got[2, long[0]] == "" and got[4, short[0]] == short[0] and got[7, long[2]] == long[2] and got[None, long[2]] == ""


def test_line_stage_drops_repeated_long_lines(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a\n{long}\nb", 0), (2, f"c\n{long}\nd", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {1: (f"a\n{long}\nb", len(long) + 4), 2: ("c\nd", 3)}


def test_the_first_occurrence_stays_whole(spark):
    rows = [(1, "a\na\na\na\na"), (2, "b\nc\nb\nc\nb\nc"), (3, "b\nc\nd"), (4, "x\n" * 40_000)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\na", 2: "b\nc", 3: "d", 4: "x\nx\n"}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_keeps_every_piece_whole(spark):
    rng = random.Random(1)
    rows = [(None, 5), (1, None), (1, 0), (1, -4), (2, 100), (3, 64), (3, 65)] + [(i, rng.choice([1, 3, 9, 20, 33, 64, 200])) for i in range(10, 400)]
    got = best_fit_packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacities=(16, 32, 64), shard_rows=100).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + max(n or 0, 0)
    assert total == want
    held = {}
    for r in got:
        held.setdefault(r.bin_id, []).append(r)
    for own in held.values():
        own.sort(key=lambda r: (r.bin_offset, r.length))
        used = sum(r.length for r in own)
        assert {r.bin_used for r in own} == {used}
        assert {r.capacity for r in own} == {next(c for c in (16, 32, 64) if c >= used)}
        for a, b in zip(own, own[1:]):
            assert a.bin_offset + a.length == b.bin_offset
    assert sum(r.bin_used for r in got if r.bin_offset == 0) <= sum(own[0].capacity for own in held.values())
    assert best_fit_packing.best_fit_packing(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    assert best_fit_packing.bins(best_fit_packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, n_tokens long"))).selectExpr("sum(size(doc_ids))").first()[0] == len(rows)


def test_each_piece_goes_to_the_fullest_bin_or_opens_the_least_cost_one():
    """Restated with lists of all bins and of all pieces to come."""
    for seed, caps, per_bin, quadratic in ((2, (64,), 16.0, 0.0), (3, (16, 32, 64), 16.0, 0.0), (4, (16, 32, 64), 2.0, 0.02), (5, (32, 128), 40.0, 0.0)):
        lengths = np.random.default_rng(seed).integers(0, caps[-1] + 1, 300)
        where, _, used, final = best_fit_packing.pack(lengths, caps, per_bin, quadratic)
        cost = lambda c: per_bin + c + quadratic * c * c
        order, bins = np.argsort(-lengths, kind="stable").tolist(), []  # (opened length, content)
        for at, i in enumerate(order):
            n, left = int(lengths[i]), [c - u for c, u in bins]
            fits = [r for r in left if r >= n]
            if fits:
                assert left[where[i]] == min(fits)
            else:
                offers = []
                for c in (c for c in caps if c >= n):
                    full = n
                    for j in order[at + 1 :]:
                        full += int(lengths[j]) if full + lengths[j] <= c else 0
                    offers.append((cost(min(x for x in caps if x >= full)) / max(full, 1), c))
                best = min(v for v, _ in offers)
                assert where[i] == len(bins)
                bins.append((next(c for v, c in offers if v <= best * (1 + 1e-9)), 0))
            bins[where[i]] = (bins[where[i]][0], bins[where[i]][1] + n)
        assert used.tolist() == [u for _, u in bins] and used.sum() == lengths.sum()
        assert final.tolist() == [min(c for c in caps if c >= u) for u in used]


def test_openings_are_hardly_dearer_than_one_size_for_all():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 500, 800), rng.integers(1, 60, 800), (rng.pareto(1.2, 800) * 20).astype(np.int64) % 500):
        caps = (64, 128, 256, 512)
        cost = lambda f: (4.0 + f + 0.001 * f.astype(float) ** 2).sum()
        *_, final = best_fit_packing.pack(lengths, caps, 4.0, 0.001)
        for k in range(len(caps)):
            if lengths.max() <= caps[k]:
                assert cost(final) <= 1.02 * cost(best_fit_packing.pack(lengths, caps[k:], 4.0, 0.001)[3])


def test_sequences_hold_the_bytes_of_their_documents(spark):
    rows = [(1, "aé" * 40), (2, None), (3, ""), (None, "xyz"), (3, "abc")]
    docs = best_fit_packing.byte_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    got = best_fit_packing.bins(best_fit_packing.best_fit_packing(docs, tokens="tokens", capacities=(16, 32))).collect()
    parts = {}
    for r in got:
        assert len(r.content) == r.used <= r.capacity
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.piece, bytes(r.content[p.bin_offset : p.bin_offset + p.length])))
    assert b"".join(x for _, x in sorted(parts[1])) == ("aé" * 40).encode() + b"\xff"
    assert sorted(x for _, x in parts[3]) == [b"abc\xff", b"\xff"] and parts[None] == [(0, b"xyz\xff")]
