import math
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, linear, quality, toxicity

DATA = "/root/testdata/sf0.1"


def test_word_hashes_do_not_depend_on_their_place():
    texts = ["Héllo wörld, it's Fine", "", "fine it's x", "wörld"]
    blob = [t.encode() for t in texts]
    raw, at = np.frombuffer(b"".join(blob), np.uint8), np.cumsum([0, *map(len, blob)])
    h, row, start, end = common.words(raw, at)
    found = [(int(r), bytes(raw[s:e]).decode()) for r, s, e in zip(row, start, end)]
    assert found == [(0, "Héllo"), (0, "wörld"), (0, "it's"), (0, "Fine"), (2, "fine"), (2, "it's"), (2, "x"), (3, "wörld")]
    assert h[1] == h[7] and h[2] == h[5] and h[3] == h[4] and len(set(h.tolist())) == 5


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (common.read_table(spark, DATA, n) for n in ("documents", "labels"))
    half = labels.filter("doc_id % 5 <> 0")
    kinds = {k: F.lower("text").rlike("\\b(" + "|".join(v) + ")\\b") for k, v in toxicity.KINDS.items()}
    terms = "idiot|moron|stupid|trash|loser|clown|scum|pathetic|worthless|disgusting"
    held = labels.filter("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("gold"))
    got = toxicity.toxicity(docs, half).join(held, "doc_id").select("doc_id", "_rejected", "gold", F.expr(f"regexp_count(lower(text), '{terms}')").alias("n"), *(F.col(f"_p_{k}") for k in kinds), *(v.alias(k) for k, v in kinds.items())).collect()
    english = [r for r in got if r.gold == 1 and r.n >= 2]
    toxic, clean = [r for r in got if r.gold == 1], [r for r in got if r.gold == 0]
    assert len(english) > 20 and sum(r._rejected for r in english) >= 0.95 * len(english)
    assert sum(r._rejected for r in toxic) >= 0.8 * len(toxic)
    assert sum(r._rejected for r in clean) <= 0.005 * len(clean)
    for k in kinds:  # the links after the first tell kinds apart
        assert sum((r[f"_p_{k}"] >= 0.5) == r[k] for r in english) >= 0.8 * len(english)


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, 1, 7, "x"), (1, "", 2, 7, "x"), (1, "x", 2, 7, "x")], "doc_id long, text string, toxic int, fold int, _p_toxic string")
    labels = spark.createDataFrame([(None, None, None), (1, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 3 and not any(r._rejected for r in got) and all((r.fold, r._p_toxic) == (7, 0.0) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_chain_learns_from_columns_of_kinds_and_repeats_itself(spark):
    rows = [(i, f"{'bad' if i % 2 else 'nice'} {'kick' if i % 4 == 1 else 'sing'} word{i % 7} text", i % 2, int(i % 4 == 1)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(1000, "bad kick " * 50_000), (5, "another bad text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, k) for i, _, t, k in rows], "doc_id long, toxic int, insult int")
    got = {(r.doc_id, r.text): r for r in toxicity.toxicity(docs, labels).collect()}
    assert all((r._p_toxic > 0.5) == ("bad" in r.text) and (r._p_insult > 0.5) == ("kick" in r.text and "bad" in r.text) for r in got.values() if r.doc_id != 5)
    again = {(r.doc_id, r.text): r for r in toxicity.toxicity(docs.repartition(3), labels).collect()}
    assert all(abs(again[k]._p_toxic - r._p_toxic) < 1e-9 for k, r in got.items())


def test_chain_feeds_out_of_fold_predictions():
    """Each link against a plain restatement."""
    rng = np.random.default_rng(0)
    x, fold = rng.normal(size=(600, 4)), np.arange(600) % 5
    y = (x[:, 0] > 0).astype(float)
    targets, ways = [y, y * (x[:, 1] > 0)], [{k: [0, 1] if k is None else [0] for k in (None, *range(5))}, {k: [0, 1] for k in (None, *range(5))}]
    w = toxicity.fit_chain(x, targets, fold, ways, 2)
    assert len(w[0]) == 5 and len(w[1]) == 6 and w[1][4] > 0
    held = np.zeros(600)
    for k in range(5):
        own = linear.fit_logistic(x[fold != k][:, [0, 2, 3]], y[fold != k])
        held[fold == k] = linear.scores(x[fold == k][:, [0, 2, 3]], own)
    want = linear.fit_logistic(np.column_stack([x, held]), targets[1])
    assert np.allclose(w[1], want)


def test_words_of_a_fold_are_chosen_without_it(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 5), int(y), sorted(set(rng.integers(0, 40, 6).tolist()) | ({99} if y else set()) | ({50 + i % 5} if y else set()))) for i, y in enumerate(rng.random(800) < 0.3)]
    sets = spark.createDataFrame(rows, "doc_id long, fold int, y int, buckets array<int>")
    best, chosen = linear.telling_by_fold(sets, ["y"], 5, 100)
    for f in (None, *range(5)):
        own = [r for r in rows if r[1] != f]
        base = sum(r[2] for r in own) / len(own)
        want = set()
        for b in range(100):
            hit = [r[2] for r in own if b in r[3]]
            if 5 <= len(hit) <= 0.9 * len(own) and abs(sum(hit) - len(hit) * base) / (len(hit) * base * (1 - base) + 1) ** 0.5 >= 4.5:
                want.add(b)
        assert {best[k] for k in chosen["y", f]} == want and 99 in want and 50 + (f if f is not None else 9) not in want


def test_em_finds_labeller_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    right, speaks = np.array([0.95, 0.9, 0.8, 0.65]), np.array([0.9, 0.5, 0.7, 0.8])
    said = np.where(rng.random((20_000, 4)) < right, good[:, None], ~good[:, None])
    v = np.where(rng.random((20_000, 4)) < speaks, np.where(said, 1, 2), 0)
    codes, n = np.unique(quality.pattern(v), return_counts=True)
    share, p = quality.fit_votes(quality.unpacked(codes, 4), n.astype(float))
    assert abs(share - 0.7) < 0.03
    assert np.abs(p[1, :, 1] / (p[1, :, 1] + p[1, :, 2]) - right).max() < 0.04


def test_quality_agrees_with_gold_labels_it_never_saw(spark):
    docs, labels = (common.read_table(spark, DATA, n) for n in ("documents", "labels"))
    got = quality.quality(docs).join(labels, "doc_id").filter("quality IS NOT NULL").collect()
    good, bad = ([r for r in got if r.quality == k] for k in (1, 0))
    assert sum(r._quality >= 0.5 for r in good) >= 0.95 * len(good)
    assert sum(r._quality < 0.5 for r in bad) >= 0.6 * len(bad)


def _slow_votes(t):
    """The labellers restated, text by text."""
    raw = t.encode()
    found = re.findall(rb"[0-9A-Za-z'\x80-\xff]+", raw)
    total, kinds = len(found), len({bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found})
    n = max(total, 1)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    loud, odd, bars, stops = upper / max(upper + lower, 1), sum(c in b"#$%&*@^~<>{}[]\\_=+" for c in raw) / n, raw.count(b"|") / n, sum(c in b".!?" for c in raw) / n
    same = sum(a == b and 32 < a < 128 and not chr(a).isalnum() for a, b in zip(raw, raw[1:])) / n
    share, mean = kinds / n, sum(map(len, found)) / n
    vote = lambda bad, good: 2 if bad else 1 if good else 0
    prose = total >= 1 and (share > 0.2 or total > 2000) and (loud < 0.2 or total < 10) and odd < 0.1 and bars < 0.01 and same < 0.02
    return [vote(odd > 0.2, 0), vote(loud > 0.4, 0), vote(bars > 0.15, 0), vote(share < 0.2 and total > 30, 0), vote(total < 1, 0), vote(mean < 2 or mean > 14, 0), vote(stops < 0.01 and total > 40, 0.03 < stops < 0.4), vote(same > 0.2, 0), vote(0, prose)]


def test_weak_labels_equal_their_restatement(spark):
    """Votes and expectation-maximisation again, document by document."""
    docs = common.read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    said = {i: _slow_votes(t) for i, t in texts.items()}
    good = {i: 0.1 if 2 in v else 0.9 for i, v in said.items()}
    for _ in range(200):
        share = min(max(sum(good.values()) / len(good), 0.01), 0.99)
        p = [[[1.0] * 3 for _ in range(9)] for _ in range(2)]
        for i, v in said.items():
            for j, x in enumerate(v):
                p[1][j][x] += good[i]
                p[0][j][x] += 1 - good[i]
        p = [[[x / sum(row) for x in row] for row in side] for side in p]
        new = {}
        for i, v in said.items():
            odds = math.log(share / (1 - share)) + sum(math.log(p[1][j][x] / p[0][j][x]) for j, x in enumerate(v))
            new[i] = 1 / (1 + math.exp(-min(max(odds, -35), 35)))
        done = max(abs(new[i] - good[i]) for i in good) < 1e-6
        good = good if done else new
        if done:
            break
    got = {r.doc_id: r._weak for r in quality.quality(docs).collect()}
    odds = {i: math.log(share / (1 - share)) + sum(math.log(p[1][j][x] / p[0][j][x]) for j, x in enumerate(v)) for i, v in said.items()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-min(max(o, -35), 35)))) < 1e-4 for i, o in odds.items())


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.0, "w"), (1, "", 2.0, "w"), (1, "x y", 2.0, "w"), (2, "long text. " * 60_000, 2.0, "w")], "doc_id long, text string, good double, _weak string")
    got = quality.quality(docs)
    assert got.count() == 4 and dict(got.dtypes)["_weak"] == "double"
    assert quality.quality(docs.limit(0)).count() == 0


def test_logistic_fit():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = linear.fit_logistic(x, np.array([0, 0, 1, 1.0]), l2=0.1)
    assert (linear.scores(x, w) > 0.5).tolist() == [False, False, True, True]
