import math
import random
import string
from collections import Counter

import numpy as np

from tessera.llm import lexical_search

KEPT = set(string.ascii_letters + string.digits)


def slow_terms(text):
    out, now = [], ""
    for ch in text or "":
        if ch in KEPT or ord(ch) > 127:
            now += ch.lower() if ch in string.ascii_uppercase else ch
        else:
            out += [now] if now else []
            now = ""
    return out + ([now] if now else [])


def slow_search(docs, items, k):
    words = [(i, slow_terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            if not w:
                continue
            m, tf = 50 + (50 * len(w) * n_docs) // total, Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(slow_terms(text)) if t in tf)
            if score > 0:
                scores.append((-score, i))
        scores.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def made(rng, n, words):
    return " ".join(f"w{min(int(rng.paretovariate(0.8)), words)}" for _ in range(n))


def test_equals_full_scores_in_shards_and_blocks(spark):
    rng = random.Random(3)
    docs = [(i, made(rng, rng.choice([0, 1, 8, 40, 200]), 400)) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(80)] + [(5, docs[5][1]), (None, docs[7][1]), (None, None), (2000, " .,-"), (2001, "w1 " * 30_000)]
    items = [(i, made(rng, 12, 400)) for i in range(25)] + [(3, docs[5][1]), (3, docs[5][1]), (90, None), (91, "!"), (92, "nowhere"), (None, "w9 W9 w9"), (93, "w1")]
    want = plain(slow_search(docs, items, 10))
    frame = lambda rows: spark.createDataFrame(rows, "key long, body string").withColumn("score", lexical_search.F.lit("x"))
    names = {"id_col": "key", "text_col": "body", "item_col": "key", "item_text_col": "body"}
    assert plain(lexical_search.ranked_search(frame(docs), frame(items), k=10, **names).collect()) == want
    assert plain(lexical_search.ranked_search(frame(docs).repartition(2), frame(items), k=10, shard_rows=50, block_bytes=300, **names).collect()) == want


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(1)
    size = np.full(20_000, 6)
    term = np.concatenate([np.sort(rng.choice(40, 6, replace=False)) for _ in size])
    tf = rng.integers(1, 9, len(term))
    weight = np.where(np.arange(40) < 3, 6000, 40)
    shard = lexical_search.Shard(np.arange(20_000), rng.integers(6, 900, 20_000), size, term, tf, weight, 20_000, 9_000_000)
    query, read = np.array([0, 1, 2, 10, 20, 30]), []
    shard.whole_scores = lambda docs, wanted: read.append(len(docs)) or lexical_search.Shard.whole_scores(shard, docs, wanted)
    ids, scores = shard.best(query, 20, 1)
    wanted = np.isin(np.arange(40), query)
    every = lexical_search.Shard.whole_scores(shard, np.arange(20_000), wanted)
    order = np.lexsort((np.arange(20_000), -every))[:20]
    assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert read and read[0] < 6_000  # the bound has left out most documents


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs, items), (docs, asked), (some, items), (spark.createDataFrame([(1, None)], docs.schema), asked)):
        got = lexical_search.ranked_search(d, q)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
