import random
import re
import string

import pytest

from tessera.llm import decontaminate


def _norm(t):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", (t or "").lower()).strip().encode()


def _edits(needle, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(needle, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def _edit(rng, t, n):
    for _ in range(n):
        k = rng.randrange(len(t))
        t = rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice(string.ascii_lowercase) + t[k:], t[:k] + "x" + t[k + 1 :]])
    return t


@pytest.mark.parametrize("blocks", [1 << 22, 200])
def test_matches_full_alignment(spark, blocks):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(string.ascii_lowercase[:9] + "é", k=rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 30)))) for i in range(8)] + [(8, None), (9, "tiny"), (10, "a, b! c? d e f g h")]
    docs = [(0, None, 1), (1, "", 1), (2, "tiny", 1), (3, "A b c d-e f g h.", 1)]
    for i in range(4, 70):
        text = " ".join(word() for _ in range(rng.randrange(0, 60)))
        if i % 2:
            text = text + rng.choice([" ", "\n", "x"]) + _edit(rng, rng.choice(items[:8])[1], rng.randrange(0, 24)).upper() + " " + word()
        docs.append((i, text, 1))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=blocks)
    got = {r.doc_id: {(h.item_id, h.edits) for h in r._hits} for r in got.collect()}
    hits = 0
    for i, t, _ in docs:
        want = set()
        for item, passage in items:
            p = _norm(passage)
            if len(p) >= 8:
                most = min(int(0.1 * len(p)), (len(p) - 8) // 8)
                n = _edits(p, _norm(t))
                if n <= most:
                    want.add((item, n))
        hits += bool(want)
        assert got[i] == want, (i, t)
    assert 12 < hits < 45


def test_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert decontaminate.contaminated(docs, none).first()._hits == []
    assert decontaminate.contaminated(docs.limit(0), docs.toDF("item_id", "text")).count() == 0


def test_one_fold_very_frequent_grams_and_other_columns(spark, monkeypatch):
    items = [(1, "Ο ΟΔΥΣΣΕΥΣ ΕΠΛΕΥΣΕ ΠΡΟΣ ΤΗΝ ΙΘΑΚΗ ΜΕ ΤΟΥΣ ΣΥΝΤΡΟΦΟΥΣ"), (2, "aaaaaaaaaaaa" * 9), (3, "ab " * 30)]
    docs = [(None, f"x. {items[0][1]}! y", "k"), (1, items[0][1].lower(), "k"), (2, "a" * 30_000, "k"), (3, "ab " * 20_000, "k"), (3, "b" * 30_000, "k")]
    monkeypatch.setattr(decontaminate, "_POSTINGS", 1000)
    for blocks in (1 << 22, 50):
        df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, _hits string, name int, hits int")
        got = sorted((str(r.doc_id), r.text[:3], [(h.item_id, h.edits) for h in r._hits], r.name, r.hits) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=blocks).collect())
        assert got[1:4] == [("2", "aaa", [(2, 0)], 1, 2), ("3", "ab ", [(3, 0)], 1, 2), ("3", "bbb", [], 1, 2)]
        assert got[4] == ("None", "x. ", [(1, 0)], 1, 2)
        assert [h[0] for h in got[0][2]] == [1]
