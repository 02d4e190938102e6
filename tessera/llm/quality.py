"""Quality by weak labels.

Overlapping heuristics vote good, bad or nothing on each document. The votes of all documents are counted by pattern in
Spark (at most 3 to the number of labellers rows), and expectation-maximisation over the patterns estimates for each
labeller how often it speaks and how often it is right in good and in bad documents, without any gold label. The posterior
of a document's pattern is its label; a linear scorer over hashed words and text shape, trained on at most `train_rows`
documents (evenly over the two sides, those of smallest hashed id), carries it to texts on which no heuristic speaks.

Cases: null text counts as empty and is bad; null ids are scored too; rows with equal ids are scored each for itself; if
all documents get one label the posterior itself is the score; of repeated ids the text that sorts first is trained on; very long
texts are read whole; an empty table gives no rows; extra columns pass through, whatever their names, but for input columns named like a
result column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.common import Stash, read_table, slices, words

#: Each votes 1 (good), 2 (bad) or 0. A heuristic for one kind of junk is silent on texts without it, as they may be junk of
#: another kind; only `prose` and `sentences` speak for a text.
LABELLERS = ("symbols", "shouting", "bars", "repeats", "short", "word_length", "sentences", "runs", "prose")

_ODD, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_ODD[np.frombuffer(b"#$%&*@^~<>{}[]\\_=+", np.uint8)] = True
_STOP[np.frombuffer(b".!?", np.uint8)] = True


def votes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Text by labeller."""
    n = np.diff(at)
    h, row, start, end = words(raw, at)
    count = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[at])
    total = np.bincount(row, minlength=len(n))
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][fresh], minlength=len(n))
    mean = np.bincount(row, end - start, minlength=len(n)) / np.maximum(total, 1)
    odd = _ODD[raw]
    stops = _STOP[raw]
    upper, lower, digit = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
    same = np.concatenate(([False], (raw[1:] == raw[:-1]) & (raw[1:] > 32) & (raw[1:] < 128) & ~lower[1:] & ~upper[1:] & ~digit[1:])) if len(raw) else odd
    per_word = lambda m: count(m) / np.maximum(total, 1)
    share = kinds / np.maximum(total, 1)
    vote = lambda bad, good: np.where(bad, 2, np.where(good, 1, 0))
    loud = count(upper) / np.maximum(count(upper) + count(lower), 1)
    return np.stack(
        [
            vote(per_word(odd) > 0.2, False),
            vote(loud > 0.4, False),
            vote(per_word(raw == 124) > 0.15, False),
            vote((share < 0.2) & (total > 30), False),
            vote(total < 1, False),
            vote((mean < 2) | (mean > 14), False),
            vote((per_word(stops) < 0.01) & (total > 40), (per_word(stops) > 0.03) & (per_word(stops) < 0.4)),
            vote(per_word(same) > 0.2, False),
            vote(False, (total >= 1) & ((share > 0.2) | (total > 2000)) & ((loud < 0.2) | (total < 10)) & (per_word(odd) < 0.1) & (per_word(raw == 124) < 0.01) & (per_word(same) < 0.02)),
        ],
        1,
    ).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def unpacked(codes: np.ndarray, labellers: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(labellers)[None, :] % 3


def fit_votes(v: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and for (bad, good), labeller and vote the probability of the vote. v: patterns by
    labeller, n: their counts. It starts from documents with no vote against them."""
    good = np.where((v == 2).any(1), 0.1, 0.9)
    for _ in range(rounds):
        share = float(np.clip((good * n).sum() / n.sum(), 0.01, 0.99))
        p = np.stack([np.stack([((w * n)[:, None] * (v == k)).sum(0) for k in range(3)], 1) + 1.0 for w in (1 - good, good)])
        p /= p.sum(2, keepdims=True)
        logs = np.log(p)
        odds = np.log(share / (1 - share)) + sum(logs[1, j, v[:, j]] - logs[0, j, v[:, j]] for j in range(v.shape[1]))
        new = linear.sigmoid(odds)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return share, p


def posteriors(v: np.ndarray, share: float, p: np.ndarray) -> np.ndarray:
    logs = np.log(p)
    return linear.sigmoid(np.log(share / (1 - share)) + sum(logs[1, j, v[:, j]] - logs[0, j, v[:, j]] for j in range(v.shape[1])))


@dataclass
class Model:
    share: float
    votes: np.ndarray | None
    column_of: np.ndarray
    n: int
    weights: np.ndarray | None

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = votes(raw, at)
        weak = posteriors(own, self.share, self.votes) if self.votes is not None else np.zeros(len(at) - 1)
        if self.weights is None:
            return weak, weak
        return weak, linear.scores(np.hstack([linear.presence(raw, at, self.column_of, self.n), linear.shape(raw, at)]), self.weights)


def train(docs: DataFrame, train_rows: int = 6000, terms: int = 512) -> Model:
    """docs: doc_id, text. At most `terms` hashed words are read, those that tell most, which bounds the matrix of the sample."""
    stash = Stash(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.concatenate([np.zeros(0, np.int64)] + [pattern(votes(raw, at)) for _, _, raw, at in slices(b.column(1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes)], ["doc_id", "pattern"])

    seen = stash.put(docs.mapInArrow(run, "doc_id long, pattern long"), "votes")
    counts = seen.groupBy("pattern").count().orderBy("pattern").collect()
    if not counts:
        return Model(0.5, None, linear.column_index([]), 0, None)
    codes, n = (np.array([r[k] for r in counts], np.int64) for k in (0, 1))
    v = unpacked(codes, len(LABELLERS))
    share, p = fit_votes(v, n.astype(float))
    good = posteriors(v, share, p)
    none = Model(share, p, linear.column_index([]), 0, None)
    if (good > 0.5).all() or (good <= 0.5).all():
        return none
    posterior = docs.sparkSession.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good)], "pattern long, good double")
    marked = seen.filter("doc_id IS NOT NULL").join(F.broadcast(posterior), "pattern")
    pick = lambda cond: marked.filter(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2)
    chosen = stash.put(pick("good > 0.5").union(pick("good <= 0.5")).groupBy("doc_id").agg(F.avg("good").alias("good")), "chosen")
    sets = stash.put(linear.bucket_sets(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")), ["doc_id", "good"]), "sets")
    best = linear.telling_buckets(sets, "good", terms)
    x, y = linear.matrix(sets, best, ["doc_id", "good"])
    order = np.argsort(y["doc_id"], kind="stable")
    return Model(share, p, linear.column_index(best), len(best), linear.fit_logistic(x[order], y["good"][order]))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _weak (posterior of the votes) and _quality (score of the linear model)."""
    docs = docs.drop("_weak", "_quality")
    model = train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.predict(raw, own) for _, _, raw, own in slices(b.column(at))]
            weak, score = (np.concatenate([np.zeros(0)] + [f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(weak), pa.array(score)], [*b.schema.names, "_weak", "_quality"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _weak double, _quality double")


QUERY = "op9_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.round("_weak", 6).alias("weak_label"), F.round("_quality", 6).alias("quality"), (F.col("_quality") >= 0.5).alias("kept"))


ORACLE_SQL = None
