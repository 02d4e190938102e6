"""Toxicity by a classifier chain.

Categories are predicted in order, each by a logistic model over hashed words and word pairs, text shape and the
probabilities of the categories before it. When the chain is trained those earlier probabilities come from models that
have not seen the row (out-of-fold), so later models learn how far to trust them; the words that such a model reads are chosen
outside of the fold as well. The chain is `toxic` and then the kinds of abuse in KINDS. A kind that is a column of labels is
learnt from that column. The given labels have no kinds; there a toxic row has the kind if one of the kind's seed words is in it,
so that the links after the first tell kinds apart within what the first one finds, and are no evidence of their own. The text
is rejected at a probability of `toxic` of at least `threshold`.

Training takes at most `positives` toxic and `negatives` other labelled rows, those of smallest hashed id; words are
chosen and counted in Spark, at most `terms` for a model, which bounds its matrix. Every whole text is scored.

Cases: null text counts as empty; labels that are null are left out, repeated ones count by their maximum; of repeated ids the
text that sorts first is trained on; without usable labels of both kinds every probability is 0, and a kind that no row or every row
has gets the same probability everywhere; rows with equal ids are scored each for itself; null ids are scored; an empty table gives no rows; extra
columns pass through, whatever their names, but for input columns named like a result column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linear
from tessera.llm.common import Stash, read_table, slices

#: Kinds of abuse and their seed words.
KINDS = {
    "insult": ["dumb", "fool", "idiot", "idiotic", "moron", "stupid"],
    "contempt": ["disgusting", "garbage", "scum", "trash", "vermin", "worthless"],
    "mockery": ["clown", "laughable", "loser", "pathetic"],
}
CATEGORIES = ("toxic", *KINDS)
FOLDS = 5


@dataclass
class Chain:
    column_of: np.ndarray
    n: int
    weights: list[np.ndarray]  # empty if there was nothing to learn from

    def features(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.hstack([linear.presence(raw, at, self.column_of, self.n), linear.shape(raw, at)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(x), len(CATEGORIES)))
        for w in self.weights:
            x = np.hstack([x, linear.scores(x, w)[:, None]])
        return x[:, -len(self.weights) :]


def fit_link(x: np.ndarray, y: np.ndarray, columns: np.ndarray, l2: float) -> np.ndarray:
    """Weights for all columns of x, of which only the given ones may differ from zero, and the intercept."""
    out = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        out[-1] = 20.0 if len(y) and y[0] else -20.0
        return out
    w = linear.fit_logistic(x[:, columns], y, l2)
    out[columns], out[-1] = w[:-1], w[-1]
    return out


def fit_chain(x: np.ndarray, targets: list[np.ndarray], fold: np.ndarray, chosen: list[dict[int | None, list[int]]], words: int, l2: float = 1.0) -> list[np.ndarray]:
    """Weights of each link; the columns that earlier links add are out-of-fold predictions. chosen: for each link the word columns of the model of all rows
    (None) and of the models that leave out a fold; x has `words` of them, then others, which all models read."""
    out = []
    for y, own in zip(targets, chosen):
        columns = {k: np.concatenate((np.array(v, np.int64), np.arange(words, x.shape[1]))) for k, v in own.items()}
        out.append(fit_link(x, y, columns[None], l2))
        held = np.zeros(len(x))
        for k in np.unique(fold):
            held[fold == k] = linear.scores(x[fold == k], fit_link(x[fold != k], y[fold != k], columns[int(k)], l2))
        x = np.hstack([x, held[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 6000, terms: int = 128) -> Chain:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1) and, where known, kinds."""
    stash = Stash(docs.sparkSession)
    given = [k for k in KINDS if k in labels.columns]
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), *(F.coalesce(F.max(k).cast("int"), F.lit(0)).alias(k) for k in given))
    pick = lambda cond, n: known.filter(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = stash.put(pick("toxic = 1", positives).union(pick("toxic <> 1", negatives)), "labels")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *chosen.columns[1:]).agg(F.min("text").alias("text"))
    seeded = [((F.col("toxic") == 1) & F.col("text").rlike(r"(?i)\b(" + "|".join(KINDS[k]) + r")\b")).cast("int").alias(k) for k in KINDS if k not in given]
    rows = rows.select("*", *seeded, F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold"))
    sets = stash.put(linear.bucket_sets(rows, ["doc_id", "fold", *CATEGORIES]), "sets")
    mean = sets.agg(F.avg("toxic")).first()[0]
    if not mean or mean == 1:
        return Chain(linear.column_index([]), 0, [])
    best, telling = linear.telling_by_fold(sets, list(CATEGORIES), FOLDS, terms)
    x, y = linear.matrix(sets, best, ["doc_id", "fold", *CATEGORIES])
    order = np.argsort(y["doc_id"], kind="stable")  # the same sums whatever order rows arrive in
    x, fold, targets = x[order], y["fold"][order], [y[c][order].astype(float) for c in CATEGORIES]
    ways = [{f: telling[c, f] for f in (None, *range(FOLDS))} for c in CATEGORIES]
    return Chain(linear.column_index(best), len(best), fit_chain(x, targets, fold, ways, len(best)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with _p_toxic, a probability _p_... for each kind, and _rejected."""
    names = [f"_p_{c}" for c in CATEGORIES] + ["_rejected"]
    docs = docs.drop(*names)
    chain = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    held = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([np.zeros((0, len(CATEGORIES)))] + [held.value.predict(held.value.features(raw, own)) for _, _, raw, own in slices(b.column(at))])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, 0] >= threshold)], [*b.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields + "".join(f", {n} {'boolean' if n == '_rejected' else 'double'}" for n in names))


QUERY = "op10_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.round(f"_p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), F.col("_rejected").alias("toxic"), (~F.col("_rejected")).alias("kept"))


ORACLE_SQL = None
