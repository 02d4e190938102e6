"""Small linear models, fitted on the driver over bounded samples, and the features that they read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pairs, slices, words

BUCKET_BITS = 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last being the intercept, by Newton steps; y may hold probabilities."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and neighbouring word pairs of texts: bucket and row."""
    h, row, _, _ = words(raw, at)
    h2, row2 = pairs(h, row)
    return (np.concatenate((h, h2)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate((row, row2))


_PLAIN = np.zeros(256, bool)
_PLAIN[:33] = _PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True
_PLAIN[np.frombuffer(b".,;:'\"?-()", np.uint8)] = True

SHAPE = ("log_bytes", "symbols", "upper", "bars", "digits")


def shape(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the columns of SHAPE, as shares of its bytes but for the first."""
    n = np.diff(at).astype(float)
    share = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[at]) / np.maximum(n, 1)
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    return np.stack([np.log1p(n) / 10, share(~_PLAIN[raw]), share(upper), share(raw == 124), share(digit)], 1)


def presence(raw: np.ndarray, at: np.ndarray, column_of: np.ndarray, n: int) -> np.ndarray:
    """0/1 matrix: text by chosen bucket. column_of has the column of each bucket, or -1."""
    b, row = buckets(raw, at)
    k = column_of[b]
    out = np.zeros((len(at) - 1, n))
    out[row[k >= 0], k[k >= 0]] = 1
    return out


def bucket_sets(docs: DataFrame, rest: list[str]) -> DataFrame:
    """docs (text, rest...) as rest..., buckets (distinct, sorted) and shape."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, shapes = [], []
            for _, _, raw, at in slices(b.column(0)):
                found, row = buckets(raw, at)
                both = np.unique(row * (1 << BUCKET_BITS) + found)
                cut = np.searchsorted(both, np.arange(1, len(at) - 1) << BUCKET_BITS)
                sets += [s.astype(np.int32) for s in np.split(both & ((1 << BUCKET_BITS) - 1), cut)]
                shapes += shape(raw, at).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64()))], [*rest, "buckets", "shape"])

    return docs.select("text", *rest).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in rest) + ", buckets array<int>, shape array<double>")


def telling_buckets(sets: DataFrame, target: str, most: int, support: int = 5, least_z: float = 4.5) -> list[int]:
    """The buckets whose share of positives differs most from the overall share, in standard deviations, by at least
    `least_z` of them, beyond what chance does among a million; counted in Spark, so only `most` rows come to the driver."""
    n, base = sets.agg(F.count("*"), F.avg(target)).first()
    base = min(max(base or 0.0, 1e-3), 1 - 1e-3)
    each = sets.select(F.explode("buckets").alias("bucket"), F.col(target).alias("y")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    z = F.abs(F.col("y") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1)
    return [r.bucket for r in each.filter((F.col("n") >= support) & (F.col("n") <= 0.9 * n) & (z >= least_z)).orderBy(z.desc(), "bucket").limit(most).collect()]


def telling_by_fold(sets: DataFrame, targets: list[str], folds: int, most: int, support: int = 5, least_z: float = 4.5) -> tuple[list[int], dict[tuple[str, int | None], list[int]]]:
    """The same for several 0/1 columns, from all rows (None) and from the rows outside of each fold (column `fold`), so that no fold's own labels
    choose what its model reads. Buckets, and for each column and fold the places of its own among them; at most `most` of each."""
    own = lambda f: F.lit(1) if f is None else (F.col("fold") != f).cast("int")
    ways = [None, *range(folds)]
    names = {(t, f): f"z{i}" for i, (t, f) in enumerate((t, f) for t in targets for f in ways)}
    whole = sets.agg(*(F.sum(own(f)).alias(f"n{i}") for i, f in enumerate(ways)), *(F.sum(own(f) * F.col(t)).alias(z) for (t, f), z in names.items())).first()
    if not whole["n0"]:
        return [], {k: [] for k in names}
    each = sets.select(F.explode("buckets").alias("bucket"), "fold", *targets).groupBy("bucket").agg(*(F.sum(own(f)).alias(f"n{i}") for i, f in enumerate(ways)), *(F.sum(own(f) * F.col(t)).alias(z) for (t, f), z in names.items()))
    columns = []
    for (t, f), z in names.items():
        i = ways.index(f)
        total = max(whole[f"n{i}"] or 0, 1)
        base = min(max((whole[z] or 0) / total, 1e-3), 1 - 1e-3)
        n = F.col(f"n{i}")
        usable = (n >= support) & (n <= 0.9 * total)
        columns.append(F.when(usable, F.abs(F.col(z) - n * base) / F.sqrt(n * base * (1 - base) + 1)).otherwise(0.0).alias(z))
    best = F.greatest(*(F.col(z) for z in names.values())) if len(names) > 1 else F.col(next(iter(names.values())))
    rows = each.select("bucket", *columns).filter(best >= least_z).orderBy(best.desc(), "bucket").limit(most * len(names)).collect()
    chosen = {k: sorted((i for i, r in enumerate(rows) if r[z] >= least_z), key=lambda i: (-rows[i][z], rows[i].bucket))[:most] for k, z in names.items()}
    read = sorted({i for own in chosen.values() for i in own})
    place = {i: n for n, i in enumerate(read)}
    return [rows[i].bucket for i in read], {k: [place[i] for i in own] for k, own in chosen.items()}


def column_index(chosen: list[int]) -> np.ndarray:
    out = np.full(1 << BUCKET_BITS, -1, np.int32)
    out[chosen] = np.arange(len(chosen))
    return out


def matrix(sets: DataFrame, chosen: list[int], extra: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The bounded sample as a matrix (chosen buckets, then SHAPE), and its extra columns; only chosen buckets are sent."""
    rows = sets.select(F.array_intersect("buckets", F.lit(chosen).cast("array<int>")).alias("b"), "shape", *extra).toPandas()
    x = np.zeros((len(rows), len(chosen)))
    column = {b: k for k, b in enumerate(chosen)}
    for i, own in enumerate(rows["b"]):
        x[i, [column[b] for b in own]] = 1
    shapes = np.array(rows["shape"].tolist()).reshape(len(rows), len(SHAPE))
    return np.hstack([x, shapes]), {c: rows[c].to_numpy() for c in extra}
