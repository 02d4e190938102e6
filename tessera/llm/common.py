"""What several operators share: tables, written intermediate results, components, UTF-8 word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.stash import Stash


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, whose rows have a bounded width, for a join: broadcast if it has at most `most` rows, shuffled otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := "_" * k + name) not in taken)


def components(edges: DataFrame, stash: Stash, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both BIGINT: one row (node, root) for each node that has an edge, root
    being the smallest node reachable. Alternating large and small stars; each round is written, none is collected."""
    step = lambda e, n: stash.put(e.filter("a <> b").distinct(), n)
    now, seen = step(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges"), None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = step(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = step(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "small")
        stash.drop(now, large)
        now = small
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- UTF-8 text of a batch as arrays -------------------------------------------------------------------------------

_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            one = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64)
            _POWERS["p"], _POWERS["i"] = one(np.uint64(_B)), one(np.uint64(pow(_B, -1, 1 << 64)))
    return _POWERS["p"], _POWERS["i"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about `most` bytes and at most `rows` rows; no text is cut. Only those rows are copied."""
    for first in range(0, len(column), rows):
        raw, at = utf8(column.slice(first, rows))
        row, n = 0, len(at) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield first + row, first + end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[128:] = _WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[39] = True


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (letters, digits, apostrophe, any non-ASCII byte) of texts: hash in lower case, row, start and end byte."""
    if not len(raw):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    is_word = _WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    before = np.concatenate(([False], is_word[:-1]))
    start = np.flatnonzero(is_word & (~before | first))
    after, cut = np.concatenate((is_word[1:], [False])), np.concatenate((first[1:], [True]))
    end = np.flatnonzero(is_word & (~after | cut)) + 1
    power, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))
        h = mixed((total[end] - total[start]) * inverse[start])
    return h, np.searchsorted(at, start, "right") - 1, start, end


def pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each two neighbouring words of one text."""
    if len(h) < 2:
        return h[:0], row[:0]
    with np.errstate(over="ignore"):
        both = mixed(h[:-1] * np.uint64(3) + h[1:])
    same = row[:-1] == row[1:]
    return both[same], row[:-1][same]
