"""Sequences of a page or a document: numbering, smoothing, bands, plans and differences."""

from __future__ import annotations

from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


def numbered(rows: DataFrame, keys: list[str], start: Column, levels: int = 9) -> DataFrame:
    """rows (pos, level from 0, scheme or null) with number. A counter goes on while its level and scheme do; an item of a lower level, a
    paragraph without number or another scheme at the level starts it anew."""
    w = Window.partitionBy(*keys).orderBy("pos")
    above = F.coalesce(*(F.when(F.col("level") == k, F.coalesce(F.max(F.when(F.col("level") < k, F.col("pos"))).over(w), F.lit(0))) for k in range(levels)))
    rows = rows.withColumn("__above", above)
    own = Window.partitionBy(*keys, "level", "__above").orderBy("pos")
    goes_on = F.coalesce(F.col("scheme") == F.lag("scheme").over(own), F.lit(False))
    rows = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(own))
    place = F.row_number().over(Window.partitionBy(*keys, "level", "__above", "__run").orderBy("pos"))
    return rows.withColumn("number", F.when(F.col("scheme").isNotNull(), start - 1 + place)).drop("__above", "__new", "__run")


def smoothed(rows: DataFrame, keys: list[str], order: str, kind: str, lone: str, becomes: str) -> DataFrame:
    """A row of the kind `lone` without a neighbour of its kind becomes the other. Doing so in place changes nothing: what was rewritten
    before a row had no neighbour of the kind, so it was not this row."""
    w = Window.partitionBy(*keys).orderBy(order)
    beside = lambda c: F.coalesce(c == lone, F.lit(False))
    alone = (F.col(kind) == lone) & ~beside(F.lag(kind).over(w)) & ~beside(F.lead(kind).over(w))
    return rows.withColumn(kind, F.when(alone, becomes).otherwise(F.col(kind)))


def banded(rows: DataFrame, keys: list[str], order: str, two: str, side: str) -> DataFrame:
    """Reading order: neighbouring rows in two columns are a band, whose left side (0) is read before its right one (1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    joins = F.col(two) & F.coalesce(F.lag(two).over(w), F.lit(False))
    rows = rows.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("__band", F.sum("__new").over(w))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__band", F.when(F.col(two), F.col(side)).otherwise(0), order))
    return rows.withColumn("place", place).drop("__new", "__band")


def is_identity(plan: Column, first: int = 0) -> Column:
    """Whether a plan is first, first + 1, and so on."""
    return F.forall(F.transform(plan, lambda p, i: p == i + first), lambda x: x)


def remapped(notes: DataFrame, kept: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Notes on the pages that stay, with each page's place among those of its document (keys); others go."""
    new = kept.select(*keys, F.col(page).alias("__old")).distinct().withColumn("__new", F.row_number().over(Window.partitionBy(*keys).orderBy("__old")))
    return notes.withColumnRenamed(page, "__old").join(new, [*keys, "__old"]).drop("__old").withColumnRenamed("__new", page)


def _longest_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence by bit rows: bit k of a row for a[i:] is set where one more line at the end of b makes it longer. A row comes from
    the one below by one addition of numbers with a bit for each line of b. Read from the front; where both ways are as long, a line of a is passed."""
    where: dict[str, int] = {}
    for k, line in enumerate(reversed(b)):
        where[line] = where.get(line, 0) | 1 << k
    every = (1 << len(b)) - 1
    free, grows = every, [0]
    for line in reversed(a):
        hit = free & where.get(line, 0)
        free = (free + hit | free - hit) & every
        grows.append(every ^ free)
    grows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        rest = (1 << len(b) - j) - 1
        passed = (grows[i] & rest).bit_count() == (grows[i + 1] & rest).bit_count()
        i, j = (i + 1, j) if passed else (i, j + 1)
    return out


def matched_lines(a: Column, b: Column, most: int | None = 1_000_000) -> Column:
    """Pairs of places (from 0) of equal lines of two lists: what both begin with, what both end with, and a longest common
    subsequence of what lies between, unless that has over `most` pairs of lines, of which none is matched then. Memory is one bit for each such pair."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def pairs(x: list[str], y: list[str]) -> list[dict]:
        head = len(commonprefix([x, y]))
        tail = len(commonprefix([x[head:][::-1], y[head:][::-1]]))
        u, v = x[head : len(x) - tail], y[head : len(y) - tail]
        between = [] if most is not None and len(u) * len(v) > most else _longest_common(u, v)
        found = [(k, k) for k in range(head)] + [(head + i, head + j) for i, j in between] + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
        return [{"a": i, "b": j} for i, j in found]

    returned = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))
    return F.arrow_udf(lambda x, y: pa.array([pairs(p or [], q or []) for p, q in zip(x.to_pylist(), y.to_pylist())], kind), returned)(a, b)
