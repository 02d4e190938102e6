"""Joins of intervals that overlap, without forming the pairs that don't.

An interval of length L belongs to the level with cells of the least power of two that is not under L, where it touches two cells at most.
Of two intervals, the shorter one (or either, on one level) is looked up among the cells of the longer one's level, of which it touches two at most too.
So each row is sent out for two cells a level and side, a pair meets where both touch a cell, and of two such cells only the first one counts.
The levels in use are read beforehand; they are as many as there are orders of magnitude (powers of two) of length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _levelled(df: DataFrame, lo: str, hi: str, side: str) -> DataFrame:
    """df as one struct `row_<side>` with its bounds and level; rows without proper bounds overlap nothing and go."""
    low, high = F.col(lo).cast("double"), F.col(hi).cast("double")
    level = F.when(high - low <= 2.0**-20, -20).otherwise(F.ceil(F.log2(high - low))).cast("int")
    return df.filter(low <= high).select(F.struct(*df.columns).alias(f"row_{side}"), low.alias(f"lo_{side}"), high.alias(f"hi_{side}"), level.alias(f"level_{side}"))


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs (l, r: structs of the rows) that agree in `on` and whose closed intervals touch or overlap. Nulls in `on` meet nothing."""
    a, b = _levelled(left, *left_bounds, "l"), _levelled(right, *right_bounds, "r")
    levels = {s: [r[0] for r in df.select(f"level_{s}").distinct().collect()] for s, df in (("l", a), ("r", b))}  # one for each power of two of length

    def met(short: str, long: str, low: DataFrame, high: DataFrame, same: bool) -> DataFrame:
        """Pairs in which the row of `short` is of a lower level, or the same one."""
        taller = F.filter(F.array(*(F.lit(x) for x in sorted(levels[long]))), lambda x: (x >= F.col(f"level_{short}")) if same else (x > F.col(f"level_{short}")))
        cells = lambda s, at: F.explode(F.sequence(_cell(F.col(f"lo_{s}"), at), _cell(F.col(f"hi_{s}"), at)))
        key = lambda s: [F.col(f"row_{s}")[c].alias(c) for c in on]
        probe = low.withColumn("level", F.explode(taller)).withColumn("cell", cells(short, F.col("level"))).select(*key(short), "level", "cell", *low.columns)
        held = high.withColumn("level", F.col(f"level_{long}")).withColumn("cell", cells(long, F.col("level"))).select(*key(long), "level", "cell", *high.columns)
        both = probe.join(held, [*on, "level", "cell"])
        first = _cell(F.greatest("lo_l", "lo_r"), F.col("level"))
        return both.filter((F.col("lo_l") <= F.col("hi_r")) & (F.col("lo_r") <= F.col("hi_l")) & (F.col("cell") == first)).select(F.col("row_l").alias("l"), F.col("row_r").alias("r"))

    if not levels["l"] or not levels["r"]:
        return left.limit(0).select(F.struct(*left.columns).alias("l")).crossJoin(right.limit(0).select(F.struct(*right.columns).alias("r")))
    return met("l", "r", a, b, True).union(met("r", "l", b, a, False))


#: Rows that a task takes at once (and the rest of the last table), and cells from which a table's rows are dealt to several tasks.
AT_ONCE, LARGE_TABLE = 100_000, 1_000_000


class _Spans:
    """Closed intervals [a, b] of many tables, counted against given bounds of given tables. NaN is above all numbers, as in SQL."""

    def __init__(self, t: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.n = np.sort(a), np.sort(b), len(a) + 1
        starts, ends = t * self.n + np.searchsorted(self.a, a), t * self.n + np.searchsorted(self.b, b)
        order = np.argsort(starts, kind="stable")
        self.starts, self.ends, self.end_by_start = starts[order], np.sort(ends), (ends - t * self.n)[order]

    def begun(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Intervals of any table before t and those of t with a <= at."""
        return np.searchsorted(self.starts, t * self.n + np.searchsorted(self.a, at, "right"))

    def ended(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same with b < at."""
        return np.searchsorted(self.ends, t * self.n + np.searchsorted(self.b, at))

    def between(self, t: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Intervals of t with low < a and b < high: those from a place on in the order of a whose b has a lower rank, counted bit by bit of the rank."""
        first, last = self.begun(t, low), np.searchsorted(self.starts, (t + 1) * self.n)
        under, held, found = np.searchsorted(self.b, high), self.end_by_start, np.zeros(len(t), dtype=np.int64)
        for bit in reversed(range(int(self.n).bit_length())):
            zero = held >> bit & 1 == 0
            upto = np.r_[0, np.cumsum(zero)]
            one = under >> bit & 1 == 1
            found += np.where(one, upto[last] - upto[first], 0)
            first, last = (np.where(one, upto[-1] + x - upto[x], upto[x]) for x in (first, last))
            held = np.r_[held[zero], held[~zero]]
        return found


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    return np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])] if len(keys[0]) else np.zeros(0, dtype=bool)


def _counted(t: np.ndarray, row: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, proper: np.ndarray, at: np.ndarray, anchor: np.ndarray, x: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """For cells (t, row, cell, lo, hi) and anchors (at, anchor, x, right) as numbers, -1 for null names: the first cell of each row, its cells, those
    aligned and the anchors claimed.

    A row touches what its cells' union touches. Each anchor counts for the first part of the union that it touches: it begins behind the part before and not
    behind this one, and does not end before it. That is a difference of counts and needs no pairs; only anchors of several intervals are compared one by one."""
    order = np.lexsort((lo, row, t))
    t, row, cell, lo, hi, proper = (v[order] for v in (t, row, cell, lo, hi, proper))
    new = _first_of_runs(t, row)
    no = np.cumsum(new) - 1
    n = int(no[-1]) + 1
    every = _Spans(at, x, right)
    touched = proper & (every.begun(t, hi) > every.ended(t, lo))
    named = np.flatnonzero(touched & (cell >= 0))
    named = named[np.lexsort((cell[named], no[named]))]
    aligned = np.bincount(no[named][_first_of_runs(no[named], cell[named])], minlength=n)
    # parts of the union: a cell that begins behind all ends before it in its row begins one
    g, lo, hi, t = no[proper], lo[proper], hi[proper], t[proper]
    ends = np.sort(hi)
    reach = np.maximum.accumulate(g * (len(g) + 1) + np.searchsorted(ends, hi)) - g * (len(g) + 1)
    head = _first_of_runs(g)
    head[1:] |= np.searchsorted(ends, lo[1:]) > reach[:-1]
    heads = np.flatnonzero(head)
    pg, pt, low = g[heads], t[heads], lo[heads]
    high = ends[reach[np.r_[heads[1:], len(g)][: len(heads)] - 1]]
    by = np.lexsort((anchor, at))
    run = _first_of_runs(at[by], anchor[by])
    single = np.zeros(len(at), dtype=bool)
    single[by] = run & np.r_[run[1:], True] if len(run) else run
    single &= anchor >= 0
    ones = _Spans(at[single], x[single], right[single])
    claims = ones.begun(pt, high) - ones.ended(pt, low)
    later = np.flatnonzero(~_first_of_runs(pg))
    claims[later] = ones.begun(pt[later], high[later]) - ones.begun(pt[later], high[later - 1]) - ones.between(pt[later], high[later - 1], low[later])
    claimed = np.bincount(pg, weights=claims, minlength=n).astype(np.int64)
    several = by[~single[by] & (anchor[by] >= 0)]
    for group in np.split(several, np.flatnonzero(_first_of_runs(at[several], anchor[several]))[1:]) if len(several) else ():
        mine = slice(*np.searchsorted(pt, [at[group[0]], at[group[0]] + 1]))
        ranks = [(np.searchsorted(ends, x[k]), right[k]) for k in group]
        hit = np.logical_or.reduce([(np.searchsorted(ends, high[mine]) >= a) & ~_after(low[mine], b) for a, b in ranks])
        claimed[np.unique(pg[mine][hit])] += 1
    return order[new], np.bincount(no, minlength=n), aligned, claimed


def _after(a: np.ndarray, b: float) -> np.ndarray:
    """a > b, NaN above all numbers."""
    return (a > b) | (np.isnan(a) & (b == b))


def cells_under_anchors(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """cells (table_no, row_no, cell_no, x, right, slack) with the anchors (table_no, anchor_no, x, right) that they touch, give or take slack: one row
    for each row of the table, with aligned (cells that touch an anchor), claimed (anchors that are touched) and n_cells.

    Tables are dealt to tasks, which count without forming pairs, many small tables at once; rows of a table with more than a million cells are dealt too. A
    task holds all anchors of a table, about a hundred bytes each."""
    key = ["table_no", "row_no"]
    kind = {c: df.schema[c].dataType.simpleString() for df, cs in ((cells, [*key, "cell_no"]), (anchors, ["anchor_no"])) for c in cs}
    lost = cells.filter("table_no IS NULL OR row_no IS NULL").groupBy(*key).agg(F.count("*").alias("n_cells"), F.lit(0).cast("long").alias("aligned"), F.lit(0).cast("long").alias("claimed"))
    real = cells.filter("table_no IS NOT NULL AND row_no IS NOT NULL")
    low, high = (F.col("x") - F.col("slack")).cast("double"), (F.col("right") + F.col("slack")).cast("double")
    own = real.select(*key, "cell_no", F.lit(None).cast(kind["anchor_no"]).alias("anchor_no"), F.when(low <= high, low).alias("lo"), F.when(low <= high, high).alias("hi"))
    x, right = F.col("x").cast("double"), F.col("right").cast("double")
    given = anchors.filter(F.col("table_no").isNotNull() & (x <= right)).select("table_no", F.lit(None).cast(kind["row_no"]).alias("row_no"), F.lit(None).cast(kind["cell_no"]).alias("cell_no"), "anchor_no", x.alias("lo"), right.alias("hi"))
    large = F.broadcast(real.groupBy("table_no").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_TABLE).select("table_no", F.ceil(F.col("n") / LARGE_TABLE).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = own.join(large, "table_no", "left").withColumn("part", F.pmod(F.hash("row_no"), parts)).drop("parts")
    dealt = dealt.unionByName(given.join(large, "table_no", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"))

    def solved(rows: pa.Table) -> pa.RecordBatch:
        code = lambda c, of: np.asarray(c.combine_chunks().dictionary_encode().indices.fill_null(-1)).astype(np.int64)[of]
        bound = lambda c, of: c.to_numpy()[of]
        mine = np.flatnonzero(np.asarray(pc.is_valid(rows["row_no"])))
        theirs = np.flatnonzero(np.asarray(pc.is_null(rows["row_no"])))
        if not len(mine):
            return pa.RecordBatch.from_pylist([], schema=pa.schema([rows.schema.field("table_no"), rows.schema.field("row_no"), *((c, pa.int64()) for c in ("n_cells", "aligned", "claimed"))]))
        ours = [code(rows[c], mine) for c in ("table_no", "row_no", "cell_no")] + [bound(rows[c], mine) for c in ("lo", "hi")]
        first, *found = _counted(*ours, np.asarray(pc.is_valid(rows["lo"]))[mine], code(rows["table_no"], theirs), code(rows["anchor_no"], theirs), bound(rows["lo"], theirs), bound(rows["hi"], theirs))
        names = [rows[c].combine_chunks().take(pa.array(mine[first])) for c in key]
        return pa.RecordBatch.from_arrays([*names, *(pa.array(v.astype(np.int64)) for v in found)], names=[*key, "n_cells", "aligned", "claimed"])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole tables, some at a time."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                rows = pa.Table.from_batches(held)
                last = np.logical_and(*(np.asarray(pc.equal(rows[c], rows[c][-1])) for c in ("table_no", "part")))
                end = int(np.argmax(last))
                if end:
                    yield solved(rows.slice(0, end))
                held = rows.slice(end).to_batches()
                n = 0
        if held:
            yield solved(pa.Table.from_batches(held))

    ready = dealt.repartition("table_no", "part").sortWithinPartitions("table_no", "part")
    found = ready.mapInArrow(tables, f"table_no {kind['table_no']}, row_no {kind['row_no']}, n_cells long, aligned long, claimed long")
    return found.unionByName(lost)


def line_words(words: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """words (page columns, word_no, x0, y0, x1, y1) with line_no, from 0 by height: going by y0, x0 and word_no, a word joins the first line
    whose first word it overlaps by more than `share` of the lower one of both heights, or begins a line. Words without a page go.

    Pages are dealt to tasks and read once in that order; of a page only the first words that reach below the word at hand are held. As any two of
    them overlap by less than that share, they are few however many words a page has."""
    height = ["_top", "_end"]
    kept = words.columns
    named = words.filter(F.forall(F.array(*(F.col(c).isNotNull() for c in page)), lambda x: x))
    # NaN is above all numbers, and a null height is NaN in the pass
    dealt = named.repartition(*page).sortWithinPartitions(*page, "y0", "x0", "word_no").withColumns({"_top": F.col("y0").cast("double"), "_end": F.nanvl(F.col("y1").cast("double"), F.lit(float("inf")))})

    def lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: list[tuple[float, float, int]] = []
        at, n = None, 0
        for batch in batches:
            out = []
            where = zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in page))
            for here, top, end in zip(where, *(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in height)):
                if here != at:
                    at, live, n = here, [], 0
                for a, b, line in live:
                    low, tall = (b if b < end else end), (b - a if b - a < end - top else end - top)
                    if low >= top and low - top > share * tall:
                        out.append(line)
                        break
                else:
                    out.append(n)
                    if top <= end:  # else it has no height, and none joins it
                        live = [x for x in live if x[1] > top or share < 0 and x[1] == top]
                        live.append((top, end, n))
                    n += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int32())], names=[*kept, "line_no"])

    return dealt.mapInArrow(lined, StructType([*words.schema.fields, StructField("line_no", IntegerType(), False)]))
