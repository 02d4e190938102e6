"""Ordered lists as rows (plan_id, pos, id, ...): positions are data and are computed anew, from 0, by each operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy("plan_id").orderBy(*order)) - 1).cast("long"))


def append(plan: DataFrame, more: DataFrame) -> DataFrame:
    """Another list's rows at the end."""
    return _placed(plan.withColumn("_part", F.lit(0)).unionByName(more.withColumn("_part", F.lit(1))), F.col("_part"), F.col("pos")).drop("_part")


def remove(plan: DataFrame, picked: Column) -> DataFrame:
    return _placed(plan.filter(~F.coalesce(picked, F.lit(False))), F.col("pos"))


def select(plan: DataFrame, picked: Column) -> DataFrame:
    return _placed(plan.filter(picked), F.col("pos"))


def move(plan: DataFrame, picked: Column, to: int) -> DataFrame:
    """The picked rows together, in order, so that the first of them lands at `to`."""
    one = Window.partitionBy("plan_id")
    marked = plan.withColumn("_m", F.coalesce(picked, F.lit(False)))
    rest = F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(one.orderBy("pos")) - 1
    at = F.least(F.lit(max(0, to)), F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(one))
    part = F.when(F.col("_m"), 1).when(F.col("_rest") < F.col("_at"), 0).otherwise(2)
    return _placed(marked.withColumn("_rest", rest).withColumn("_at", at), part, F.col("pos")).drop("_m", "_rest", "_at")


def rotate(plan: DataFrame, picked: Column, delta: int) -> DataFrame:
    return plan.withColumn("rotate", F.when(picked, F.pmod(F.col("rotate") + delta, F.lit(360))).otherwise(F.col("rotate")))


def reverse(plan: DataFrame, picked: Column | None = None) -> DataFrame:
    """All rows in reverse; with two or more picked in a list only those change places among themselves."""
    one = Window.partitionBy("plan_id")
    marked = plan.withColumn("_m", F.coalesce(picked, F.lit(False)) if picked is not None else F.lit(False))
    marked = marked.withColumn("_m", F.when(F.sum(F.col("_m").cast("int")).over(one) >= 2, F.col("_m")).otherwise(F.lit(True)))
    group = Window.partitionBy("plan_id", "_m")
    ranked = marked.withColumn("_k", F.row_number().over(group.orderBy("pos"))).withColumn("_b", F.row_number().over(group.orderBy(F.desc("pos"))))
    places = ranked.filter("_m").select("plan_id", F.col("_k").alias("_b"), F.col("pos").alias("_to"))
    moved = ranked.join(places, ["plan_id", "_b"], "left")
    return moved.withColumn("pos", F.when(F.col("_m"), F.col("_to")).otherwise(F.col("pos"))).select(*plan.columns)


def insert_blank(plan: DataFrame, after: int, width: float, height: float) -> DataFrame:
    """A blank row after position `after` (-1: first) of each list; other columns are null."""
    blank = plan.groupBy("plan_id").agg(F.least(F.lit(after + 1), F.count("*")).alias("_at")).select("plan_id", (F.col("_at") - 0.5).alias("_o"), F.lit("blank-1").alias("id"), F.lit("blank").alias("kind"), F.lit(0).alias("rotate"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    both = plan.withColumn("_o", F.col("pos").cast("double")).unionByName(blank, allowMissingColumns=True)
    return _placed(both, F.col("_o")).drop("_o")


def between(plan: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows from one id to another, either way round."""
    one = Window.partitionBy("plan_id")
    ends = plan.withColumn("_a", F.min(F.when(F.col("id") == first, F.col("pos"))).over(one)).withColumn("_b", F.min(F.when(F.col("id") == last, F.col("pos"))).over(one))
    return ends.filter(F.col("pos").between(F.least("_a", "_b"), F.greatest("_a", "_b"))).drop("_a", "_b")


def is_permutation(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group whether its values are 0 to n - 1, each once."""
    return rows.groupBy(group).agg(((F.count("*") == F.countDistinct(value)) & (F.min(value) == 0) & (F.max(value) == F.count("*") - 1)).alias("valid"))


def page_list(text: Column, page_count: Column) -> Column:
    """"2-4, 7" as sorted distinct 0-based pages; open ends reach the first or last page; other words are left out."""
    tokens = F.split(F.regexp_replace(text, r"\s*[-–]\s*", "-"), r"[,;\s]+")

    def pages(t: Column) -> Column:
        a, b = F.regexp_extract(t, r"^(\d*)-(\d*)$", 1), F.regexp_extract(t, r"^(\d*)-(\d*)$", 2)
        low = F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(a != "", a.try_cast("int")).when(t.rlike(r"^-\d+$"), 1)
        high = F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(b != "", b.try_cast("int")).when(t.rlike(r"^\d+-$"), page_count)
        first, last = F.greatest(F.lit(1), F.least(low, high)), F.least(page_count, F.greatest(low, high))
        return F.when(low.isNotNull() & high.isNotNull() & (first <= last), F.transform(F.sequence(first, last), lambda n: n - 1)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))


def page_ranges(text: Column, page_count: Column) -> Column:
    """"1-3, 5" as one list of 0-based pages for each range, in the order typed; parts outside the document are dropped."""
    ends = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^\s,;])\d+(?:\s*[-–]\s*\d*)?(?![^\s,;])"), F.lit(0)), lambda t: F.transform(F.split(t, r"\s*[-–]\s*"), lambda n: n.try_cast("int")))
    both = F.transform(ends, lambda e: F.array(F.get(e, 0), F.when(F.size(e) > 1, F.coalesce(F.get(e, 1), page_count)).otherwise(F.get(e, 0))))
    inside = F.filter(F.transform(both, lambda e: F.array(F.greatest(F.array_min(e), F.lit(1)), F.least(F.array_max(e), page_count))), lambda e: e[0] <= e[1])
    return F.transform(inside, lambda e: F.sequence(e[0] - 1, e[1] - 1))


def runs_text(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group its distinct numbers, from 0, as "2-4, 7" (from 1)."""
    island = rows.select(group, value).distinct().withColumn("_i", F.col(value) - F.row_number().over(Window.partitionBy(group).orderBy(value)))
    runs = island.groupBy(group, "_i").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), (F.col("_a") + 1).cast("string")).otherwise(F.concat((F.col("_a") + 1).cast("string"), F.lit("-"), (F.col("_b") + 1).cast("string")))
    return runs.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_a", text.alias("t")))), lambda s: s["t"]), ", ").alias("runs"))
