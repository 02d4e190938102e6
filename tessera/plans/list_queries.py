"""Queries over ordered lists: documents of a source as the pages of a plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import lists
from tessera.plans.registry import query, table

_PLAN = "SELECT source AS plan_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id AS id FROM documents"


def _plan(spark, sf_dir):
    pos = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("plan_id"), pos.alias("pos"), F.col("doc_id").alias("id"), F.lit("page").alias("kind"), F.lit(0).alias("rotate"))


@query(f"SELECT plan_id, id, row_number() OVER (PARTITION BY plan_id ORDER BY pos) - 1 AS pos FROM ({_PLAN}) WHERE id % 5 <> 0")
def plan_remove(spark, sf_dir):
    return lists.remove(_plan(spark, sf_dir), F.col("id") % 5 == 0).select("plan_id", "id", "pos")


@query(
    f"""WITH m AS (SELECT *, id % 7 = 0 AS m, sum((id % 7 <> 0)::INT) OVER (PARTITION BY plan_id ORDER BY pos) - 1 AS rest FROM ({_PLAN}))
SELECT plan_id, id, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN m THEN 1 WHEN rest < 3 THEN 0 ELSE 2 END, pos) - 1 AS pos FROM m"""
)
def plan_move(spark, sf_dir):
    """Every seventh document to position 3."""
    return lists.move(_plan(spark, sf_dir), F.col("id") % 7 == 0, 3).select("plan_id", "id", "pos")


@query(
    f"""WITH m AS (SELECT *, id % 4 = 0 AS m FROM ({_PLAN})), c AS (SELECT *, CASE WHEN sum(m::INT) OVER (PARTITION BY plan_id) >= 2 THEN m ELSE true END AS x FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY plan_id, x ORDER BY pos) AS f, row_number() OVER (PARTITION BY plan_id, x ORDER BY pos DESC) AS b FROM c)
SELECT a.plan_id, a.id, CASE WHEN a.x THEN b.pos ELSE a.pos END AS pos FROM k a LEFT JOIN k b ON b.plan_id = a.plan_id AND b.x AND b.f = a.b AND a.x"""
)
def plan_reverse_picked(spark, sf_dir):
    return lists.reverse(_plan(spark, sf_dir), F.col("id") % 4 == 0).select("plan_id", "id", "pos")


@query(f"SELECT plan_id, id, max(pos) OVER (PARTITION BY plan_id) - pos AS pos FROM ({_PLAN})")
def plan_reverse(spark, sf_dir):
    return lists.reverse(_plan(spark, sf_dir)).select("plan_id", "id", "pos")


@query(f"SELECT plan_id, id, row_number() OVER (PARTITION BY plan_id ORDER BY o) - 1 AS pos FROM (SELECT plan_id, id::VARCHAR AS id, pos::DOUBLE AS o FROM ({_PLAN}) UNION ALL SELECT plan_id, 'blank-1', least(3, count(*)) - 0.5 FROM ({_PLAN}) GROUP BY plan_id)")
def plan_insert_blank(spark, sf_dir):
    plan = _plan(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return lists.insert_blank(plan, 2, 595.0, 842.0).select("plan_id", "id", "pos")


@query(f"SELECT plan_id, id, pos FROM (SELECT *, min(pos) FILTER (pos % 11 = 9) OVER (PARTITION BY plan_id) AS a, min(pos) FILTER (pos % 5 = 3) OVER (PARTITION BY plan_id) AS b FROM ({_PLAN})) WHERE pos BETWEEN least(a, b) AND greatest(a, b)")
def plan_between(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    first, last = F.when(F.col("pos") % 11 == 9, F.col("id")), F.when(F.col("pos") % 5 == 3, F.col("id"))
    return lists.between(plan, first, last).select("plan_id", "id", "pos")


@query(f"SELECT plan_id, count(*) = count(DISTINCT pos) AND min(pos) = 0 AND max(pos) = count(*) - 1 AS valid FROM (SELECT plan_id, CASE WHEN plan_id = 'src3' THEN pos + 1 ELSE pos END AS pos FROM ({_PLAN})) GROUP BY plan_id")
def plan_permutation(spark, sf_dir):
    plan = _plan(spark, sf_dir).withColumn("pos", F.when(F.col("plan_id") == "src3", F.col("pos") + 1).otherwise(F.col("pos")))
    return lists.is_permutation(plan, "plan_id", "pos")


@query(
    """WITH d AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 40 AS v FROM orders), i AS (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) AS g FROM d), r AS (SELECT k, g, min(v) AS a, max(v) AS b FROM i GROUP BY k, g)
SELECT k AS o_custkey, string_agg(CASE WHEN a = b THEN (a + 1)::VARCHAR ELSE (a + 1) || '-' || (b + 1) END, ', ' ORDER BY a) AS runs FROM r GROUP BY k"""
)
def runs_text(spark, sf_dir):
    return lists.runs_text(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("v")), "o_custkey", "v")


@query(
    """WITH t AS (SELECT doc_id, (doc_id % 9) || '-' || (doc_id % 13 + 2) || ', ' || (doc_id % 17) AS spec, doc_id % 13 + 2 AS b, doc_id % 9 AS a, doc_id % 17 AS c FROM documents)
SELECT doc_id, list_sort(list_distinct(list_concat(list_transform(range(greatest(1, least(a, b)), least(12, greatest(a, b)) + 1), lambda x: x - 1), CASE WHEN c BETWEEN 1 AND 12 THEN [c - 1] ELSE [] END)))::INT[] AS pages FROM t"""
)
def page_list_parse(spark, sf_dir):
    """Page lists of a 12-page document, read from text."""
    d = F.col("doc_id")
    spec = F.concat((d % 9).cast("string"), F.lit("-"), (d % 13 + 2).cast("string"), F.lit(", "), (d % 17).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", lists.page_list(spec, F.lit(12)).alias("pages"))
