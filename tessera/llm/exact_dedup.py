"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries style frequent-items sketch (Spark's approx_top_k, mergeable and of fixed size) proposes at most `most_heavy`
digests. Their groups are counted exactly with map-side partial sums, and the winners, at most `most_heavy` rows, are
broadcast, so rows of hot groups never cross the network. All other digests take one ordinary shuffle.

Cases: null text counts as empty; a null id loses to any other and an all-null group has keep_id null; of rows that agree
in id and text exactly one is kept; an empty table gives no rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Stash, read_table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_heavy: int = 1024, tracked: int = 8192) -> DataFrame:
    """One row for each row of docs: id, keep_id (largest id of the group), group_size, kept, text_sha256."""
    stash = Stash(docs.sparkSession)
    rows = stash.put(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),  # written, so that it never changes afterwards
        ),
        "digests",
    )
    best = F.max(F.struct("doc_id", "row_no"))
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {int(most_heavy)}, {int(tracked)})").alias("top"))
    proposed = stash.put(sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"), F.col("t.count").alias("about")).filter("about > 1").select("text_sha256"), "proposed")
    winners = stash.put(rows.join(F.broadcast(proposed), "text_sha256").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")), "winners")
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    one = Window.partitionBy("text_sha256")
    light = marked.filter("best IS NULL").select("doc_id", "text_sha256", "row_no", best.over(one).alias("best"), F.count("*").over(one).alias("group_size"))
    both = marked.filter("best IS NOT NULL").select(*light.columns).union(light)
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256")


QUERY = "op3_exact_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
