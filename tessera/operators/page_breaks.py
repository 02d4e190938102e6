"""Paragraphs and tables that run on over a page break, by windows over the blocks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.documents import joined_tables

# What a page number looks like, and how a sentence ends.
PAGE_NUMBER = r"(?i)^(?:page\s+)?[-–—]?\s*(?:\d{1,4}|[ivxlc]{1,7})\s*[-–—]?(?:\s*(?:of|/)\s*\d{1,4})?\z"
SENTENCE_END = r"[.!?][\"'”’)\]]?\z"


def page_number(block_type: Column, text: Column) -> Column:
    return F.coalesce((block_type == "paragraph") & text.rlike(PAGE_NUMBER), F.lit(False))


def run_on(first: Column, then: Column) -> Column:
    """Two parts of one text; a hyphen between a letter and a small letter goes."""
    broken = first.rlike(r"\p{L}-$") & then.rlike(r"^\p{Ll}")
    return F.trim(F.when(broken, F.concat(F.regexp_replace(first, "-$", ""), then)).otherwise(F.concat(first, F.lit(" "), then)))


def joined_paragraphs(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, block_no: order within the page, type, text) with paragraphs over a page break as one, on the page they begin on.

    The last block of a page and the first one of the next page, page numbers set aside, are one if both are paragraphs, the first
    does not end like a sentence and the second begins with a small letter. A block that went to the page before is not there any more to be
    run on, which matters for pages of one block: in a run of such pages every other break joins. So each page needs only to know its neighbour and
    its place in such a run; no page is read before another."""
    by_page = Window.partitionBy("doc_id", "page").orderBy("block_no")
    by_doc = Window.partitionBy("doc_id").orderBy("page")
    real = blocks.filter(~page_number(F.col("type"), F.col("text")))
    ends = real.groupBy("doc_id", "page").agg(F.min_by(F.struct("block_no", "type", "text"), "block_no").alias("head"), F.max_by(F.struct("block_no", "type", "text"), "block_no").alias("tail"), F.count("*").alias("n"))
    before = lambda c: F.when(F.lag("page").over(by_doc) == F.col("page") - 1, F.lag(c).over(by_doc))
    near = ends.withColumn("above", before("tail")).withColumn("lone", before(F.col("n") == 1))
    fits = (F.col("above.type") == "paragraph") & ~F.col("above.text").rlike(SENTENCE_END) & (F.col("head.type") == "paragraph") & F.col("head.text").rlike(r"^\p{Ll}")
    near = near.withColumn("fits", F.coalesce(fits, F.lit(False)))
    hangs = F.coalesce(F.col("fits") & F.col("lone") & before("fits"), F.lit(False))  # whether it joins depends on whether the page before did
    runs = near.withColumn("hangs", hangs).withColumn("run", F.sum((~F.col("hangs")).cast("int")).over(by_doc))
    odd = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("page")) % 2 == 1
    joins = runs.withColumn("joins", F.col("fits") & odd).filter("joins")
    gains = joins.select("doc_id", (F.col("page") - 1).alias("page"), F.col("above.block_no").alias("block_no"), F.col("head.text").alias("more"))
    gone = joins.select("doc_id", "page", F.col("head.block_no").alias("block_no"))
    left = blocks.join(gone, ["doc_id", "page", "block_no"], "left_anti").join(gains, ["doc_id", "page", "block_no"], "left")
    text = F.when(F.col("more").isNull(), F.col("text")).otherwise(run_on(F.col("text"), F.col("more")))
    return left.withColumn("text", text).withColumn("block_no", F.row_number().over(by_page) - 1).drop("more")


def running(blocks: DataFrame) -> DataFrame:
    """blocks with `is_running`: short paragraphs that are page numbers or, their digits set aside, stand on more than one page."""
    short = (F.col("type") == "paragraph") & (F.length("text") <= 80)
    key = F.when(short, F.lower(F.trim(F.regexp_replace("text", r"\d+", "#"))))
    keyed = blocks.withColumn("_key", key)
    often = keyed.filter("_key IS NOT NULL").groupBy("doc_id", "_key").agg(F.min("page").alias("_a"), F.max("page").alias("_b")).filter("_a <> _b").select("doc_id", "_key", F.lit(True).alias("_often"))
    marked = keyed.join(often, ["doc_id", "_key"], "left")
    return marked.withColumn("is_running", F.coalesce(short & (F.col("_often") | F.col("text").rlike(PAGE_NUMBER)), F.lit(False))).drop("_key", "_often")


def tables_over_pages(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, block_no: order within the document, type, text, rows) to the document's tables (doc_id, table_no, page, rows). A table goes on
    in one of the next page if nothing but running text lies between and both are as wide; a header that is repeated is dropped."""
    real = running(blocks).filter("NOT is_running")
    before = real.withColumn("prev_type", F.lag("type").over(Window.partitionBy("doc_id").orderBy("block_no")))
    return joined_tables(before.filter("type = 'table'").select("doc_id", "block_no", "prev_type", "page", "rows"))
