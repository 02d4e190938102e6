"""Sinks: chunk files as JSON, tables as CSV, documents as Markdown or text; one row or file for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import format_duration
from tessera.operators import documents


def chunk_files(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id and one JSON text {source, pageCount, chunkCount, chunks}, also of documents without chunks; pages is (doc_id, source, page_count)."""
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "path", "text", "page"))).alias("c"))
    listed = pages.join(listed, "doc_id", "left").withColumn("c", F.coalesce("c", F.array().cast(listed.schema["c"].dataType)))
    body = F.to_json(F.struct("source", F.col("page_count").alias("pageCount"), F.size("c").alias("chunkCount"), F.transform("c", lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"), x["page"].alias("page"))).alias("chunks")))
    return listed.select("doc_id", body.alias("json"))


def table_files(tables: DataFrame) -> DataFrame:
    return tables.select("doc_id", "table_no", documents.table_csv(F.col("rows")).alias("csv"))


def playlist_csv(entries: DataFrame) -> DataFrame:
    """Every field in quotes, a leading formula sign disarmed."""
    safe = lambda c: F.concat(F.lit('"'), F.replace(F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", safe((F.col("pos") + 1).cast("string")), safe(F.coalesce("title", F.lit(""))), safe(F.coalesce(format_duration(F.col("seconds")), F.lit(""))), safe(F.coalesce("url", F.lit(""))))
    lines = entries.select("list_id", F.struct("pos", line.alias("line")).alias("l"))
    return lines.groupBy("list_id").agg(F.concat(F.lit("﻿"), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda s: s["line"]), "\r\n"), F.lit("\r\n")).alias("csv"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
