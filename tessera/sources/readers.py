"""Sources: bytes to text, line-delimited JSON, search results, embedded JSON, PDF text streams, tables with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.StringType()), ("page", T.IntegerType()), ("page_width", T.DoubleType()), ("pos", T.LongType()), ("text", T.StringType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("width", T.DoubleType()), ("height", T.DoubleType()), ("font_size", T.DoubleType()), ("font_name", T.StringType()), ("bold", T.BooleanType()), ("field", T.BooleanType()))])
SEARCH = "recordings array<struct<id: string, score: int, title: string, length: int, `first-release-date`: string, disambiguation: string, `artist-credit`: array<struct<name: string, joinphrase: string>>, releases: array<struct<id: string, title: string, date: string>>>>"


def text_of(data: bytes | None) -> str | None:
    """UTF-16 by its mark, else UTF-8, else Windows-1252; null for bytes with a zero in a single-byte text."""
    if data is None:
        return None
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
    if b"\0" in data:
        return None
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text for their bytes."""
    at = files.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_of(x) for x in b.column(at).to_pylist()], pa.string())], [*b.schema.names, "text"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", text string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content")).select("path", "text")


def ndjson(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON value a line; a bad line fails the read, or is set aside in _corrupt_record."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def search_hits(raw: DataFrame, column: str = "raw_json") -> DataFrame:
    """Search answers to one row for each valid recording: titles cut to 300 characters, credit joined, best release first."""
    parsed = raw.select("query", F.posexplode(F.from_json(column, SEARCH)["recordings"]).alias("pos", "r")).filter(F.col("r.id").rlike("^[0-9a-f-]{36}$") & (F.length("r.title") > 0))
    credit = F.array_join(F.transform("r.artist-credit", lambda c: F.concat(c["name"], F.coalesce(c["joinphrase"], F.lit("")))), "")
    dated = F.array_sort(F.transform("r.releases", lambda x: F.coalesce(x["date"], F.lit("9999"))))
    return parsed.select("query", "pos", F.col("r.id").alias("id"), F.substring("r.title", 1, 300).alias("title"), F.substring(credit, 1, 300).alias("artist"), F.coalesce("r.score", F.lit(0)).alias("score"), F.coalesce("r.first-release-date", F.try_element_at(dated, F.lit(1))).alias("date"), F.coalesce(F.size("r.releases"), F.lit(0)).alias("releases"))


def embedded_json(html: Column, element_id: str) -> Column:
    """The JSON text of a script element."""
    return F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{element_id}"[^>]*>(.*?)</script>', 1)


def first_known(*answers: Column) -> Column:
    """The first source that gave an answer."""
    return F.coalesce(*(F.nullif(a, F.lit("")) for a in answers))


def playlist(entries: DataFrame, most: int) -> DataFrame:
    """The first `most` entries (list_id, pos, title, ...), then without removed or private ones; truncated says whether there
    were more. The cut comes first."""
    shown = entries.withColumn("truncated", F.max("pos").over(Window.partitionBy("list_id")) >= most).filter(F.col("pos") < most)
    return shown.filter(~F.coalesce(F.col("title").isin("[Deleted video]", "[Private video]"), F.lit(False)))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def upserted(cache: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The next snapshot of a keyed table: new rows replace old ones."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def overlaid(fallback: Column, live: Column) -> Column:
    """Live rates over fallback ones where they are positive numbers."""
    good = F.map_filter(live, lambda k, v: v.isNotNull() & (v > 0))
    return F.map_concat(F.map_filter(fallback, lambda k, v: ~F.map_contains_key(good, k)), good)
