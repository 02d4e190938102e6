"""Document structure: blocks, heading paths, chunks, and text in several forms."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_cell

BLOCK = "struct<type: string, level: int, text: string, ordered: boolean, items: array<string>, rows: array<array<string>>, page: int>"
CHUNK = "array<struct<path: string, text: string, page: int>>"


#: Where a text may be cut, best first, and the share of the room that a piece must fill for it.
_BLANK = re.compile(r"\s*")
CUTS = ((re.compile(r"\n"), 0.5), (re.compile(r"(?<=[.?!])(?= )"), 0.5), (re.compile(" "), 0.0))


def split_to_fit(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters (code points), each cut at the last place of the best kind that fills enough of it, else anywhere."""
    pieces, start = [], 0
    while len(text) - start > most:
        ends = (max((m.start() - start for m in kind.finditer(text, start, start + most + 1)), default=0) for kind, _ in CUTS)
        cut = next((n for n, (_, share) in zip(ends, CUTS) if n >= max(1, share * most)), max(1, most))
        pieces.append(text[start : start + cut].strip())
        start = _BLANK.match(text, start + cut).end()
    return [p for p in [*pieces, text[start:].strip()] if p]


def block_text(block: dict) -> str:
    if block["type"] == "list":
        return "\n".join(f"• {i}" for i in block["items"] or [])
    if block["type"] == "table":
        return "\n".join(" | ".join(r) for r in block["rows"] or [])
    return block["text"] or ""


def pack_chunks(blocks: list[dict], most: int) -> list[dict]:
    """Chunks of at most `most` characters under the path of the headings above them. A heading closes a chunk; a chunk is on
    the page of the piece that opened it, or of the heading before it."""
    out, path, held, page = [], {}, [], 1

    def close() -> None:
        if held:
            out.append({"path": " > ".join(path[k] for k in sorted(path) if path[k]), "text": "\n\n".join(held), "page": page})
            held.clear()

    for b in blocks:
        if b["type"] == "heading":
            close()
            path = {k: t for k, t in path.items() if k < b["level"]} | {b["level"]: b["text"]}
            page = b["page"]
            continue
        for piece in split_to_fit(block_text(b), most):
            if held and sum(map(len, held)) + 2 * len(held) + len(piece) > most:
                close()
                page = b["page"]
            held.append(piece)
    close()
    return out


def chunks(docs: DataFrame, most: int = 1200) -> DataFrame:
    """docs (doc_id, blocks) to one row for each chunk: doc_id, chunk_no, path, text, page. Long documents are one row, so
    they are cut in one task; nothing is shuffled."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, c) for k, blocks in enumerate(b.column(1).to_pylist()) for n, c in enumerate(pack_chunks(blocks or [], most))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[2][c] for r in rows], t) for c, t in (("path", pa.string()), ("text", pa.string()), ("page", pa.int32())))],
                ["doc_id", "chunk_no", "path", "text", "page"],
            )

    return docs.select("doc_id", "blocks").mapInArrow(run, f"doc_id {kind}, chunk_no long, path string, text string, page int")


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_PART = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>|<(?:ul|ol)\b[^>]*>(.*?)</(?:ul|ol)\s*>|<table\b[^>]*>(.*?)</table\s*>", re.S | re.I)


def _plain(markup: str) -> str:
    t = re.sub(r"(?i)<br\s*/?>|</?(p|div|h[1-6]|li|tr|blockquote|section|article|header|footer)\b[^>]*>", "\n", markup)
    t = re.sub(r"[ \t]+", " ", html.unescape(re.sub(r"<[^>]*>", "", t)))
    return re.sub(r" *\n+ *", "\n", t).strip()


def page_blocks(markup: str | None) -> list[dict]:
    """Headings, lists, tables and paragraphs of a page, in order."""
    none = {"level": None, "text": None, "ordered": None, "items": None, "rows": None, "page": 1}
    text, out, end = _HIDDEN.sub("", markup or ""), [], 0

    def paragraphs(part: str) -> None:
        out.extend(none | {"type": "paragraph", "text": line} for line in _plain(part).split("\n") if line)

    for m in _PART.finditer(text):
        paragraphs(text[end : m.start()])
        end = m.end()
        if m[1]:
            if title := _plain(m[2]).replace("\n", " "):
                out.append(none | {"type": "heading", "level": int(m[1]), "text": title})
        elif m[3] is not None:
            items = [x for x in (_plain(i).replace("\n", " ") for i in re.split(r"(?i)<li\b[^>]*>", m[3])) if x]
            if items:
                out.append(none | {"type": "list", "ordered": m[0][:3].lower() == "<ol", "items": items})
        else:
            rows = [[_plain(c).replace("\n", " ") for c in re.split(r"(?i)<t[dh]\b[^>]*>", r)[1:]] for r in re.split(r"(?i)<tr\b[^>]*>", m[4])[1:]]
            if rows := [r for r in rows if r]:
                out.append(none | {"type": "table", "rows": rows})
    paragraphs(text[end:])
    return out


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """doc_id and blocks."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("ordered", pa.bool_()), ("items", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("page", pa.int32())])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_blocks(x) for x in b.column(1).to_pylist()], pa.list_(item))], ["doc_id", "blocks"])

    return pages.select(id_col, html_col).mapInArrow(run, f"doc_id {kind}, blocks array<{BLOCK}>")


def _rendered(block: Column, form: str) -> Column:
    """One block as Markdown, plain text or page text."""
    bar = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    heading = block["text"] if form == "plain" else F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), block["level"])), F.lit(" "), block["text"])
    mark = {"plain": lambda x, i: F.concat(F.lit("• "), x), "pages": lambda x, i: F.concat(F.lit("- "), x)}.get(form, lambda x, i: F.concat(F.when(block["ordered"], F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x))
    items = F.array_join(F.transform(block["items"], mark), "\n")
    if form == "markdown":
        rule = F.concat(F.lit("| "), F.array_join(F.transform(block["rows"][0], lambda c: F.lit("---")), " | "), F.lit(" |"))
        rows = F.transform(block["rows"], lambda r, i: F.when(i == 0, F.concat(bar(r), F.lit("\n"), rule)).otherwise(bar(r)))
    else:
        rows = F.transform(block["rows"], lambda r: F.array_join(r, "\t" if form == "plain" else " | "))
    return F.when(block["type"] == "heading", heading).when(block["type"] == "paragraph", block["text"]).when(block["type"] == "list", items).otherwise(F.array_join(rows, "\n"))


def to_markdown(blocks: Column) -> Column:
    return F.concat(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] != "table") | (F.size(b["rows"]) > 0)), lambda b: _rendered(b, "markdown")), "\n\n"), F.lit("\n"))


def to_plain_text(blocks: Column) -> Column:
    return F.concat(F.array_join(F.transform(blocks, lambda b: _rendered(b, "plain")), "\n\n"), F.lit("\n"))


def to_paged_text(blocks: Column) -> Column:
    """Blocks by page under [Page N] marks."""
    numbers = F.array_sort(F.array_distinct(F.transform(blocks, lambda b: b["page"])))
    one = lambda n: F.concat(F.lit("[Page "), n.cast("string"), F.lit("]\n"), F.array_join(F.transform(F.filter(blocks, lambda b: b["page"] == n), lambda b: _rendered(b, "pages")), "\n\n"))
    return F.array_join(F.transform(numbers, one), "\n\n")


def table_csv(rows: Column) -> Column:
    """A table as CSV with a byte-order mark and CRLF."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, csv_cell), ","))
    return F.concat(F.lit("﻿"), F.array_join(lines, "\r\n"), F.lit("\r\n"))


def running_text(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_no, type, text, page) that repeat on several pages once their digits are set aside."""
    short = blocks.filter((F.col("type") == "paragraph") & (F.length("text") <= 80))
    key = F.lower(F.trim(F.regexp_replace("text", r"\d+", "#")))
    keyed = short.withColumn("key", key)
    many = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages")).filter("pages > 1").select("doc_id", "key")
    return keyed.join(many, ["doc_id", "key"], "left_semi").drop("key")


def joined_tables(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, block_no, prev_type, page, rows) that run on over a page break as one: the block before is a table,
    the page is the next, the width is the same; a header that is repeated is dropped. The fold keeps one state a document."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    width = F.size(F.col("rows")[0])
    fresh = ~((F.col("prev_type") == "table") & (F.col("page") == F.lag("page").over(w) + 1) & (width == F.lag(width).over(w)))
    run = tables.withColumn("table_no", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(w))
    head = F.first(F.array_join(F.col("rows")[0], "\0")).over(Window.partitionBy("doc_id", "table_no").orderBy("block_no"))
    first = F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("block_no")) == 1
    part = F.when(~first & (F.array_join(F.col("rows")[0], "\0") == head), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    parts = run.select("doc_id", "table_no", "block_no", "page", part.alias("part"))
    return parts.groupBy("doc_id", "table_no").agg(F.min("page").alias("page"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "part"))), lambda s: s["part"])).alias("rows"))
