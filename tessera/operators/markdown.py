"""Markdown as rows: its block tree, and text whose nesting is bounded. Lines are rows; what a line is by itself and what the next one is are columns, and
only what hangs on all lines before (open lists, tables, fences) is a fold over a document's lines in order, with a state of a few numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# List items, headings, the line under a table's head, quotes and fences; and how deep quotes and indents may go.
ITEM, HEADING = r"^(\s*)(?:([-*•])|(\d{1,9})[.)])\s+(.*)$", r"^#{1,6}\s+(.*)$"
DIVIDER = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
QUOTES, FENCE = r"^(?: {0,3}>)+", r"^[ \t]*(`{3,}|~{3,})"
MAX_QUOTES, MAX_INDENT = 20, 40

BLOCKS = "line_no long, type string, parent long, list_no long, ordered boolean, start long, text string, head array<string>, rows array<array<string>>"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0) and line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))


def _cells(line: str) -> list[str]:
    row = line.strip()
    row = row.removeprefix("|")
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


class _Tree:
    """Where a document's lines stand: the lists that are open (their number, indent, kind, last item and first number) and the table that is."""

    def __init__(self) -> None:
        self.lists: list[tuple[int, int, bool, int, int]] = []
        self.table: dict | None = None

    def closed(self) -> list[dict]:
        done, self.table = [self.table] if self.table else [], None
        return done

    def line(self, no: int, line: str, indent: int, bullet: bool, number: int | None, item: str, heads: bool) -> list[dict]:
        """The blocks that are whole with this line."""
        if self.table is not None:
            if no == self.table["line_no"] + 1:
                return []
            if line.strip() and "|" in line:
                width = len(self.table["head"])
                self.table["rows"].append((_cells(line) + [""] * width)[:width])
                return []
        done = self.closed()
        if not line.strip():
            return done
        if bullet or number is not None:
            return [*done, self._item(no, indent, number, item)]
        self._leave(lambda at: indent <= at)
        block = {"line_no": no, "parent": self.lists[-1][3] if self.lists else None}
        if heads:
            self.table = block | {"type": "table", "head": _cells(line), "rows": []}
            return done
        title = re.match(HEADING, line.strip())
        return [*done, block | ({"type": "heading", "text": title[1]} if title else {"type": "paragraph", "text": line.strip()})]

    def _leave(self, over) -> None:
        while self.lists and over(self.lists[-1][1]):
            self.lists.pop()

    def _item(self, no: int, indent: int, number: int | None, text: str) -> dict:
        self._leave(lambda at: indent < at)
        ordered, fresh = number is not None, (no, indent, number is not None, no, 1 if number is None else number)
        if not self.lists or indent >= self.lists[-1][1] + 2:
            self.lists.append(fresh)
        elif self.lists[-1][2] != ordered:
            self.lists[-1] = fresh
        else:
            self.lists[-1] = (*self.lists[-1][:3], no, self.lists[-1][4])
        inside = self.lists[-2][3] if len(self.lists) > 1 else None
        return {"line_no": no, "type": "item", "parent": inside, "list_no": self.lists[-1][0], "ordered": ordered, "start": self.lists[-1][4], "text": text}


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, and the columns of BLOCKS) for each heading, paragraph, list item and table, by the line that it begins on. parent is the line of the
    item that a block stands in, list_no the line that an item's list begins on. Blank lines end no list; an indented line belongs to the deepest item
    that it is indented under. Null text has no blocks; rows with equal ids are one document only if their lines are."""
    text = F.regexp_replace(F.replace(F.col("line"), F.lit("\t"), F.lit("    ")), r"\s+$", "")
    rows = lines_of(docs, id_col, text_col).withColumn("line", text)
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    heads = F.coalesce(F.col("line").contains("|") & after.contains("|") & after.rlike(DIVIDER), F.lit(False))
    part = lambda k: F.regexp_extract("line", ITEM, k)
    rows = rows.select("doc_id", "line_no", "line", (F.length("line") - F.length(F.ltrim("line"))).alias("indent"), (part(2) != "").alias("bullet"), part(3).try_cast("long").alias("number"), part(4).alias("item"), heads.alias("heads"))
    kind = dict(docs.dtypes)[id_col]
    schema = pa.schema([("line_no", pa.int64()), ("type", pa.string()), ("parent", pa.int64()), ("list_no", pa.int64()), ("ordered", pa.bool_()), ("start", pa.int64()), ("text", pa.string()), ("head", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, doc, kind_of = _Tree(), object(), None
        for b in batches:
            kind_of, ids, out = b.schema.field(0).type, [], []
            for doc_id, *line in zip(*(c.to_pylist() for c in b.columns)):
                if doc_id != doc:
                    ended = tree.closed()
                    out += ended
                    ids += [doc] * len(ended)
                    tree, doc = _Tree(), doc_id
                made = tree.line(*line)
                out += made
                ids += [doc_id] * len(made)
            yield _batch(ids, out, kind_of, schema)
        if kind_of is not None:
            last = tree.closed()
            yield _batch([doc] * len(last), last, kind_of, schema)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").mapInArrow(run, f"doc_id {kind}, {BLOCKS}")


def _batch(ids: list, blocks: list[dict], kind: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([x.get(f.name) for x in blocks], f.type) for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], ["doc_id", *schema.names])


def fenced(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, mark: what a line's fence would be, or "") with inside: whether the line is in fenced code or ends it. A fence ends with the
    next one of its sign that is at least as long. Only lines with marks are folded; the others lie between two of them."""
    kinds = dict(lines.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, fence = object(), ""
        for b in batches:
            step = []
            for doc_id, mark in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist()):
                doc, fence = doc_id, fence if doc_id == doc else ""
                if not fence:
                    fence = mark
                    step.append(1)
                elif mark[0] == fence[0] and len(mark) >= len(fence):
                    fence = ""
                    step.append(-1)
                else:
                    step.append(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("line_no"), pa.array(step, pa.int32())], ["doc_id", "line_no", "step"])

    marks = lines.filter("mark <> ''").select("doc_id", "line_no", "mark").repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
    steps = marks.mapInArrow(run, f"doc_id {kinds['doc_id']}, line_no {kinds['line_no']}, step int")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    both = lines.join(steps, ["doc_id", "line_no"], "left").withColumn("step", F.coalesce("step", F.lit(0)))
    return both.withColumn("inside", F.coalesce(F.sum("step").over(before), F.lit(0)) > 0).drop("step")


def limited_nesting(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, line: quotes and indents over their limits are cut to them, but in fenced code."""
    quotes = F.regexp_extract("line", QUOTES, 0)
    rows = lines_of(docs, id_col, text_col).withColumn("quotes", quotes).withColumn("rest", F.expr("substr(line, length(quotes) + 1)"))
    rows = fenced(rows.withColumn("mark", F.regexp_extract("rest", FENCE, 1)))
    kept = F.regexp_extract("quotes", rf"^(?:[^>]*>){{0,{MAX_QUOTES}}}", 0)
    indent = F.regexp_extract("rest", r"^[ \t]*", 0)
    wide = F.aggregate(F.split(indent, ""), F.lit(0), lambda n, c: F.when(c == "\t", n - n % 4 + 4).otherwise(n + F.length(c))) > MAX_INDENT
    short = F.when(wide, F.concat(F.lit(" " * MAX_INDENT), F.substring("rest", F.length(indent) + 1, F.length("rest")))).otherwise(F.col("rest"))
    return rows.select("doc_id", "line_no", F.when(F.col("inside"), F.col("line")).otherwise(F.concat(kept, short)).alias("line"))


def rejoined(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) as doc_id and text again."""
    listed: Column = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(listed.alias("all")).select("doc_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))
