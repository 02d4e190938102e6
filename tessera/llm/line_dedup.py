"""Line dedup by winnowing over line hashes.

The non-blank lines of a document are a sequence. In each window of `window` neighbouring lines the smallest line hash
(the rightmost on ties) is selected as a fingerprint, so two documents that share a run of at least `window` lines select a
common one at the same place of it. Only selected positions leave the documents, each with the hashes of the lines around
it; those whose hash occurs once have no match. The others are joined by position: an occurrence meets the first one (in order of id and
position, found by partial sums) that has the same selected hash in the same window, so that hot lines never meet in pairs. From there
the match is extended both ways, line by line, through the hashes that both carry; whatever a run holds beyond them belongs
to the next fingerprint, which lies in the same run. The lines of the later run go. Where a run overlaps its own
first occurrence in one document, the lines of the first occurrence stay: of `a a a a` with windows of two, `a a` is left.
So of each distinct line the first occurrence always stays. With `alone`, a line of at least so many words (parts
between spaces) is a run by itself, whatever `window` is.

Cases: null text counts as empty and stays null; blank lines (only spaces) are neither compared nor deleted; lines compare
by all their characters, and a window by 64 bits a line and no less than 128; a null id sorts after all others; ids are BIGINT or cast to it; rows
with equal id and text are one document and share its decision; rows with equal id and different texts sort by a hash of
the text; a document may become empty; extra columns pass through, whatever their names, but for input columns named like a
result column, which it replaces; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash, bounded, read_table, spare


def fingerprints_of(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the line hashes of texts (row: the text of each) the selected positions, for each of them how many lines before it the windows
    that selected it begin (a bit for each number), and the hashes around it; -1 positions and the like are cut by `row`."""
    n = max(len(h) - window + 1, 0)
    start = np.arange(n)[row[:n] == row[window - 1 : window - 1 + n]] if n else np.zeros(0, np.int64)
    at = start.copy()
    for k in range(1, window):
        at = np.where(h[start + k] <= h[at], start + k, at)
    sides = np.zeros(len(h), np.int64)
    np.bitwise_or.at(sides, at, 1 << (at - start))
    picked = np.flatnonzero(sides)
    return picked, sides[picked], picked[:, None] + np.arange(1 - window, window)


def _fingerprints(docs: DataFrame, window: int, alone: int | None) -> DataFrame:
    """docs (doc_id, tag, text) to (doc_id, tag, pick, at: number among the non-blank lines, sides: offsets of the windows that selected
    it, around: hashes of the lines from at - window + 1 to at + window - 1, null beyond the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, hashes, long = [], [], []
            for k, t in enumerate(b.column(2)):
                lines = [x for x in (t.as_py() or "").split("\n") if x.strip(" ")]
                if alone is not None and window > 1:
                    long += [(k, i, *np.frombuffer(xxhash.xxh3_128_digest(x), np.int64)) for i, x in enumerate(lines) if len(x) >= 2 * alone - 1 and sum(map(bool, x.split(" "))) >= alone]
                row += [k] * len(lines)
                hashes += map(xxhash.xxh3_64_intdigest, lines)
            h, row = np.array(hashes, np.uint64), np.array(row, np.int64)
            at, sides, around = fingerprints_of(h, row, window)
            inside = (around >= 0) & (around < len(h))
            around = np.clip(around, 0, max(len(h) - 1, 0))
            inside &= row[around] == row[at][:, None] if len(h) else inside
            values = [pa.array(h.view(np.int64)[around].ravel() if len(h) else np.zeros(0, np.int64), mask=~inside.ravel()), pa.array([x[3] for x in long], pa.int64())]
            size = np.concatenate((np.full(len(at), 2 * window - 1), np.ones(len(long), np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.concat_arrays(values))
            owner = pa.array(np.concatenate((row[at], np.array([x[0] for x in long], np.int64))))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            number = np.concatenate((place[at], np.array([x[1] for x in long], np.int64)))
            pick = np.concatenate((h.view(np.int64)[at], np.array([x[2] for x in long], np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(owner) for k in (0, 1)), pa.array(pick), pa.array(number), pa.array(np.concatenate((sides, np.zeros(len(long), np.int64)))), lists], ["doc_id", "tag", "pick", "at", "sides", "around"])

    return docs.mapInArrow(run, "doc_id long, tag long, pick long, at long, sides long, around array<long>")


def _same(mine: F.Column, other: F.Column) -> F.Column:
    """How many elements from the first on are equal and not null."""
    differs = F.array_position(F.zip_with(mine, other, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(mine)).otherwise(differs - 1).cast("long")


def repeated_runs(docs: DataFrame, window: int, alone: int | None, stash: Stash) -> DataFrame:
    """docs (doc_id, tag, text) to (doc_id, tag, low, high): later runs, as numbers among the non-blank lines."""
    found = stash.put(_fingerprints(docs, window, alone), "fingerprints")
    repeated = found.groupBy("pick").count().filter("count > 1").select("pick")
    near = stash.put(found.join(repeated, "pick", "left_semi"), "near")
    begin = F.when(F.col("sides") == 0, F.array(F.lit(-1))).otherwise(F.filter(F.array(*(F.lit(k) for k in range(window))), lambda k: F.expr("sides").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0))
    seen = near.select("*", F.explode(begin).alias("begin"))
    lines = F.when(F.col("begin") < 0, F.col("around")).otherwise(F.slice("around", F.lit(window) - F.col("begin"), F.lit(window)))
    seen = seen.select("*", lines.alias("lines"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "at")
    first = seen.groupBy("pick", "begin", "lines").agg(F.min_by(F.struct(order.alias("order"), "around"), order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stash.put(first, "first")
    met = seen.join(first, ["pick", "begin", "lines"]).filter(order > F.col("first.order"))
    mine, other = F.col("around"), F.col("first.around")
    back, on = (lambda x: F.reverse(F.slice(x, 1, window - 1))), (lambda x: F.slice(x, window + 1, window - 1))
    before = F.when(F.col("begin") < 0, F.lit(0)).otherwise(_same(back(mine), back(other)))
    after = F.when(F.col("begin") < 0, F.lit(0)).otherwise(_same(on(mine), on(other)))
    one = F.col("doc_id").eqNullSafe(F.col("first.order.doc_id")) & (F.col("tag") == F.col("first.order.tag")) & (F.col("begin") >= 0)
    kept = F.when(one, F.greatest(F.lit(0), window - (F.col("at") - F.col("first.order.at")))).otherwise(F.lit(0))  # lines of the first occurrence
    return met.select("doc_id", "tag", (F.col("at") - before + kept).alias("low"), (F.col("at") + after).alias("high")).filter("low <= high")


def line_dedup(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """docs with the text that is left, and the columns _n_lines and _n_removed. Without `alone` repeated single lines stay."""
    stash = Stash(docs.sparkSession)
    docs = docs.drop("_n_lines", "_n_removed")
    tag = F.xxhash64(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    runs = repeated_runs(docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text_col).alias("text")), window, alone, stash)
    of, name, gone = (spare(docs, x) for x in ("of", "name", "gone"))
    each = stash.put(runs.groupBy(F.col("doc_id").alias(of), F.col("tag").alias(name)).agg(F.collect_set(F.struct("low", "high")).alias(gone)), "gone")
    each = bounded(each) if (each.agg(F.sum(F.size(gone))).first()[0] or 0) <= 1_000_000 else each
    joined = docs.join(each, F.col(id_col).cast("long").eqNullSafe(F.col(of)) & (tag == F.col(name)), "left").select(*(docs[c] for c in docs.columns), gone)
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _n_lines long, _n_removed long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, removed = [], [], []
            for t, spans in zip(b.column(at), b.column(b.num_columns - 1)):
                t, own, g = t.as_py(), [], set()
                for s in spans.as_py() or ():
                    g.update(range(s["low"], s["high"] + 1))
                own = t.split("\n") if t is not None else []
                if g:
                    solid = (i for i, x in enumerate(own) if x.strip(" "))
                    out = {i for k, i in enumerate(solid) if k in g}
                    t = "\n".join(x for i, x in enumerate(own) if i not in out)
                lines.append(len(own))
                removed.append(len(g))
                texts.append(t)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*b.schema.names[:-1], "_n_lines", "_n_removed"])

    return joined.mapInArrow(run, fields)


QUERY = "op1_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, alone=50).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text IS NULL AS none FROM documents),
lines AS (SELECT doc_id, u.i AS line, ls[u.i] AS body FROM raw, unnest(range(1, len(ls) + 1)) AS u(i)),
solid AS (SELECT doc_id, line, body, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM lines WHERE trim(body, ' ') <> ''),
pairs AS (SELECT a.doc_id, a.line AS l1, b.line AS l2, a.body || chr(10) || b.body AS body FROM solid a JOIN solid b ON b.doc_id = a.doc_id AND b.k = a.k + 1),
ranked AS (SELECT doc_id, l1, l2, row_number() OVER w AS n, first_value(doc_id) OVER w AS first_doc, first_value(l2) OVER w AS first_l2 FROM pairs WINDOW w AS (PARTITION BY body ORDER BY doc_id, l1)),
alone AS (SELECT doc_id, line, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS n FROM solid WHERE len(list_filter(string_split(body, ' '), lambda x: x <> '')) >= 50),
gone AS (SELECT doc_id, l1 AS line FROM ranked WHERE n > 1 AND NOT (doc_id = first_doc AND l1 = first_l2) UNION SELECT doc_id, l2 FROM ranked WHERE n > 1 UNION SELECT doc_id, line FROM alone WHERE n > 1),
left_over AS (SELECT l.doc_id, string_agg(l.body, chr(10) ORDER BY l.line) AS body FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT r.doc_id, CASE WHEN r.none THEN 0 ELSE len(r.ls) END AS n_lines, coalesce(c.n, 0) AS n_removed, sha256(coalesce(o.body, '')) AS kept_sha256
FROM raw r LEFT JOIN counts c ON c.doc_id = r.doc_id LEFT JOIN left_over o ON o.doc_id = r.doc_id
"""
