"""Ranked lexical search over impact-ordered postings, score at a time.

Scores are sums of integer impacts, one for each term of the query and each document that holds it; impacts depend on
statistics of the whole table (documents, terms, documents of a term), which are gathered first. Documents are then dealt to
tasks, and each task orders the postings of its documents by term and exact impact. A query reads them in descending impact over all its
terms, equal impacts together, and adds them up for each document. It stops only when the impacts that are still to come could not
lift a document that lies under the k-th best sum so far (or under the k-th best of documents seen before) to it, those never seen included; the documents
that this does not rule out get their whole score from their own terms. What tasks return, at most k documents
for each query, is ranked together.

Queries are read in blocks of about `block_bytes` of text, of which one is broadcast at a time; terms of documents that no query of the
block holds leave as they are counted. Nothing but bounded results of tasks is shuffled: no posting leaves its task.

Cases: null or blank text has no terms, of documents (which then count nowhere) and of queries (which then give no rows); a term in all
documents may weigh nothing; equal scores go by ascending id, null ids first; rows with equal ids are documents each for itself, and so
are repeated queries; very long texts are read whole; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Stash, read_table

_TERM_BYTES = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _TERM_BYTES else 32 for b in range(256))
_FIRST = 512  # postings of the strongest term read in the first step; each step reads twice as many
_NO_ID = np.iinfo(np.int64).min


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: letters, digits and anything beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) to doc_id, n (all its terms), terms and tfs (of the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n, size, term, tf = [], [0], [], []
            for text in b.column(1):
                found = terms(text.as_py())
                count = Counter(found)
                mine = count.keys() & known.keys()
                n.append(len(found))
                size.append(len(mine))
                term += map(known.__getitem__, mine)
                tf += map(count.__getitem__, mine)
            offsets = pa.array(np.cumsum(size), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Impact-ordered postings of some documents. weight: of each term; documents and total: of the whole table."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, total: int):
        m = 50 + (50 * n * documents) // total
        self.ids, doc = ids, np.repeat(np.arange(len(ids)), size)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        self.first, self.own = np.concatenate(([0], np.cumsum(size))), (term, impact)  # by document
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def whole_scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The scores of docs for the terms that `wanted` marks."""
        size = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        total = np.concatenate(([0], np.cumsum(np.where(wanted[self.own[0][at]], self.own[1][at], 0))))
        end = np.cumsum(size)
        return total[end] - total[end - size]

    def best(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents for the query's terms, of those with a score of at least floor, 1 or more."""
        now, end = self.starts[query], self.starts[query + 1]
        now, end = now[now < end], end[now < end]
        score, step, floor = np.zeros(len(self.ids), np.int64), _FIRST, max(floor, 1)
        while True:
            left = np.where(now < end, self.impact[np.minimum(now, len(self.impact) - 1)], 0) if len(now) else now
            rest = int(left.sum())  # no document can gain more
            bar = max(floor, int(np.partition(score, -k)[-k]) if len(score) >= k else 0)
            if rest < bar:
                break
            strongest = int(left.argmax())
            least = self.impact[min(now[strongest] + step, end[strongest]) - 1]
            for t in range(len(now)):
                stop = now[t] + int(np.searchsorted(-self.impact[now[t] : end[t]], -least, "right"))
                score[self.doc[now[t] : stop]] += self.impact[now[t] : stop]
                now[t] = stop
            step *= 2
        found = np.flatnonzero(score + rest >= bar)
        if rest:
            wanted = np.zeros(len(self.starts) - 1, bool)
            wanted[query] = True
            whole = self.whole_scores(found, wanted)
        else:
            whole = score[found]
        found, whole = found[whole >= bar], whole[whole >= bar]
        order = np.lexsort((self.ids[found], -whole))[:k]
        return self.ids[found[order]], whole[order]


def _searched(found: DataFrame, queries: list[np.ndarray], weight: np.ndarray, documents: int, total: int, k: int, shard_rows: int) -> DataFrame:
    """The k best documents of each task for each query: query (its number), doc_id, score."""
    shared = found.sparkSession.sparkContext.broadcast((queries, weight))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= shard_rows:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(asked)
        for part in shards(batches):
            t, f = (part.column(c).combine_chunks() for c in ("terms", "tfs"))
            ids = part.column("doc_id").fill_null(_NO_ID).to_numpy()
            shard = Shard(ids, part.column("n").to_numpy(), t.value_lengths().to_numpy().astype(np.int64), t.flatten().to_numpy().astype(np.int64), f.flatten().to_numpy().astype(np.int64), weights, documents, total)
            for q, query in enumerate(asked):
                seen, scores = best[q]
                new, more = shard.best(query, k, int(scores[-1]) if len(scores) == k else 1)
                both, all_scores = np.concatenate((seen, new)), np.concatenate((scores, more))
                order = np.lexsort((both, -all_scores))[:k]
                best[q] = both[order], all_scores[order]
        number = np.repeat(np.arange(len(best)), [len(x[0]) for x in best])
        ids, scores = (np.concatenate([none, *(x[c] for x in best)]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["query", "doc_id", "score"])

    return found.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, size = [], 0
    for item, text in queries.toLocalIterator():
        held.append((item, sorted(set(terms(text)))))
        size += len(text or "") + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_rows: int = 1 << 16, block_bytes: int = 1 << 22) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each row of queries, of those with a score above 0."""
    spark, out = docs.sparkSession, None
    stash = Stash(spark, batch_rows=2000)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block in _blocks(queries.select(F.col(item_col).cast("long"), F.col(item_text_col)), block_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        found = stash.put(vectors(base, vocabulary), "vectors")
        rows, documents, total = found.agg(F.count("*"), F.count_if(F.col("n") > 0), F.sum("n")).first()
        if documents:
            counted = found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row for each term of the block
            holding = np.zeros(len(vocabulary), np.int64)
            holding[[r[0] for r in counted]] = [r[1] for r in counted]
            weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) if h else 0 for h in holding.tolist()], np.int64)
            asked = [np.array([vocabulary[t] for t in own], np.int64) for _, own in block]
            tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows / shard_rows))
            each = _searched(found.filter(F.size("terms") > 0).coalesce(tasks), asked, weight, documents, total, k, shard_rows)
            place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
            items = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query int, item_id long")
            best = each.withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")
            best = stash.put(best, "best")
            out = best if out is None else out.union(best)
        stash.drop(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


QUERY = "op11_lexical_search"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
stats AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM words),
held AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM words) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, stats GROUP BY t),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t), stats GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
