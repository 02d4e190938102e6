"""Benchmark decontamination by the q-gram lemma.

Texts and passages are lower-cased by one function, everything but letters and digits becomes one space, and the UTF-8 of that is compared. A passage of
m bytes that occurs with at most k = rate * m edits shares at least m - q + 1 - k * q of its q-grams with the text, and all
of them lie on at most k + 1 neighbouring diagonals (position in the text less position in the passage). Shared q-grams are
therefore counted in bands of k + 1 diagonals; two neighbouring bands together cover any such occurrence, so regions whose
sum stays under the bound are discarded without loss. Each region that is left is verified by banded alignment.

The benchmark is read in blocks of about `block_bytes` (or one item), one of which is broadcast at a time: each block is a pass
over the texts whose hits are written before the next block is built.

Cases: null text counts as empty; a passage with fewer than q bytes after normalising can't be told from chance and never
matches; for passages too short for k edits the budget is the largest at which the bound is still at least 1; rows with
equal ids are judged each for itself; null item texts never match; an empty benchmark or table leaves nothing contaminated;
q-grams that are very frequent in text and passages are counted in parts; very long texts are read whole; extra columns pass through,
whatever their names, but for an input column `_hits`, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash, bounded, read_table, slices, spare

_KEEP = np.zeros(256, bool)
_KEEP[128:] = _KEEP[48:58] = _KEEP[97:123] = True
_SPREAD, _TABLE_BITS, _POSTINGS = np.uint64(0x9E3779B97F4A7C15), 22, 1 << 20


def normalised(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts with runs of other bytes as one space after a word; offsets."""
    solid = _KEEP[raw]
    before = np.concatenate(([False], solid[:-1])) if len(raw) else solid
    before[at[:-1][at[:-1] < len(raw)]] = False
    keep = solid | before
    count = np.concatenate(([0], np.cumsum(keep)))
    return np.where(solid, raw, np.uint8(32))[keep], count[at]


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position, as one number; the last q - 1 also hold zeros."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray((len(text),), "<u8", padded.tobytes(), strides=(1,)) & np.uint64((1 << 8 * q) - 1)


class Index:
    """The q-grams of a block of passages, with where they occur."""

    def __init__(self, items: list[tuple[int, str | None]], q: int, rate: float):
        self.q, self.texts, self.ids, found = q, [], [], []
        folded = pc.utf8_lower(pa.array([text or "" for _, text in items], pa.large_string())).to_pylist()
        for (item, _), text in zip(items, folded):
            raw = np.frombuffer(text.encode(), np.uint8)
            own, _ = normalised(raw, np.array([0, len(raw)]))
            own = own[:-1] if len(own) and own[-1] == 32 else own
            if len(own) >= q:
                self.texts.append(own)
                self.ids.append(item)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((rate * self.size).astype(np.int64), np.maximum(0, (self.size - q) // q))
        self.least = self.size - q + 1 - self.edits * q
        for k, t in enumerate(self.texts):
            own = grams(t, q)[: len(t) - q + 1]
            found.append((own, np.full(len(own), k), np.arange(len(own))))
        code, item, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(code, kind="stable")
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.item, self.place = item[order], place[order]
        self.first = np.concatenate((self.first, [len(order)]))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        with np.errstate(over="ignore"):
            self.seen[(self.codes * _SPREAD) >> np.uint64(64 - _TABLE_BITS)] = True

    def regions(self, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first diagonal, end diagonal) of the regions that meet the bound."""
        if not len(text) or not len(self.codes):
            return
        code = grams(text, self.q)
        with np.errstate(over="ignore"):
            pos = np.flatnonzero(self.seen[(code * _SPREAD) >> np.uint64(64 - _TABLE_BITS)])
        k = np.minimum(np.searchsorted(self.codes, code[pos]), len(self.codes) - 1)
        pos, k = pos[ok := self.codes[k] == code[pos]], k[ok]
        row = np.searchsorted(at, pos, "right") - 1
        ok = pos + self.q <= at[row + 1]
        pos, k, row = pos[ok], k[ok], row[ok]
        n = self.first[k + 1] - self.first[k]
        if not len(n):
            return
        longest = int(self.size.max()) + 1
        span = len(text) + longest + 3
        keys, counts = [], []
        part = np.cumsum(n) // _POSTINGS  # very frequent q-grams are counted in parts
        for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            m = n[own]
            post = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[k[own]], m)
            item = self.item[post]
            band = (np.repeat(pos[own] - at[row[own]], m) - self.place[post] + longest) // (self.edits[item] + 1)
            key, count = np.unique((np.repeat(row[own], m) * len(self.ids) + item) * span + band, return_counts=True)
            keys.append(key)
            counts.append(count)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        after = np.zeros(len(count), np.int64)
        after[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        owner, band = key // span, key % span
        row, item = owner // len(self.ids), owner % len(self.ids)
        for r, i, b in zip(*(x[count + after >= self.least[item]].tolist() for x in (row, item, band))):
            step = int(self.edits[i]) + 1
            yield r, i, b * step - longest, (b + 2) * step - longest

    def aligned(self, text: np.ndarray, item: int, low: int, high: int) -> int | None:
        """Least edits between the passage and any part of text with diagonals around [low, high); None over budget."""
        most, own = int(self.edits[item]), self.texts[item]
        low, high = low - most, high + most
        lane = np.arange(high - low)
        padded = np.full(len(own) + high - low, 256, np.int16)  # 256: outside of the text
        a, b = max(low, 0), min(low + len(padded), len(text))
        if b > a:
            padded[a - low : b - low] = text[a:b]
        cost = np.zeros(high - low, np.int32)
        for i in range(len(own)):
            step = cost + (padded[i : i + high - low] != own[i])
            step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
            cost = np.minimum.accumulate(step - lane) + lane
            if cost.min() > most:
                return None
        return int(cost.min())

    def hits(self, column: pa.Array) -> list[list[dict]]:
        """For each text the passages that it holds, with the edits of the best occurrence."""
        out: list[list[dict]] = []
        parts = (pc.utf8_lower(column.slice(k, 512).cast(pa.large_string())) for k in range(0, len(column), 512))
        for _, _, raw, at in (s for part in parts for s in slices(part)):
            text, at = normalised(raw, at)
            best: dict[tuple[int, int], int] = {}
            for r, i, low, high in self.regions(text, at):
                edits = self.aligned(text[at[r] : at[r + 1]], i, low, high)
                if edits is not None:
                    best[r, i] = min(edits, best.get((r, i), edits))
            rows: list[list[dict]] = [[] for _ in range(len(at) - 1)]
            for (r, i), edits in sorted(best.items()):
                rows[r].append({"item_id": self.ids[i], "edits": edits})
            out += rows
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, q: int = 8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """docs and _hits, an array of (item_id, edits): the benchmark items that occur in the text, with their edits."""
    spark, docs = docs.sparkSession, docs.drop("_hits")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    kind, named = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())])), "array<struct<item_id: bigint, edits: int>>"

    def index_of(block: int):
        return spark.sparkContext.broadcast(Index([(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == block).orderBy("i", "t").collect()], q, rate))

    if blocks == 1:
        index, at = index_of(0), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.value.hits(b.column(at)), kind)], [*b.schema.names, "_hits"])

        return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", _hits {named}")

    stash = Stash(spark)
    name = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts, found = docs.select(name.alias("name"), F.col(text_col).alias("text")), None
    for block in range(blocks):
        index = index_of(block)

        def each(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = index.value.hits(b.column(1))
                some = [k for k, h in enumerate(hits) if h]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([hits[k] for k in some], kind)], ["name", "hits"])

        own = stash.put(texts.mapInArrow(each, f"name string, hits {named}").distinct(), "hits")
        index.destroy()
        found = own if found is None else found.union(own)
    of, hits = spare(docs, "name"), spare(docs, "hits")
    found = stash.put(found.groupBy(F.col("name").alias(of)).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias(hits)), "all-hits")
    joined = docs.join(bounded(found), name == F.col(of), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce(F.col(hits), F.expr(f"CAST(array() AS {named})")).alias("_hits"))


QUERY = "op8_decontaminate"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").cast("long").alias("n_items"), F.col("_hits.item_id").alias("item_ids"), F.col("_hits.edits").alias("edits"), (F.size("_hits") == 0).alias("kept"))


ORACLE_SQL = None
