"""SimHash near-dedup with pivot distance tables.

A fingerprint of w 64-bit words has bit j set if over half of the text's shingle hashes have it set. Pairs are sought in
buckets of rows with an equal key:
- at small distances (`exact_keys`) the bits are cut into d + 3 blocks and each choice of three blocks is a table; two
  fingerprints that differ in at most d bits leave at least three blocks untouched, so no link is lost;
- near copies (`near_duplicates`) may differ in a third of their bits, which no table of bits reaches at a bounded cost; their
  keys are pairs of min-wise shingles, a fixed number for each text, so that the recall does not depend on the number of rows.
In a bucket each member has a row of the pivot table: its Hamming distances to many reference fingerprints. A pair whose
coordinates differ by more than d anywhere can't be within d bits (triangle inequality) and is discarded; rows are sorted by
the first coordinate, so that most pairs are never formed. Survivors are verified by XOR. A bucket of more than 16 rows gives
the edges of a spanning forest only, never all its pairs. Buckets over `most` members are split: at small distances by further
masks (with d = 3 that leaves 16 free bits, so no bucket exceeds 65,536 members however hot it is), for near copies by a hash of the row,
each part being tied to one member of the whole bucket, which is found by partial sums; at last parts meet two by two.

Cases: null text counts as empty; a text with no word has fingerprint zero; one with fewer words than a shingle is one
shingle; rows with equal id and text are one node; a null id never names a component unless all its ids are null; ids are BIGINT or cast to it;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Stash, bounded, components, mixed, read_table

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WEIGHT_ROWS = 1 << 14


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, repeats included, as unsigned 64-bit values."""
    found = (text or "").encode().translate(_FOLD).split()  # bytes split at 0x20 and 0x09-0x0D
    if len(found) > n:
        digests = map(xxhash.xxh64_digest, map(b" ".join, zip(*(found[i:] for i in range(n)))), itertools.repeat(42))
    else:
        digests = [xxhash.xxh64_digest(b" ".join(found), 42)] if found else []
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """Majority bits; words after the first come from mixes of the same hashes."""
    out = np.zeros(width, np.uint64)
    for k in range(width if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), _WEIGHT_ROWS):
            h = hashes[i : i + _WEIGHT_ROWS]
            h = mixed(h + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) if k else h
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and node, the fingerprint of 64 bits as a BIGINT; repeated shingles count each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(shingle_hashes(t.as_py(), n)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *prints]).view(np.int64))], ["doc_id", "node"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, node long")


def _bits(width: int, chosen: list[int]) -> list[int]:
    """The mask of the chosen bits, as signed 64-bit words."""
    out = [0] * width
    for b in chosen:
        out[b // 64] |= 1 << (b % 64)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def exact_masks(distance: int, free: list[int] | None = None) -> list[list[int]]:
    """Masks of which at least one leaves out every bit in which two 64-bit fingerprints within `distance` differ."""
    free = list(range(64)) if free is None else free
    blocks = np.array_split(np.array(free), distance + 3)
    return [[int(b) for k in pick for b in blocks[k]] for pick in itertools.combinations(range(distance + 3), 3)]


def distances(bits: int, flip: float) -> np.ndarray:
    """The chance of each distance 0 to `bits` if each bit differs with probability `flip`."""
    ways = [math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) for d in range(bits + 1)]
    return np.exp([w + d * math.log(flip) + (bits - d) * math.log(1 - flip) if 0 < flip < 1 else (0.0 if d == bits * flip else -math.inf) for d, w in enumerate(ways)])


def linked(words: np.ndarray, label: np.ndarray, distance: int, tiers: tuple[int, ...], pivots: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of rows with different labels at most `distance` bits apart: with tiers, ascending and the last of them
    `distance`, only those of a spanning forest that takes near pairs first; without, all of them."""
    n = len(words)
    table = np.bitwise_count(words[:, None, :] ^ pivots[None, :, :]).sum(2, dtype=np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    words, table, label, kept = words[order], table[order], label[order].copy(), []
    for most in tiers or (distance,):
        reach = np.searchsorted(table[:, 0], table[:, 0] + most, "right")
        for i in range(n - 1):
            j = np.arange(i + 1, reach[i])
            j = j[label[j] != label[i]]
            j = j[np.abs(table[j] - table[i]).max(1, initial=0) <= most]
            j = j[np.bitwise_count(words[j] ^ words[i]).sum(1, dtype=np.int64) <= most]
            if not tiers:
                kept.extend((i, k) for k in j)
                continue
            while len(j):
                kept.append((i, j[0]))
                label[label == label[j[0]]] = label[i]
                j = j[label[j] != label[i]]
    return order[np.array(kept, np.int64).reshape(-1, 2)]


def small_linked(words: np.ndarray, label: np.ndarray, group: np.ndarray, distance: int, largest: int, pivots: np.ndarray) -> np.ndarray:
    """All such pairs within groups (equal neighbours in `group`) of at most `largest` rows, for all groups at once."""
    table = np.bitwise_count(words[:, None, :] ^ pivots[None, :, :]).sum(2, dtype=np.int16)
    out = [np.zeros((0, 2), np.int64)]
    for step in range(1, largest):
        i = np.flatnonzero((group[step:] == group[:-step]) & (label[step:] != label[:-step]))
        i = i[np.abs(table[i + step] - table[i]).max(1, initial=0) <= distance]
        i = i[np.bitwise_count(words[i + step] ^ words[i]).sum(1, dtype=np.int64) <= distance]
        out.append(np.stack([i, i + step], 1))
    return np.concatenate(out)


def _reference_prints(width: int, pivots: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, (pivots, width), np.uint64)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The input, sorted by key, in parts that end where a bucket ends."""
    rest: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        parts = [*rest, *([b] if b is not None and b.num_rows else [])]
        if not parts:
            continue
        whole = pa.Table.from_batches(parts).combine_chunks()
        cut = whole.num_rows
        if b is not None:  # the last bucket may go on in the next batch
            key = whole.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            rest = whole.slice(cut).combine_chunks().to_batches()
        if cut:
            yield whole.slice(0, cut)


_SMALL = 16


def exact_keys(masks: list[list[int]]) -> F.Column:
    """The key of each mask, for prints whose first word holds the bits."""
    return F.array(*(F.xxhash64(F.lit(k), F.col("words")[0].bitwiseAND(F.lit(_bits(1, m)[0]))) for k, m in enumerate(masks)))


def nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, each_of: int) -> np.ndarray:
    """The places of the `each_of` nearest a of each b, equally near ones by a; a pair that comes again counts once."""
    order = np.lexsort((a, apart, b))
    order = order[np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))[: len(order)]]
    first = np.flatnonzero(np.concatenate(([True], np.diff(b[order]) != 0))[: len(order)])
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate((first, [len(order)]))))
    return order[place < each_of]


def links(dealt: DataFrame, distance: int, tiers: tuple[int, ...], width: int, pivots: int = 16, beside: int | None = None, each_of: int | None = None) -> DataFrame:
    """dealt (key, id, label, words) to the pairs (a, b) of ids with different labels that `linked` finds in each bucket, with the bits in which
    they differ; small buckets give all their pairs. With `beside`, large ones give pairs of neighbours in the order of the first pivot only; with `each_of`,
    no more than so many nearest a of a b leave a task for each part of the input, which holds all that are among the nearest overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = _reference_prints(width, pivots)
        for part in _whole_buckets(batches):
            key = part.column("key").to_numpy()
            size = np.diff(np.concatenate((edge := np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)])))
            each = np.repeat(size, size)
            part, bucket, each = part.filter(pa.array(each > 1)), np.repeat(edge, size)[each > 1], each[each > 1]
            ids, label = (part.column(c).to_numpy() for c in ("id", "label"))
            words = np.ascontiguousarray(np.stack([part.column(f"w{k}").to_numpy() for k in range(width)], 1)).view(np.uint64)
            few = np.flatnonzero(each <= _SMALL)
            found = [few[small_linked(words[few], label[few], bucket[few], distance, _SMALL, refs)]]
            many = np.flatnonzero(each > _SMALL)
            if beside is not None and len(many):
                first = np.bitwise_count(words[many] ^ refs[0]).sum(1, dtype=np.int64)
                many = many[np.lexsort((first, bucket[many]))]
                found.append(many[small_linked(words[many], label[many], bucket[many], distance, beside + 1, refs)])
            for own in np.split(many, np.flatnonzero(np.diff(bucket[many])) + 1) if beside is None and len(many) else []:
                if (label[own] != label[own[0]]).any():
                    found.append(own[linked(words[own], label[own], distance, tiers, refs)])
            pairs = np.concatenate(found)
            a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
            apart = np.bitwise_count(words[pairs[:, 0]] ^ words[pairs[:, 1]]).sum(1, dtype=np.int64)
            a, b = np.minimum(a, b), np.maximum(a, b)
            if each_of is not None:
                a, b, apart = (x[kept] for kept in [nearest(a, b, apart, each_of)] for x in (a, b, apart))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart)], ["a", "b", "apart"])

    flat = dealt.select("key", "id", "label", *(F.col("words")[k].alias(f"w{k}") for k in range(width)))
    return flat.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, apart long")


def exact_links(prints: DataFrame, distance: int, stash: Stash, most: int = 8192) -> DataFrame:
    """Pairs of prints (id, label, words: one word) within `distance`, of which a spanning forest of each bucket."""
    masks = exact_masks(distance)
    dealt = prints.select("id", "label", "words", F.posexplode(exact_keys(masks)).alias("at", "key"))
    hot = stash.put(dealt.groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("hot")), "hot")
    if hot.limit(1).count():
        finer = [exact_masks(distance, sorted(set(range(64)) - set(m))) for m in masks]
        keys = F.array(*(F.array(*(F.xxhash64("key", F.lit(k), F.col("words")[0].bitwiseAND(F.lit(_bits(1, f)[0]))) for k, f in enumerate(row))) for row in finer))
        dealt = dealt.join(hot, "key", "left").select("id", "label", "words", F.explode(F.when(F.col("hot"), keys[F.col("at")]).otherwise(F.array("key"))).alias("key"))
    return links(dealt, distance, (distance,), 1)


def split_links(dealt: DataFrame, hot: DataFrame | None, distance: int, width: int, beside: int, each_of: int) -> DataFrame:
    """`links` where buckets in hot (key, parts, centre: id, label, words) are dealt to so many parts, each row also meeting the centre."""
    if hot is None:
        return links(dealt, distance, (), width, beside=beside, each_of=each_of)
    both = dealt.join(hot, "key", "left")
    far = sum((F.bit_count(F.col("words")[k].bitwiseXOR(F.col("centre.words")[k])) for k in range(width)), F.lit(0))
    with_centre = both.filter(F.col("centre").isNotNull() & (F.col("label") != F.col("centre.label")) & (far <= distance)).select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b"), far.cast("long").alias("apart"))
    key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("parts"))))
    return links(both.select(key.alias("key"), "id", "label", "words"), distance, (), width, beside=beside, each_of=each_of).union(with_centre)


def _named(each: DataFrame, pairs: DataFrame, stash: Stash) -> DataFrame:
    """each (node, least, ...) with component_id, the smallest `least` over the nodes that pairs (a, b) join."""
    roots = components(pairs, stash)
    linked = each.select("node", "least").join(roots, "node")
    linked = stash.put(linked.groupBy("root").agg(F.min("least").alias("component_id")).join(roots, "root").select("node", "component_id"), "linked")
    return each.join(linked, "node", "left").withColumn("component_id", F.coalesce("component_id", "least"))


def simhash_components(docs: DataFrame, n: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most `distance` bits)."""
    stash = Stash(docs.sparkSession)
    rows = stash.put(fingerprints(docs, n, id_col, text_col), "prints")
    each = stash.put(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "each")
    found = exact_links(each.select(F.col("node").alias("id"), F.col("node").alias("label"), F.array("node").alias("words")), distance, stash)
    named = _named(each, found, stash).select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _reach(similarity: float, bits: int, lost: float) -> int:
    """The distance that all but a share `lost` of pairs at this Jaccard similarity keep (two sets of like size have the cosine
    2J / (1 + J), and a bit differs with the chance of its angle)."""
    flip = math.acos(min(2 * similarity / (1 + similarity), 1.0)) / math.pi
    return int(np.flatnonzero(np.cumsum(distances(bits, flip)) >= 1 - lost)[0])


# --- near copies ---------------------------------------------------------------------------------------------------

_BANDS, _WIDTH, _ROWS = 24, 2, 512
_LONG, _AT_ONCE = 1 << 20, 1 << 18  # shingles of a part of a bucket, and shingles compared at once
_TURNS = np.random.default_rng(31).integers(0, 1 << 63, 2 * _BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """_BANDS keys of a text, each made of two min-wise shingles; one key for a text without any."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        least = np.concatenate([(hashes[None, :] * _TURNS[k : k + 8, None]).min(1) for k in range(0, len(_TURNS), 8)])
        return mixed(least[:_BANDS] * np.uint64(3) + mixed(least[_BANDS:] + np.arange(_BANDS, dtype=np.uint64)))


def near_prints(docs: DataFrame, n: int, exact: bool) -> DataFrame:
    """docs (doc_id, digest, text) to doc_id, digest, words (128 bits over distinct shingles), n (shingles with repeats) and keys; if `exact`, each shingle is a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            lists = [shingle_hashes(t.as_py(), n) for t in b.column(2)]
            sets = [np.unique(x) for x in lists]
            words = [fingerprint(s, _WIDTH).view(np.int64).tolist() for s in sets]
            keys = [(s if exact and len(s) else band_keys(s)).view(np.int64) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.int64())), pa.array([len(x) for x in lists], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "digest", "words", "n", "keys"])

    return docs.mapInArrow(run, "doc_id long, digest string, words array<long>, n long, keys array<long>")


def alike(s: np.ndarray, t: np.ndarray, n: int) -> float:
    """The similarity of two texts by their shingle hashes in order: the larger one of the Jaccard similarity of the sets, and the share of words that lie in
    a shingle of the other text too (the smaller one of both sides). One changed word breaks n shingles, but it leaves
    the words around it in shingles that are shared. A shingle counts where it first occurs, so that repeats weigh nothing."""
    if not len(s) or not len(t):
        return float(len(s) == len(t))
    sets = [np.unique(x, return_index=True) for x in (s, t)]
    shared = np.intersect1d(sets[0][0], sets[1][0], assume_unique=True)
    covered = []
    for x, (own, at) in zip((s, t), sets):
        first, both = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        first[at], both[at] = 1, np.isin(own, shared, assume_unique=True)
        word = np.arange(len(x) + n - 1 if len(x) > 1 else 1)
        inside = lambda on: (c := np.concatenate(([0], np.cumsum(on))))[np.minimum(word + 1, len(x))] > c[np.maximum(word - n + 1, 0)]  # noqa: B023, E731
        covered.append(float(inside(both).sum() / inside(first).sum()))
    return max(len(shared) / (len(sets[0][0]) + len(sets[1][0]) - len(shared)), min(covered))


def shingle_lists(docs: DataFrame, n: int) -> DataFrame:
    """docs (node, text) to node and the shingle hashes of its text in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py(), n).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


class Lists:
    """Shingle lists of many texts, of which one is compared with others at once."""

    def __init__(self, lists: pa.ListArray, n: int):
        self.n, self.at = n, np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).astype(np.int64)
        self.long = np.diff(self.at)
        names, self.name = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(self.long)), self.long)
        self.first = np.zeros(len(row), bool)
        self.first[np.unique(row * max(len(names), 1) + self.name, return_index=True)[1]] = True
        self.distinct = self._sum(self.first, self.at)
        self.covered = self._covered(np.flatnonzero(self.first) + row[self.first] * (n - 1), self.long)
        self.place = np.zeros(len(names), np.int32)  # of the text that is compared: where each of its shingles first is, from 1

    @staticmethod
    def _sum(on: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(on, dtype=np.int64)))[at])

    def _covered(self, shingles: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The words of each of texts of so many shingles that lie in the given ones, each text having n - 1 words more than shingles."""
        at = np.concatenate(([0], np.cumsum(long + self.n - 1)))
        inside = np.zeros(at[-1], bool)
        for k in range(self.n):
            inside[shingles + k] = True
        return self._sum(inside, at)

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """`alike` of text i and each of the others."""
        if not self.long[i]:
            return (self.long[others] == 0).astype(float)
        own = np.arange(self.at[i], self.at[i + 1])[self.first[self.at[i] : self.at[i + 1]]]
        self.place[self.name[own]] = own - self.at[i] + 1
        cost, out = np.cumsum(self.long[others] + self.long[i]), []
        for j in np.split(others, np.searchsorted(cost, np.arange(_AT_ONCE, cost[-1], _AT_ONCE))):
            long = self.long[j]
            row = np.repeat(np.arange(len(j)), long)
            at = np.arange(len(row)) + np.repeat(self.at[j] - np.concatenate(([0], np.cumsum(long)))[:-1], long)
            place = self.place[self.name[at]]
            hit = np.flatnonzero((place > 0) & self.first[at])
            shared = np.bincount(row[hit], minlength=len(j))
            theirs = self._covered(hit + row[hit] * (self.n - 1), long)
            ours = self._covered(row[hit] * (self.long[i] + self.n - 1) + place[hit] - 1, np.full(len(j), self.long[i]))
            share = np.minimum(ours / self.covered[i], theirs / np.maximum(self.covered[j], 1))
            out.append(np.maximum(shared / (self.distinct[i] + self.distinct[j] - shared), share))
        self.place[self.name[own]] = 0
        return np.concatenate(out)


def meetings(part: pa.Table, label: np.ndarray, near: int, width: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(start, end, i, j): row i of the bucket in rows start to end meets the later rows j of other labels, as they are then, whose fingerprints are at most
    `near` bits apart. If the bucket's rows are of two parts, only those of the other part; with band keys, only those that meet i in no earlier band."""
    key, of, at = (part.column(c).to_numpy() for c in ("key", "part", "at"))
    words = np.ascontiguousarray(np.stack([part.column(f"w{k}").to_numpy() for k in range(width)], 1)).view(np.uint64)
    bands = None
    if "keys" in part.column_names:
        lists = part.column("keys").combine_chunks()
        bands = np.zeros((len(key), _BANDS), np.int64)
        bands[pc.list_value_length(lists).to_numpy() == _BANDS] = lists.filter(pc.equal(pc.list_value_length(lists), _BANDS)).flatten().to_numpy().reshape(-1, _BANDS)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
        two = of[start:end].min() != of[start:end].max()
        for i in range(start, end - 1):
            j = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
            if two:
                j = j[of[j] != of[i]]
            j = j[np.bitwise_count(words[j] ^ words[i]).sum(1, dtype=np.int64) <= near]
            if bands is not None and at[i] and len(j):
                j = j[~(bands[j, : at[i]] == bands[i, : at[i]]).any(1)]
            if len(j):
                yield start, end, i, j


def all_links(nodes: DataFrame, lists_of: Callable[[DataFrame], DataFrame], near: int, n: int, similarity: float, most: int, exact: bool, stash: Stash) -> DataFrame:
    """Links (a, b) that join all of nodes (node, label, words, n, keys) which have different labels, meet in a bucket and are alike. Each pair that meets is joined, too far
    apart by its fingerprints, or compared on whole shingle lists: in its bucket, to which the lists of those that meet there are sent, so that no pair becomes a row. A bucket leaves a
    spanning forest. Buckets of over `most` members, or of long lists, are cut into parts that meet two by two.
    lists_of: nodes (node) to their shingle lists (node, shingles)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_buckets(batches):
            met = np.zeros(part.num_rows, bool)
            for _, _, i, j in meetings(part, part.column("label").to_numpy(), near, _WIDTH):
                met[i] = met[j] = True
            yield from part.select(["key", "part", "at", "node"]).filter(pa.array(met)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_buckets(batches):
            lists, label, node, found = Lists(part.column("shingles").combine_chunks(), n), part.column("label").to_numpy().copy(), part.column("node").to_numpy(), [np.zeros((0, 2), np.int64)]
            for start, end, i, j in meetings(part, label, near, _WIDTH):
                j, own = j[lists.alike(i, j) >= similarity], label[start:end]
                while len(j):
                    found.append(node[[[i, j[0]]]])
                    own[own == label[j[0]]] = label[i]
                    j = j[label[j] != label[i]]
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    plain = ["node", "label", *(F.col("words")[k].alias(f"w{k}") for k in range(_WIDTH)), *([] if exact else ["keys"])]
    dealt = nodes.select("node", "n", "label", F.posexplode("keys").alias("at", "key"))
    parts = F.when((F.col("held") > most) | (F.col("long") > 2 * _LONG), F.ceil(F.greatest(F.col("held") / max(most // 2, 1), F.col("long") / _LONG))).otherwise(1).cast("long")
    mixed_buckets = dealt.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held"), F.sum("n").alias("long")).filter("low <> high").select("key", parts.alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    held = stash.put(dealt.select("key", "at", "node").join(bounded(stash.put(mixed_buckets, "mixed")), "key").withColumn("part", part), "held")
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.xxhash64("key", F.least(k, "part"), F.greatest(k, "part")))
    cells = held.select("part", "at", "node", F.explode(F.when(F.col("parts") > 1, meets).otherwise(F.array("key"))).alias("key"))
    in_order = lambda df: df.repartition("key").sortWithinPartitions("key")
    met = stash.put(in_order(cells.join(nodes.select(*plain), "node").select("key", "part", "at", *(c for c in ["node", "label", *(f"w{k}" for k in range(_WIDTH)), *([] if exact else ["keys"])]))).mapInArrow(meet, "key long, part long, at int, node long"), "met")
    whole = met.join(nodes.select(*plain), "node").join(stash.put(lists_of(met.select("node").distinct()), "lists"), "node")
    return in_order(whole).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", exact: bool = False, most: int = 4096) -> DataFrame:
    """doc_id, digest (of the text) and component_id of texts that are joined by pairs which are `alike` by at least `similarity`.

    Equal texts are one node. Nodes meet in the buckets of their band keys, where fingerprints that are as far apart as
    those of unrelated texts are discarded; all others are verified on whole shingle lists. Two rounds take the nearest two and four links of each text (in large
    buckets from its neighbours in the pivot table), so that most of a hot group of copies is joined by a few pairs a member; then `all_links` joins or compares every pair that meets and is
    still apart, so a rejected link hides no other one and nothing is capped. A pair at a Jaccard similarity j meets with probability
    1 - (1 - j^2)^24: 0.98 at j = 0.39, which is where a share of 0.8 of the words lies with changes spread at random. With `exact` texts meet in
    each shingle that they share and no fingerprint is discarded, so no pair that shares a shingle is lost, at the price of a row for each shingle."""
    stash = Stash(docs.sparkSession, batch_rows=2000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    rows = stash.put(near_prints(base, n, exact), "prints")
    each = stash.put(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first(F.struct("words", "n", "keys")).alias("x")).select("digest", "least", "x.words", "x.n", "x.keys", F.monotonically_increasing_id().alias("node")), "each")
    near = 64 * _WIDTH if exact else _reach(1 / 3, 64 * _WIDTH, 0.002)

    def candidates(nodes: DataFrame, beside: int, each_of: int) -> DataFrame:
        dealt = nodes.select(F.col("node").alias("id"), "label", "words", F.explode("keys").alias("key"))
        centre = F.min_by(F.struct("id", "label", "words"), F.xxhash64("key", "id", F.lit(beside)))
        hot = stash.put(dealt.groupBy("key").agg(F.count("*").alias("n"), centre.alias("centre")).filter(F.col("n") > most).select("key", F.ceil(F.col("n") / (most // 2)).alias("parts"), "centre"), "hot")
        pairs = split_links(dealt, hot if hot.limit(1).count() else None, near, _WIDTH, beside, each_of).groupBy("a", "b").agg(F.min("apart").alias("apart"))
        place = F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))  # of the members of a group most need a few links only; all_links sees to the rest
        return stash.put(pairs.withColumn("place", place).filter(F.col("place") <= each_of).select("a", "b"), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(2), b.column(3))]
                good = [alike(*(v[o[k] : o[k + 1]] for v, o in lists), n) >= similarity for k in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")

    def lists_of(nodes: DataFrame) -> DataFrame:
        wanted = bounded(nodes.join(each, "node").select("digest", "least", "node"))
        return shingle_lists(base.join(wanted, "digest").filter("doc_id <=> least"), n).dropDuplicates(["node"])

    def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
        return stash.put(nodes.join(components(links, stash), "node", "left").select("node", F.coalesce("root", "node").alias("label"), "words", "n", "keys"), "open")

    found = candidates(each.withColumn("label", F.col("node")), 8, 2)
    nodes = stash.put(found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct().join(each, "node"), "nodes")
    sets = stash.put(lists_of(nodes.select("node")), "sets")
    same = stash.put(verified(found), "same")
    again = stash.put(candidates(labelled(nodes, same), 16, 4).join(found, ["a", "b"], "left_anti"), "untested")
    same = stash.put(same.union(verified(again)), "same")
    rest = stash.put(all_links(labelled(each, same), lists_of, near, n, similarity, most, exact, stash), "rest")
    same = stash.put(same.union(rest), "same")
    named = _named(each.select("node", "digest", "least"), same, stash).select("digest", "component_id")
    return rows.select("doc_id", "digest").join(named, "digest")


QUERY = "op6_simhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = None
