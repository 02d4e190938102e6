"""Substring dedup on suffix arrays built with difference covers.

Each byte goes that is covered by a string of `length` bytes (50) which also starts in a document with a smaller id.

Equal texts come first: all but the one with the smallest id are covered whole. Of the distinct texts, work is dealt out by
winnowing: each window of `length` bytes selects the smallest hash of its 16-byte grams, which depends on its bytes alone, so
equal windows select the same hash, wherever they are. A hash that only one id selects proves all its windows unique, and
they leave (grouped counts, no list of them is collected). What is left, maximal runs of windows with one hash, meets by hash
in tasks; equal runs of one batch are combined before they are sent. Each batch of whole hashes sorts the suffixes of its
distinct runs by the difference-cover algorithm modulo 3: sampled triples (positions not divisible by 3) are sorted and
named, the names are sorted in the same way by recursion until all differ, the remaining suffixes are sorted by their first
letter and the rank after it, and both are merged by comparing through the cover. Neighbours in the suffix array are compared
on their first `length` bytes, and each class of equal prefixes has the smallest id of its members. A run that is the only
one of its hash has nothing to be compared with. A task holds the runs of one hash together, but sorts them in parts: the
windows of more than a megabyte of runs are dealt once more, by another hash of their bytes, to one suffix array after the
other, and the places of runs are looked up half a million windows at a time.

A hash that `hot` documents or more select is dealt by a second hash as well (the next smallest of the window), and its runs
are sent without the places where they occur: the answer for a run is joined with its places afterwards, so that a passage
that a third of all documents hold is neither one task nor one row.

Cases: null text counts as empty; a text shorter than `length` loses nothing; a null id counts as greater than all others
and equal to 2^63 - 1; ids are BIGINT or cast to it (others are an error); rows with equal id and text are one document and
equal ids never remove from each other; matches never cross documents; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash, bounded, mixed, read_table, slices

_LAST = (1 << 63) - 1  # stands for a null id
_GRAM, _MOST_STARTS, _BATCH = 16, 64, 1 << 19
_SLICE = 1 << 17  # bytes of text whose hashes fit the cache
_HELD = 16 << 20  # bytes of runs in which equal ones are combined
_SORTED = 1 << 20  # bytes of runs that share one suffix array, which takes about a hundred times as many
_LOOKED_UP = 1 << 19  # windows of places that are looked up at once


# --- the difference-cover suffix array -----------------------------------------------------------------------------


def _triples(*parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Numbers that order the triples of all parts together; values are under 2^31."""
    if max(int(x.max(initial=0)) for p in parts for x in p) < 1 << 21:
        return [a << 42 | b << 21 | c for a, b, c in parts]
    pair = np.unique(np.concatenate([a << 32 | b for a, b, _ in parts]), return_inverse=True)[1]
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [x << 32 | p[2] for x, p in zip(np.split(pair, cut), parts)]


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes. letters: values from 1 to 2^31 - 1."""
    n = len(letters)
    if n < 2:
        return np.arange(n)
    s = np.concatenate((letters.astype(np.int64), np.zeros(6, np.int64)))
    at = np.arange(n + (n % 3 == 1))  # one more position, so that the mod 1 part ends in a triple of its own
    sample = np.concatenate((at[at % 3 == 1], at[at % 3 == 2]))
    (key,) = _triples((s[sample], s[sample + 1], s[sample + 2]))
    name = np.unique(key, return_inverse=True)[1] + 1
    order = sample[suffix_array(name) if name.max() < len(name) else np.argsort(name)]
    rank = np.zeros(n + 6, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rest = at[(at % 3 == 0) & (at < n)]
    rest = rest[np.argsort(s[rest] << 32 | rank[rest + 1], kind="stable")]
    order = order[order < n]
    one, two = order[order % 3 == 1], order[order % 3 == 2]
    after_one = np.searchsorted(s[one] << 32 | rank[one + 1], s[rest] << 32 | rank[rest + 1])
    after_two = np.searchsorted(*_triples(*((s[i], s[i + 1], rank[i + 2]) for i in (two, rest))))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + after_one + after_two
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = order
    return out


def least_ids(runs: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of each run, one after another, the smallest id among the runs that hold that window."""
    size = np.array([len(r) for r in runs], np.int64)
    text = np.frombuffer(b"\0".join(runs) + b"\0" * (length + 8), np.uint8)
    first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    letters = text[: int(first[-1] + size[-1])].astype(np.int64) + 1
    letters[first[1:] - 1] = 0  # between runs; below every byte
    letters += 1
    starts = size - length + 1
    owner = np.full(len(letters), -1, np.int64)
    at = np.repeat(first, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    owner[at] = np.repeat(np.arange(len(runs)), starts)
    order = suffix_array(letters)
    order = order[owner[order] >= 0]
    same, data = np.ones(len(order) - 1, bool), text.tobytes()
    for k in [*range(0, length - 7, 8), max(length - 8, 0)]:
        word = np.ndarray((len(letters),), "<u8", data, k, (1,))[order]
        same &= word[1:] == word[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    low = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(np.concatenate(([True], ~same))))
    best = np.empty(len(letters), np.int64)
    best[order] = low[group]
    return best[at]


# --- winnowing -----------------------------------------------------------------------------------------------------


def _smallest(raw: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and the smallest one in each window of `length` bytes. A salt makes other hashes of the same grams."""
    n, width = len(raw), length - _GRAM + 1
    data = raw.tobytes() + bytes(_GRAM)
    low, high = (np.ndarray((n,), "<u8", data, k, (1,)) for k in (0, 8))
    with np.errstate(over="ignore"):
        h = low * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += high
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        if salt:
            h = mixed(h + np.uint64(salt))
    best, have = np.concatenate((h, np.full(width, np.uint64((1 << 64) - 1)))), 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    return h, np.minimum(best[:n], best[width - have : width - have + n])


def _next_smallest(h: np.ndarray, start: np.ndarray, best: np.ndarray, width: int) -> np.ndarray:
    """For the windows at `start` the smallest of their hashes that is not `best`."""
    out = []
    for k in range(0, len(start), 1 << 15):
        own = h[start[k : k + (1 << 15), None] + np.arange(width)]
        out.append(np.where(own == best[k : k + (1 << 15), None], np.uint64((1 << 64) - 1), own).min(1))
    return np.concatenate(out)


def runs_of(raw: np.ndarray, at: np.ndarray, length: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Selected hash, text, first window and number of windows of each maximal run of windows with one selected hash, and the
    key that deals it: the hash itself, or for hashes in `hot` one that depends on the next smallest hash too."""
    n, width = len(raw), length - _GRAM + 1
    end = at[:-1] + np.maximum(np.diff(at) - length + 1, 0)  # of the windows of each text
    if not (end > at[:-1]).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, best = _smallest(raw, length)
    key = best
    if hot is not None and len(hot):
        row = np.searchsorted(at, np.arange(n), "right") - 1
        k = np.flatnonzero(np.isin(best.view(np.int64), hot) & (np.arange(n) < end[row]))
        if len(k):
            key = best.copy()
            with np.errstate(over="ignore"):
                key[k] = mixed(best[k] * np.uint64(3) + _next_smallest(h, k, best[k], width))
    new = np.ones(n + 1, bool)
    new[1:n] = key[1:] != key[:-1]
    new[at[:-1]] = new[end] = True
    k = np.flatnonzero(new[:n])
    size = np.diff(np.concatenate((k, [n])))
    row = np.searchsorted(at, k, "right") - 1
    inside = k < end[row]
    k, size, row = k[inside], size[inside], row[inside]
    parts = -(-size // _MOST_STARTS)
    if len(parts) and parts.max() > 1:  # long runs in parts
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        k, size, row = np.repeat(k, parts) + nth * _MOST_STARTS, np.repeat(size, parts) - nth * _MOST_STARTS, np.repeat(row, parts)
        size = np.minimum(size, _MOST_STARTS)
    return best[k].view(np.int64), row, k, size, key[k].view(np.int64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n numbers, one range after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def least_ids_in_parts(runs: list[bytes], ids: np.ndarray, length: int, most: int = _SORTED, salt: int = 1) -> np.ndarray:
    """least_ids for any number of runs. Windows of more than `most` bytes of runs are dealt by the smallest of their salted
    hashes, which depends on their bytes alone, and of each part equal stretches are combined; a part that is still too large
    is dealt by the next salt. Eight times at most: then what is left goes into one array."""
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    if size.sum() <= most or salt > 8:
        return least_ids(runs, ids, length)
    windows = size - length + 1
    base, parts, found = np.cumsum(windows) - windows, 2 + 3 * int(size.sum() // most), []
    for first in range(0, len(runs), 1024):
        raw, at = np.frombuffer(b"".join(runs[first : first + 1024]), np.uint8), np.concatenate(([0], np.cumsum(size[first : first + 1024])))
        part = _smallest(raw, length, salt)[1] % np.uint64(parts)
        new = np.ones(len(raw), bool)
        new[1:] = part[1:] != part[:-1]
        new[at[:-1]] = new[at[1:] - length + 1] = True
        k = np.flatnonzero(new)
        row = np.searchsorted(at, k, "right") - 1
        n = np.diff(np.concatenate((k, [len(raw)])))
        inside = k < at[row + 1] - length + 1
        k, row, n = k[inside], row[inside], n[inside]
        found.append((part[k].astype(np.int64), row + first, k - at[row], n))
    part, row, start, n = (np.concatenate(x) for x in zip(*found))
    out = np.empty(windows.sum(), np.int64)
    for p in range(parts):
        own = np.flatnonzero(part == p)
        if not len(own):
            continue
        blocks = [runs[r][s : s + k + length - 1] for r, s, k in zip(row[own].tolist(), start[own].tolist(), n[own].tolist())]
        coded = pa.array(blocks, pa.binary()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        least = np.full(len(distinct), _LAST, np.int64)
        np.minimum.at(least, code, ids[row[own]])
        best = least_ids_in_parts(distinct, least, length, most, salt + 1)
        each = np.fromiter(map(len, distinct), np.int64, len(distinct)) - length + 1
        out[_ranges(base[row[own]] + start[own], n[own])] = best[_ranges((np.cumsum(each) - each)[code], n[own])]
    return out


def _selected(texts: DataFrame, length: int, owner: str) -> DataFrame:
    """(pick, owner): each hash that a text selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, raw, at in slices(b.column(1), _SLICE):
                pick, row, *_ = runs_of(raw, at, length)
                yield pa.RecordBatch.from_arrays([pa.array(pick), b.column(0).take(pa.array(row + first))], ["pick", owner])

    return texts.select(owner, "text").mapInArrow(run, f"pick long, {owner} long")


def _kept_runs(b: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """From a batch (own, tag, text, picks, hots) the runs whose hash is in picks or hots: row of the batch, start in its text, key,
    whether the hash is hot, bytes; a few megabytes at a time."""
    flat, cut = zip(*((b.column(k).values.to_numpy(), b.column(k).offsets.to_numpy()) for k in (3, 4)))
    part: list = []
    held = 0
    for first, end, raw, at in slices(b.column(2), _SLICE):
        hots = np.unique(flat[1][cut[1][first] : cut[1][end]])
        pick, row, start, n, key = runs_of(raw, at, length, hots)
        wanted = np.zeros(len(pick), bool)
        edge = np.searchsorted(row, np.arange(end - first + 1))
        for k in range(end - first):
            own = [f[c[first + k] : c[first + k + 1]] for f, c in zip(flat, cut)]
            wanted[edge[k] : edge[k + 1]] = np.isin(pick[edge[k] : edge[k + 1]], np.concatenate(own))
        pick, row, start, n, key = (x[wanted] for x in (pick, row, start, n, key))
        data = raw.tobytes()
        blocks = [data[s : s + k + length - 1] for s, k in zip(start.tolist(), n.tolist())]
        part.append((row + first, start - at[row], key, np.isin(pick, hots), blocks))
        held += int(n.sum()) + len(n) * length
        if held > _HELD or end == b.num_rows:
            yield *(np.concatenate([p[k] for p in part]) for k in range(4)), [x for p in part for x in p[4]]
            part, held = [], 0


def _repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """texts (own, tag, text, picks, hots) to one row for each distinct run of a part of a batch: key, run, its least id, hot, and
    where it occurs (own, tag and start, as 64-bit numbers), which is left out for hot runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, tag = (b.column(k).to_numpy() for k in (0, 1))
            for row, start, key, hot, blocks in _kept_runs(b, length):
                if not blocks:
                    continue
                coded = pa.array(blocks, pa.binary()).dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                first = np.searchsorted(code[order], np.arange(len(coded.dictionary)))
                least = np.minimum.reduceat(own[row[order]], first)
                listed = order[~hot[order]]
                offsets = 24 * np.concatenate(([0], np.cumsum(np.bincount(code[listed], minlength=len(first))))).astype(np.int32)
                packed = np.stack((own[row[listed]], tag[row[listed]], start[listed]), 1)  # one short field instead of three arrays
                places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key[order[first]]), coded.dictionary, pa.array(least), pa.array(hot[order[first]]), places], ["key", "run", "least", "hot", "places"])

    return texts.mapInArrow(run, "key long, run binary, least long, hot boolean, places binary")


def _hot_places(texts: DataFrame, length: int) -> DataFrame:
    """(digest of the run, own, tag, start) of each hot run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, start, _, hot, blocks in _kept_runs(b, length):
                at = np.flatnonzero(hot)
                digests = [xxhash.xxh3_128_digest(blocks[k]) for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(b.column(k).take(pa.array(row[at])) for k in (0, 1)), pa.array(start[at])], ["digest", "own", "tag", "start"])

    return texts.mapInArrow(run, "digest binary, own long, tag long, start long")


def _stretches(on: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of neighbouring places that are on and in one block."""
    edge, inside = np.concatenate(([False], on, [False])), np.concatenate(([False], block[1:] == block[:-1], [False]))
    return np.flatnonzero(on & ~(edge[:-2] & inside[:-1])), np.flatnonzero(on & ~(edge[2:] & inside[1:]))


def _covered(runs: DataFrame, length: int) -> DataFrame:
    """(own, tag, low, high): stretches of bytes that are also in a document with a smaller id; and for hot runs (digest, low,
    high, least): the least id of each stretch of windows."""
    names = ["own", "tag", "low", "high", "digest", "least"]

    def batch(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = table.column("run").combine_chunks().dictionary_encode()
        code, key, hot = coded.indices.to_numpy(), table.column("key").to_numpy(), table.column("hot").to_numpy()
        distinct = coded.dictionary.to_pylist()
        least = np.full(len(distinct), _LAST, np.int64)
        np.minimum.at(least, code, table.column("least").to_numpy())
        keys = np.zeros(len(distinct), np.int64)
        keys[code] = key
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) - length + 1
        base = np.cumsum(size) - size
        best = np.repeat(least, size)  # for the windows of the distinct runs, one after another
        met = np.flatnonzero(count[which] > 1)  # only these have something to be compared with
        if len(met):
            best[_ranges(base[met], size[met])] = least_ids_in_parts([distinct[k] for k in met.tolist()], least[met], length)
        packed = table.column("places").to_pylist()
        own, tag, start = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 3).T
        code_of = np.repeat(code, [len(x) // 24 for x in packed])
        ends, done = np.cumsum(size[code_of]), 0
        while done < len(code_of):
            last = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _LOOKED_UP, "right")))
            these = np.arange(done, last)
            n = size[code_of[these]]
            where = np.repeat(these, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin, end = _stretches(best[_ranges(base[code_of[these]], n)] < own[where], where)
            at, done = where[begin], last
            none = [pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(tag[at]), pa.array(start[at] + offset[begin]), pa.array(start[at] + offset[end] + length), *none], names)
        if hot.any():
            some = np.unique(code[hot])
            answers = [best[base[c] : base[c] + size[c]] for c in some.tolist()]
            cut = [np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) for x in answers]
            n = [len(x) for x in cut]
            digests = [d for c, k in zip(some.tolist(), n) for d in [xxhash.xxh3_128_digest(distinct[c])] * k]
            low = np.concatenate(cut)
            high = np.concatenate([np.append(x[1:], len(own)) for own, x in zip(answers, cut)]) + length - 1
            none = [pa.nulls(len(low), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*none, pa.array(low), pa.array(high), pa.array(digests, pa.binary()), pa.array(np.concatenate([own[x] for own, x in zip(answers, cut)]))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            bytes_held += b.nbytes
            if bytes_held < _BATCH:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            key = whole.column("key").to_numpy()
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(cut):
                done = 0
                sizes = np.cumsum(pc.binary_length(whole.column("run").chunk(0)).to_numpy())
                while done < cut[-1]:  # whole keys, about _BATCH bytes at a time
                    base = sizes[done - 1] if done else 0
                    k = int(np.searchsorted(cut, np.searchsorted(sizes, base + _BATCH // 2), "right")) - 1
                    end = int(cut[k]) if k >= 0 and cut[k] > done else int(cut[np.searchsorted(cut, done, "right")])
                    yield from batch(whole.slice(done, end - done).combine_chunks())
                    done = end
                whole = whole.slice(done)
            held = whole.combine_chunks().to_batches()
            bytes_held = sum(x.nbytes for x in held)
            if not len(cut):
                bytes_held = 0 if bytes_held < 4 * _BATCH else bytes_held // 2  # one large key: look again after more rows
        if held:
            yield from batch(pa.Table.from_batches(held).combine_chunks())

    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(run, "own long, tag long, low long, high long, digest binary, least long")


def substring_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left). `hot`: see above."""
    stash = Stash(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("own"), F.unhex(F.sha2(text, 256)).alias("name"), text.alias("text"))
    least = base.select("name", "own").groupBy("name").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least < most")
    copies = stash.put(base.select("name", "own").join(least, "name").filter("own > least").select("name", "own").distinct(), "copies")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 26)
    lead = stash.put_by(base.join(bounded(copies), ["name", "own"], "left_anti").select("doc_id", "own", F.xxhash64("name").alias("tag"), "text"), "lead", "tag", parts)
    texts = lead.filter(F.octet_length("text") >= length).select("own", "tag", "text")

    picked = _selected(texts, length, "own").groupBy("pick").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count("*").alias("n"))
    repeated = stash.put(picked.filter("a < b").select("pick", (F.col("n") >= hot).alias("hot")), "repeated")
    some = lambda cond: F.collect_list(F.when(cond, F.col("pick")))
    picks = stash.put(_selected(texts, length, "tag").join(repeated, "pick").groupBy("tag").agg(some(~F.col("hot")).alias("picks"), some(F.col("hot")).alias("hots")), "picks")
    found = stash.put(_covered(_repeated_runs(texts.join(picks.hint("shuffle_hash"), "tag").select("own", "tag", "text", "picks", "hots"), length), length), "found")
    spans = found.filter("digest IS NULL").select("own", "tag", "low", "high")
    if repeated.filter("hot").limit(1).count():
        places = _hot_places(texts.join(picks.filter("size(hots) > 0"), "tag").select("own", "tag", "text", F.expr("CAST(array() AS array<bigint>)").alias("picks"), "hots"), length)
        answers = found.filter("digest IS NOT NULL").select("digest", "low", "high", "least")
        spans = spans.union(places.join(answers, "digest").filter("least < own").select("own", "tag", F.expr("start + low"), F.expr("start + high")))
    covered = stash.put(spans.groupBy("tag").agg(F.collect_list(F.struct("own", "low", "high")).alias("covered")), "covered")
    stash.drop(repeated, picks, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own, t, spans in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                data, kept, n, end = (t.as_py() or "").encode(), [], 0, 0
                for low, high in sorted((s["low"], s["high"]) for s in spans.as_py() or () if s["own"] == own):
                    if low > end or not n:
                        kept.append(data[end:low])
                        n += 1
                    end = max(end, high)
                kept.append(data[end:])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            cols = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = lead.join(covered.hint("shuffle_hash"), "tag", "left").select("doc_id", "own", "text", "covered").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    size = F.octet_length("text").cast("long")
    whole = size >= length  # a copy of a text with a smaller id
    left = F.when(whole, F.lit("")).otherwise(F.col("text")).cast("binary")
    again = base.join(bounded(copies), ["name", "own"], "left_semi").select("doc_id", size, F.when(whole, size).otherwise(F.lit(0).cast("long")), whole.cast("long"), F.sha2(left, 256), left)
    return out.union(again)


QUERY = "op4_suffix_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL = """
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, u.i AS i, substr(h, 2 * u.i + 1, 100) AS g FROM raw, unnest(range(0, length(h) // 2 - 49)) AS u(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM starts) WHERE least < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
grouped AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS low, max(i) + 50 AS high FROM grouped GROUP BY doc_id, span),
ordered AS (SELECT doc_id, span, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM spans),
pieces AS (SELECT o.doc_id, string_agg(substr(r.h, 2 * o.before + 1, 2 * (o.low - o.before)), '' ORDER BY o.span) AS head, max(o.high) AS tail, sum(o.high - o.low)::BIGINT AS gone, count(*) AS n FROM ordered o JOIN raw r ON r.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT r.doc_id, (length(r.h) // 2)::BIGINT AS n_bytes, coalesce(p.gone, 0) AS n_removed, coalesce(p.n, 0) AS n_spans,
       sha256(unhex(CASE WHEN p.doc_id IS NULL THEN r.h ELSE coalesce(p.head, '') || substr(r.h, 2 * p.tail + 1) END)) AS kept_sha256
FROM raw r LEFT JOIN pieces p ON p.doc_id = r.doc_id
"""
