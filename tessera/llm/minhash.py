"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A text's set of word shingles is hashed once; the upper bits of a hash name one of 64 bins, and a bin keeps its least hash. An
empty bin takes the value of the first filled one in a fixed random order of the bins that is the bin's own (optimal densification),
so two sets agree in a bin with a chance equal to their Jaccard similarity, however small they are. Four bins make a band, of which there are 16:
a pair at similarity 0.85 shares no bucket with a chance of 7e-6, at 0.9 of 4e-8, whatever the number of rows.

Texts with equal sets are one node. Each bucket gives a star, an edge from each member to one centre, so that edges are at
most 16 for each node, however large a bucket is. An edge is dropped unseen only if a proof rules the link out: the sizes of the sets and the bits in which
their 512-bit parity maps differ are lower bounds of what the sets don't share. All other edges are confirmed on the
whole sets. What stars can't see, links between members that are not joined with each other over their centre, is sought in the buckets
that still hold more than one component: there members of different components are compared by the same bounds, first the nearest
pair of each two components, then every pair that is left, so that in the end each pair of one bucket is either joined,
ruled out by a bound, or confirmed on the whole sets. Buckets over `most` members are cut into parts that meet two by two, so no task holds a hot bucket.

Cases: a text without words or a null text has an empty set and is linked with nothing; one with fewer words than a shingle is one
shingle; equal sets are linked, repeated rows included; rows of one id are nodes like others, and one of their ids is the same id; a null id names a component only if all its ids are null
(kept compares null-safe); very long texts are read whole; an empty table gives no rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash, bounded, components, mixed, read_table
from tessera.llm.simhash import shingle_hashes

_BINS, _BAND, _MAP = 64, 4, 512
_DONORS = np.stack([np.random.default_rng(1000 + k).permutation(_BINS) for k in range(_BINS)])
_ROWS = 512  # texts hashed before a batch leaves
_FEW = 24  # buckets of up to so many rows are compared all at once
_CELLS = 1 << 18  # pairs of a larger bucket compared at once


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Mixed hashes of the distinct n-word shingles, ascending."""
    return np.sort(mixed(np.unique(shingle_hashes(text, n))))


def one_permutation(found: np.ndarray) -> np.ndarray:
    """The value of each bin of a set (ascending, not empty), densified."""
    bins = (found >> np.uint64(58)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(_BINS))
    filled = np.zeros(_BINS, bool)
    filled[bins] = True
    value = found[np.minimum(first, len(found) - 1)]
    donor = _DONORS[np.arange(_BINS), filled[_DONORS].argmax(1)]
    return np.where(filled, value, value[donor])


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set; none for an empty one."""
    if not len(found):
        return np.zeros(0, np.uint64)
    value, key = one_permutation(found).reshape(-1, _BAND), np.arange(_BINS // _BAND, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(_BAND):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + value[:, k])
    return key


def parity_map(found: np.ndarray) -> np.ndarray:
    """Bit j is the parity of the elements that fall on j. Two sets differ in at least as many elements as their maps in bits."""
    odd = np.bincount((found & np.uint64(_MAP - 1)).astype(np.int64), minlength=_MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def prints(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text_digest, text) to doc_id, text_digest, size and digest of the set, its keys and parity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            sets = [shingle_set(t.as_py(), n) for t in b.column(2)]
            listed = lambda rows, width: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(width if len(s) else 0 for s in sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                 listed([band_keys(s) for s in sets], _BINS // _BAND), listed([parity_map(s) for s in sets if len(s)], _MAP // 64)],
                ["doc_id", "text_digest", "n", "digest", "keys", "parity"],
            )

    return docs.mapInArrow(run, "doc_id long, text_digest string, n long, digest string, keys array<long>, parity array<long>")


def _possible(n: F.Column, m: F.Column, apart: F.Column, percent: int) -> F.Column:
    """Whether sets of n and m elements that differ in `apart` elements or more may have a similarity of percent."""
    return (100 + percent) * F.greatest(apart, F.abs(n - m)) <= (100 - percent) * (n + m)


def stars(members: DataFrame, percent: int) -> DataFrame:
    """members (key, node, n, parity, turn, centre_turn) to possible links (node, centre, apart) of each with its bucket's centre."""
    centres = members.filter("turn = centre_turn").select("key", F.col("node").alias("centre"), F.col("n").alias("m"), F.col("parity").alias("other"))
    both = members.join(centres, "key").filter("node <> centre")
    apart = sum((F.bit_count(F.col("parity")[k].bitwiseXOR(F.col("other")[k])) for k in range(_MAP // 64)), F.lit(0))
    return both.select("node", "centre", "n", "m", apart.alias("apart")).filter(_possible(F.col("n"), F.col("m"), F.col("apart"), percent)).groupBy("node", "centre").agg(F.min("apart").alias("apart"))


def pairs_apart(key: np.ndarray, part: np.ndarray, label: np.ndarray, n: np.ndarray, parity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Possible links (i, j, apart) of rows with equal key (keys stand together) and different labels. If a bucket's rows are of two parts, only between these."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((edge, [len(key)])))
    mixed_parts = np.maximum.reduceat(part, edge) != np.minimum.reduceat(part, edge)
    two, bucket = np.repeat(mixed_parts, size), np.repeat(edge, size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def tested(i: np.ndarray, j: np.ndarray) -> None:
        good = (label[i] != label[j]) & (~two[i] | (part[i] != part[j]))
        good &= (100 + percent) * np.abs(n[i] - n[j]) <= (100 - percent) * (n[i] + n[j])
        i, j = i[good], j[good]
        apart = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])
        out.append((i[near], j[near], apart[near]))

    few = np.flatnonzero(np.repeat(size, size) <= _FEW)
    for step in range(1, _FEW):
        k = np.flatnonzero(bucket[few[step:]] == bucket[few[:-step]])
        tested(few[k], few[k + step])
    for start, m in zip(edge[size > _FEW].tolist(), size[size > _FEW].tolist()):
        for rows in range(0, m, step := max(1, _CELLS // m)):
            i, j = np.meshgrid(np.arange(rows, min(rows + step, m)), np.arange(rows + 1, m), indexing="ij")
            later = j > i
            tested(start + i[later], start + j[later])
    return tuple(np.concatenate(x) for x in zip(*out))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The input, sorted by key, in parts of one or more whole buckets; batches are put together once for each such part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        if key[-1] == key[0] and (not held or held[-1].column(0)[-1].as_py() == key[0]):
            held.append(b)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def open_pairs(members: DataFrame, labels: DataFrame, percent: int, most: int, nearest: bool, stash: Stash) -> DataFrame:
    """Possible links (a, b, apart) of members of one bucket that are in different components (labels: node, label); with `nearest`, only the nearest
    of each two components of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_buckets(batches):
            key, where, node, label, n = (part.column(c).to_numpy() for c in ("key", "part", "node", "label", "n"))
            parity = np.ascontiguousarray(np.stack([part.column(f"p{k}").to_numpy() for k in range(_MAP // 64)], 1)).view(np.uint64)
            i, j, apart = pairs_apart(key, where, label, n, parity, percent)
            if nearest and len(i):
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                order = np.lexsort((node[j], node[i], apart, high, low, key[i]))
                same = lambda x: x[order][1:] == x[order][:-1]
                order = order[np.concatenate(([True], ~(same(key[i]) & same(low) & same(high))))]
                i, j, apart = i[order], j[order], apart[order]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(apart)], ["a", "b", "apart"])

    now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_buckets = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held")).filter("low <> high").select("key", F.ceil(F.col("held") / most).cast("long").alias("parts"))
    now = now.join(stash.put(mixed_buckets, "open"), "key").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0).cast("long")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.xxhash64("key", F.least(k, "part"), F.greatest(k, "part")))
    flat = now.select("node", "label", "n", "part", *(F.col("parity")[k].alias(f"p{k}") for k in range(_MAP // 64)), F.explode(F.when(F.col("parts") > 1, meets).otherwise(F.array("key"))).alias("key"))
    flat = flat.select("key", "part", "node", "label", "n", *(f"p{k}" for k in range(_MAP // 64)))
    return flat.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, apart long").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs (node, text) to node and its set, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), n).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "found"])

    return docs.mapInArrow(run, "node long, found array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of percent or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(2), b.column(3))]
            good = []
            for k in range(b.num_rows):
                s, t = (v[o[k] : o[k + 1]] for v, o in lists)
                shared = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
                good.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("found").alias("s")), sets.select(F.col("node").alias("b"), F.col("found").alias("t"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def minhash_components(docs: DataFrame, n: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", most: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of at least percent), kept (whether that is the row's own)."""
    stash = Stash(docs.sparkSession, batch_rows=2000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_digest"), text.alias("text"))
    rows = stash.put(prints(base, n), "prints")
    each = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("text_digest").alias("text_digest"), F.first(F.struct("n", "keys", "parity")).alias("x"))
    each = stash.put(each.select("digest", "least", "text_digest", "x.*", F.monotonically_increasing_id().alias("node")), "each")

    dealt = each.select("node", "n", "parity", F.explode("keys").alias("key")).withColumn("turn", F.xxhash64("key", "node"))
    shared = stash.put(dealt.groupBy("key").agg(F.count("*").alias("held"), F.min("turn").alias("centre_turn")).filter("held > 1").select("key", "centre_turn"), "shared")
    members = stash.put(dealt.join(shared, "key"), "members")

    star = stash.put(stars(members, percent), "stars")
    first = star.groupBy("node").agg(F.min(F.struct("apart", "centre")).alias("x")).select("node", F.col("x.centre").alias("centre"))
    ordered = lambda df: df.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    labels_of = lambda links: stash.put(components(links, stash).select("node", F.col("root").alias("label")), "labels")
    wanted = stash.put(members.select("node").distinct().join(each.select("node", "text_digest"), "node"), "wanted")
    sets = base.select("text_digest", "text").join(bounded(wanted), "text_digest").dropDuplicates(["node"]).select("node", "text")
    sets = stash.put(shingle_sets(sets, n), "sets")

    tested = stash.put(ordered(first), "tested")
    links = stash.put(confirmed(tested, sets, percent), "links")
    for step in ("stars", "nearest", "all"):
        labels = labels_of(links)
        found = ordered(star) if step == "stars" else open_pairs(members, labels, percent, most, step == "nearest", stash)
        at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        apart = found.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")) if step == "stars" else found
        rest = stash.put(apart.select("a", "b").join(tested, ["a", "b"], "left_anti"), "rest")
        tested, links = tested.union(rest), stash.put(links.union(confirmed(rest, sets, percent)), "links")

    roots = components(links, stash)
    joined = each.select("node", "digest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = stash.put(joined.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = joined.join(names, "root").select("digest", "component_id")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERY = "op13_minhash"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least ON a = doc_id
"""
