"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest length, and pieces are dealt to shards by a hash of the row, about
`shard_rows` to a shard, so that no shard grows with the input and no key gathers in one. Each shard is packed on its own,
longest piece first, each into the open bin with the least room that takes it. When none does, a bin is opened. All
permitted lengths that take the piece are weighed against each other: for each, the pieces that are still to come
fill its room (the longest that fits, again and again), and the length is opened whose bin, downsized to the shortest
permitted length that holds that filling, costs least for each unit it holds (the shorter one on ties). At the end every bin is downsized to
its contents. A bin of length c costs `per_bin` + c + `quadratic` * c^2.

Cases: a null or negative length counts as 0; pieces of length 0 are packed like others and take no room; a document longer
than the largest length is cut into full pieces and a rest; rows with equal ids are packed each for itself; null ids are
packed too; ids are BIGINT or cast to it; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash, read_table

CAPACITIES = (2048, 4096, 8192, 16384, 32768)


def least_cost(need: int, coming: list[int], capacities: tuple[int, ...], cost: dict[int, float]) -> int:
    """The length to open for a piece of `need`. coming: the lengths still to come, negated and ascending."""
    best, chosen = math.inf, capacities[-1]
    for c in capacities:
        if c < need:
            continue
        room, k = c - need, 0
        while room and k < len(coming):
            k = bisect.bisect_left(coming, -room, k)
            if k < len(coming):
                if not coming[k]:
                    break
                room += coming[k]
                k += 1
        used = c - room
        each = cost[next(x for x in capacities if x >= used)] / max(used, 1)
        if each < best * (1 - 1e-12):
            best, chosen = each, c
    return chosen


def pack(lengths: np.ndarray, capacities: tuple[int, ...], per_bin: float, quadratic: float, ahead: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, bins' contents and bins' final lengths. An opening weighs the next `ahead` pieces of those that come
    at regular distances among all that still come, so that it costs the same in every shard."""
    order = np.argsort(-lengths, kind="stable")
    falling = (-lengths[order]).tolist()
    cost = {c: per_bin + c + quadratic * c * c for c in capacities}
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}  # by room, the open bins that have it
    rooms: list[int] = []
    used: list[int] = []
    for at, i in enumerate(order.tolist()):
        need = int(lengths[i])
        k = bisect.bisect_left(rooms, need)
        if k < len(rooms):
            have = rooms[k]
            own = room[have].pop()
            if not room[have]:
                del rooms[k], room[have]
        else:
            step = max(1, (len(falling) - at - 1) // ahead)
            own, have = len(used), least_cost(need, falling[at + 1 :: step], capacities, cost)
            used.append(0)
        where[i], offset[i] = own, used[own]
        used[own] += need
        have -= need
        if have not in room:
            room[have] = []
            bisect.insort(rooms, have)
        room[have].append(own)
    contents, sizes = np.array(used, np.int64), np.array(capacities, np.int64)
    return where, offset, contents, sizes[np.searchsorted(sizes, contents)]


def best_fit_packing(rows: DataFrame, length: str = "n_tokens", id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, per_bin: float = 16.0, quadratic: float = 0.0, shard_rows: int = 50_000, tokens: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start (in its document), length, bin_id, bin_offset, capacity, bin_used; with `tokens`,
    a BINARY column of one byte a token, also content, the tokens of the piece."""
    capacities, most = tuple(sorted(set(capacities))), max(capacities)
    stash = Stash(rows.sparkSession)
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / most) - 1))
    content = F.lit(None).cast("binary") if tokens is None else F.col(tokens)
    pieces = stash.put(
        rows.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), content.alias("content"), F.monotonically_increasing_id().alias("row_no"))
        .select("doc_id", "n", "row_no", "content", F.explode(cut).alias("piece"))
        .select("doc_id", "row_no", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("length"), F.substring("content", (F.col("piece") * most + 1).cast("int"), F.lit(most)).alias("content")),
        "pieces",
    )
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.drop("content").withColumn("shard", F.pmod(F.xxhash64("row_no", "piece"), F.lit(shards)).cast("int"))

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        table = table.sort_by([("row_no", "ascending"), ("piece", "ascending")])  # the same packing if a task runs again
        where, offset, used, final = pack(table.column("length").to_numpy(), capacities, per_bin, quadratic)
        names = ["doc_id", "piece", "start", "length", "row_no"]
        more = {"bin_id": where + (key[0].as_py() << 32), "bin_offset": offset, "capacity": final[where], "bin_used": used[where]}
        return pa.table({k: table.column(k) for k in names} | {k: pa.array(v) for k, v in more.items()})

    packed = dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start long, length long, row_no long, bin_id long, bin_offset long, capacity long, bin_used long")
    return packed.drop("row_no") if tokens is None else packed.join(pieces.select("row_no", "piece", "content"), ["row_no", "piece"]).drop("row_no")


def bins(packed: DataFrame) -> DataFrame:
    """One row for each bin: bin_id, capacity, used, its pieces in order with the ids of their documents, and if packed has it the
    content of the sequence."""
    piece, more = F.struct("bin_offset", "doc_id", "piece", "start", "length"), []
    if "content" in packed.columns:
        piece = F.struct("bin_offset", "doc_id", "piece", "start", "length", "content")
        more = [F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["content"])), "")).alias("content")]
    made = packed.groupBy("bin_id", "capacity").agg(F.max("bin_used").alias("used"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    listed = F.transform("pieces", lambda p: F.struct(*(p[c].alias(c) for c in ("bin_offset", "doc_id", "piece", "start", "length"))))
    return made.select("bin_id", "capacity", "used", F.col("pieces.doc_id").alias("doc_ids"), listed.alias("pieces"), *more)


def byte_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with tokens, the bytes of the text in UTF-8 and the end mark 0xFF (no byte of UTF-8), and n_tokens, their number."""
    raw = F.concat(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.lit(bytearray(b"\xff")))
    return docs.withColumn("tokens", raw).withColumn("n_tokens", F.octet_length("tokens").cast("long"))


def byte_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, the tokens of a byte-level model: UTF-8 bytes and one end mark."""
    return docs.withColumn("n_tokens", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1)


QUERY = "op2_best_fit_packing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(byte_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE_SQL = None
