"""Periodic run detection: stretches of words that repeat with a period, found by counting matches at each lag.

A run is a stretch of words whose smallest period is q, at least `least` words and `copies` periods long, that no neighbouring
word extends. Such a run has at least max(least - q, (copies - 1) * q) pairs of equal words q apart, so the pairs at each lag are
counted first, exactly: the words that are frequent in a text by the autocorrelation of their positions (FFT of an indicator,
rounded; below 2^40 positions the rounding is exact), the rare ones by the differences of their positions. "Frequent" is more than
sqrt(2 n) occurrences in n words, of which there are at most sqrt(n / 2), so that a text of one word alone and a text of many words
both stay near n^1.5 steps. Only lags with enough pairs get a scan for islands of equal words.

A run of period p is an island at each multiple of p too; an island at lag q is dropped if q / r is a period of it for some prime
divisor r of q, which (an island being over two periods long) is so exactly if its smallest period is less than q.

Each text is worked on by itself, so nothing is shuffled and a lost executor costs its own batches only; memory is bounded by
about one MB of texts, or one text.

Cases: null or blank text has no words, no runs and an empty collapsed text; texts under `least` words have no runs; a null id
is a row like others (op12 changes no words of it); repeated rows are judged each for itself; very long texts are read
whole; an empty table gives no rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, slices

_PAIRS = 1 << 21  # pairs of rare words counted at once
_FFT_CELLS = 1 << 20  # cells of indicators transformed at once
Change = Callable[[object, int], np.ndarray | None]


def _rare_pairs(place: np.ndarray, end: np.ndarray, reach: np.ndarray, base: np.ndarray, counts: np.ndarray) -> None:
    """Add the differences up to `reach` between positions of one word of one text. place is sorted within a word; end is the index
    behind the word's last position; base is where the lags of its text begin in counts."""
    now, step, held, n_held = np.arange(len(place)), 0, [], 0
    while len(now):
        step += 1
        now = now[now + step < end[now]]
        apart = place[now + step] - place[now]
        near = apart <= reach[now]  # the next position of a word is farther still
        now, apart = now[near], apart[near]
        held.append(base[now] + apart)
        n_held += len(now)
        if n_held > _PAIRS or not len(now):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n_held = [], 0


def _frequent_pairs(places: list[np.ndarray], n: int, reach: int) -> np.ndarray:
    """Pairs at the lags 0 to reach of words with these positions in one text of n words."""
    size = 1 << (n + reach).bit_length()
    power, rows = np.zeros(size // 2 + 1), max(1, _FFT_CELLS // size)
    for k in range(0, len(places), rows):
        seen = np.zeros((len(places[k : k + rows]), size))
        for row, place in zip(seen, places[k : k + rows]):
            row[place] = 1
        spectrum = np.fft.rfft(seen, axis=1)
        power += (spectrum.real**2 + spectrum.imag**2).sum(0)
    return np.rint(np.fft.irfft(power, size)[: reach + 1]).astype(np.int64)


def lag_counts(word: np.ndarray, at: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words at each lag 0 to n // copies of each text (lag 0 is left at zero): counts, and where each text's lags begin. word: ids of
    the words of all texts; at: where the texts begin, and the end."""
    n = np.diff(at)
    base = np.concatenate(([0], np.cumsum(n // copies + 1)))
    counts = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((word, text)) if len(word) else np.zeros(0, np.int64)  # stable: positions ascend within a word
    first = np.flatnonzero(np.concatenate(([True], (np.diff(word[order]) != 0) | (np.diff(text[order]) != 0)))) if len(word) else order
    size = np.diff(np.concatenate((first, [len(order)])))
    text_of = text[order[first]]
    often = size * size > 2 * n[text_of]
    rare = np.repeat(~often & (size > 1), size)
    of, ends = np.repeat(text_of, size)[rare], np.cumsum(np.where(~often & (size > 1), size, 0))
    _rare_pairs((order[rare] - at[of]), np.repeat(ends[~often & (size > 1)], size[~often & (size > 1)]), (n // copies)[of], base[of], counts)
    frequent = np.flatnonzero(often & (n[text_of] >= copies))
    for group in np.split(frequent, np.flatnonzero(np.diff(text_of[frequent])) + 1) if len(frequent) else []:
        t = text_of[group[0]]
        found = _frequent_pairs([order[first[g] : first[g] + size[g]] - at[t] for g in group], int(n[t]), int(n[t] // copies))
        counts[base[t] : base[t + 1]] += found
    counts[base[:-1]] = 0
    return counts, base


def _prime_divisors(q: int) -> list[int]:
    found, r = [], 2
    while r * r <= q:
        if q % r == 0:
            found.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return [*found, *([q] if q > 1 else [])]


def islands(word: np.ndarray, q: int, least: int, copies: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period q) of one text."""
    equal = np.concatenate(([False], word[:-q] == word[q:], [False]))
    edge = np.flatnonzero(equal[1:] != equal[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2] + q
    long = length >= max(least, copies * q)
    primes = _prime_divisors(q)

    def shorter(s: int, m: int) -> bool:
        return any(np.array_equal(word[s : s + m - q // r], word[s + q // r : s + m]) for r in primes)

    return [(s, m, q) for s, m in zip(start[long].tolist(), length[long].tolist()) if not shorter(s, m)]


def runs_of(word: np.ndarray, at: np.ndarray, least: int, copies: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period."""
    counts, base = lag_counts(word, at, copies)
    text = np.repeat(np.arange(len(at) - 1), np.diff(base))
    lag = np.arange(len(counts)) - base[:-1][text]
    enough = np.flatnonzero((lag > 0) & (counts >= np.maximum(least - lag, (copies - 1) * lag)) & (counts > 0))
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    for t, q in zip(text[enough].tolist(), lag[enough].tolist()):
        found[t] += islands(word[at[t] : at[t + 1]], q, least, copies)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, copies: int = 4, change: Change | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed: the text's words without those that a run
    has after its first period, joined by one space. change(id, n words) may give other indices to read the words by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, end, raw, at in slices(b.column(1)):
                whole = raw.tobytes()
                texts = [whole[at[k] : at[k + 1]].split() for k in range(end - first)]  # bytes split at 0x20 and 0x09-0x0D
                word = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum([0, *map(len, texts)])
                for k, t in enumerate(texts):
                    if change is not None and (index := change(ids[first + k], len(t))) is not None:
                        word[starts[k] : starts[k + 1]] = word[starts[k] + index]
                        texts[k] = [t[i] for i in index.tolist()]
                found = runs_of(word, starts, least, copies)
                left = []
                for t, runs in zip(texts, found):
                    keep = np.ones(len(t), bool)
                    for s, m, q in runs:
                        keep[s + q : s + m] = False
                    left.append(b" ".join(t[i] for i in np.flatnonzero(keep).tolist()) if runs else b" ".join(t))
                flat = np.array([x for runs in found for x in runs], np.int64).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                columns = [b.column(0).slice(first, end - first), pa.array(np.diff(starts), pa.int64()), pa.ListArray.from_arrays(offsets, parts), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = "array<struct<start:long,length:long,period:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {kind}, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The repetition that op12 puts into a tenth of the documents: indices of the words to read instead, or None."""
    g, tenth = divmod(crc32(str(doc_id).encode()), 10)
    if doc_id is None or tenth or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


QUERY = "op12_periodic_runs"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read_table(spark, sf_dir, "documents"), change=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(each, "\n"), F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("best.col2"), F.col("best.length"), -F.col("best.col3"))
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE_SQL = None
