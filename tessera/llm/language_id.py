"""Language identification by fusing evidence as probabilities.

For each row the posterior of a language is proportional to
  P(text | language): hashed byte trigrams, add-one smoothed; the sum of log likelihoods is divided by the trigram's length,
    as neighbouring trigrams share bytes;
  P(declared language | language): how often each language is declared so, estimated by grouped sums over all rows;
  P(language | host): grouped sums of text posteriors by host, smoothed towards its domain (the last two labels), that
    towards its suffix (the last label), that towards all rows; the row's own share is taken out first.
The trigram model is trained on at most `per_language` labelled documents of each labelled language, those of smallest
hashed id. All other sums cover all rows; hot hosts are summed before they are shuffled. A text whose trigrams are nearer to chance than to what
its best language gives to texts that it has not seen is in a language without a model and gets 'und', whatever its host.

The label that trains the model is no evidence: documents have neither address nor declaration, only their source as host.

Cases: null text or markup counts as empty and leaves the other evidence; a null or unreadable address has the empty host
and suffix, a missing declaration is no evidence; language codes are kept whole, without their region; without any labelled document, or with a
posterior under 0.5, the language is 'und'; rows with equal ids are judged each for itself, and of repeated ids of a language the text that sorts first is
trained on; very long texts are read whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.llm.common import Stash, read_table, slices

_BITS, _GRAM = 16, 3
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[: 0x41] = _FOLD[0x5B:0x61] = _FOLD[0x7B:0x80] = 32
_LANG = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})"


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte but a text's last two, and offsets."""
    b = _FOLD[raw]
    code = np.zeros(len(b), np.uint32)
    if len(b) > 2:
        code[:-2] = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    keep = np.ones(len(b), bool)
    for back in (1, 2):
        last = at[1:] - back
        keep[last[last >= at[:-1]]] = False
    with np.errstate(over="ignore"):
        bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
    return bucket[keep].astype(np.int64), np.concatenate(([0], np.cumsum(keep)))[at]


def log_likelihoods(column: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text by language, and the number of trigrams."""
    out, n = [np.zeros((0, len(model)))], [np.zeros(0, np.int64)]
    for _, _, raw, at in slices(column):
        bucket, cut = trigrams(raw, at)
        n.append(np.diff(cut))
        out.append(np.stack([np.diff(np.concatenate(([0.0], np.cumsum(m[bucket], dtype=np.float64)))[cut]) for m in model], 1) / _GRAM if len(model) else np.zeros((len(at) - 1, 0)))
    return np.concatenate(out), np.concatenate(n)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, doc_id and text of at most `per_language` documents of each language, those of smallest hashed id. Ids far beyond that place
    leave before any are ranked, so that no task ranks a whole language."""
    named = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    near = named.join(F.broadcast(counts), "lang").filter(place * F.col("n") <= 3 * per_language + 100).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id"))
    chosen = near.select("lang", "doc_id", rank.alias("rank")).filter(F.col("rank") <= per_language).drop("rank")
    return named.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def train(docs: DataFrame, per_language: int = 400) -> tuple[list[str], np.ndarray, np.ndarray]:
    """docs: doc_id, text, lang. Languages, their log probabilities by bucket, and the mean log probability under which a text is in none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for first, end, raw, at in slices(b.column(1)):
                bucket, cut = trigrams(raw, at)
                for k in range(end - first):
                    own = counts.setdefault(b.column(0)[first + k].as_py(), np.zeros(1 << _BITS, np.int64))
                    own += np.bincount(bucket[cut[k] : cut[k + 1]], minlength=1 << _BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    parts = sample(docs, per_language).select("lang", "text").repartition(4, "lang")  # one row of counts a language
    for r in parts.mapInArrow(run, "lang string, counts binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    known = sorted(total)
    if not known:
        return [], np.zeros((0, 1 << _BITS)), np.zeros(0)
    model = np.stack([np.log((total[k] + 1) / (total[k].sum() + (1 << _BITS))) for k in known])
    own = []  # what each trigram would get if the model had not seen it here
    for k in known:
        c = total[k][total[k] > 0]
        own.append((c * np.log(c / (c.sum() + (1 << _BITS) - 1))).sum() / c.sum() if len(c) else -_BITS * np.log(2))
    return known, model, (np.array(own) - _BITS * np.log(2)) / 2


def evidence(rows: DataFrame, model: np.ndarray, floor: np.ndarray) -> DataFrame:
    """rows (key, text, markup, host, declared) to key, host, declared, logs (the text's log likelihoods) and far (in none of the languages)."""
    held = rows.sparkSession.sparkContext.broadcast((model, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, floor = held.value
        for b in batches:
            logs, n = log_likelihoods(b.column(3), model)
            best = logs.argmax(1) if len(logs) else np.zeros(0, np.int64)
            far = (n > 0) & (logs.max(1, initial=-np.inf) * _GRAM < n * floor[best])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1, dtype=np.int32) * len(model)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists, pa.array(far)], ["key", "host", "declared", "logs", "far"])

    marked = F.lower(F.nullif(F.regexp_extract("markup", _LANG, 1), F.lit("")))
    seen = F.when(F.col("markup").isNotNull(), text.html_text(F.col("markup"))).otherwise(F.col("text"))
    flat = rows.select("key", "host", F.coalesce("declared", marked).alias("declared"), F.coalesce(seen, F.lit("")).alias("text"))
    return flat.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, host string, declared string, logs array<double>, far boolean")


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def fused(found: DataFrame, known: list[str], stash: Stash, strength: float = 5.0) -> DataFrame:
    """found (key, host, declared, logs and, if known, far): key, lang, probability, text_lang, declared."""
    n = len(known)
    found = found if "far" in found.columns else found.withColumn("far", F.lit(False))
    names = F.array(*(F.lit(k) for k in known))
    label = F.split(F.col("host"), r"\.")
    suffix = F.element_at(label, -1)
    domain = F.when(F.size(label) > 1, F.concat_ws(".", F.element_at(label, -2), suffix)).otherwise(suffix)
    rows = stash.put(found.select("key", "host", "declared", "logs", "far", _softmax(F.col("logs")).alias("p")).select("*", domain.alias("domain"), suffix.alias("suffix")), "text")
    sums = [F.sum(F.when(F.col("far"), 0.0).otherwise(F.col("p")[k])).alias(f"s{k}") for k in range(n)]  # a far text tells nothing of its host
    vector = F.array(*(F.col(f"s{k}") for k in range(n)))
    hosts = rows.groupBy("host", "domain", "suffix").agg(*sums).select("host", "domain", "suffix", vector.alias("hs"))
    up = [F.sum(F.col("hs")[k]).alias(f"s{k}") for k in range(n)]
    hosts = stash.put(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(*up).select("domain", vector.alias("ds"))
    suffixes = hosts.groupBy("suffix").agg(*up).select("suffix", vector.alias("ss"))
    overall = hosts.agg(*up).first()
    everything = F.array(*(F.lit(float(overall[k] or 0.0)) for k in range(n)))
    priors = stash.put(hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "hs", "ds", "ss"), "priors")

    said = rows.filter("declared IS NOT NULL").groupBy("declared").agg(*sums).select("declared", vector.alias("cs"))
    said = stash.put(said, "said")
    total = said.agg(*(F.sum(F.col("cs")[k]).alias(f"s{k}") for k in range(n)), F.count("*").alias("kinds")).first()
    kinds = float(total["kinds"] or 0) + 1.0
    totals = F.array(*(F.lit(float(total[k] or 0.0)) for k in range(n)))

    def smooth(own: Column, base: Column) -> Column:
        left = F.when(F.col("far"), own).otherwise(F.zip_with(own, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0))))
        size = F.aggregate(left, F.lit(0.0), lambda a, v: a + v)
        return F.zip_with(left, base, lambda a, b: (a + strength * b) / (size + strength))

    joined = rows.join(priors, rows["host"].eqNullSafe(priors["host"]), "left").drop(priors["host"]).join(said, "declared", "left")
    flat = F.transform(names, lambda _: F.lit(1.0 / n))
    staged = joined.withColumn("g", smooth(everything, flat))
    for own, base, out in (("ss", "g", "u"), ("ds", "u", "d"), ("hs", "d", "prior")):
        staged = staged.withColumn(out, smooth(F.col(own), F.col(base)))
    alike = F.when(F.col("cs").isNull(), F.transform(names, lambda _: F.lit(0.0))).otherwise(
        F.zip_with(F.zip_with("cs", "p", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with(totals, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, t: F.log((a + 1.0) / (t + kinds)))
    )
    both = F.zip_with(F.zip_with("logs", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b), alike, lambda a, b: a + b)
    scored = staged.select("key", "declared", "p", "far", _softmax(both).alias("post"))
    best = lambda c: names[(F.array_position(c, F.array_max(c)) - 1).cast("int")]
    return scored.select("key", F.when(~F.col("far") & (F.array_max("post") >= 0.5), best(F.col("post"))).otherwise("und").alias("lang"), F.round(F.array_max("post"), 6).alias("probability"), best(F.col("p")).alias("text_lang"), "declared")


def language_id(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (key struct, text, markup, host, declared); docs (doc_id, text, lang) to train on."""
    known, model, floor = train(docs)
    if not known:
        return rows.select("key", F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_lang"), "declared")
    stash = Stash(rows.sparkSession)
    return fused(evidence(rows, model, floor), known, stash)


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select(F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id")).alias("key"), F.lit("").alias("text"), F.col("html").alias("markup"), host.alias("host"), F.lit(None).cast("string").alias("declared"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents have no address and declare nothing: their source stands for the host."""
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id")).alias("key"), F.col("text"), F.lit(None).cast("string").alias("markup"), F.coalesce("source", F.lit("")).alias("host"), F.lit(None).cast("string").alias("declared"))


QUERY = "op7_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = page_rows(read_table(spark, sf_dir, "pages")).union(document_rows(docs))
    return language_id(rows, docs).select("key.doc_id", "key.page_id", "lang", "probability", "text_lang", "declared")


ORACLE_SQL = None
