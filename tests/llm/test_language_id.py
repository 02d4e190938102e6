import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common, language_id

DATA = "/root/testdata/sf0.01"


def test_trigrams_stay_within_texts():
    model = np.log(np.random.default_rng(0).random((2, 1 << 16)))
    texts = ["Abc déf", "", "ab", "xyzxyz"]
    both, n = language_id.log_likelihoods(pa.array(texts), model)
    alone = np.concatenate([language_id.log_likelihoods(pa.array([t]), model)[0] for t in texts])
    assert n.tolist() == [6, 0, 0, 4]
    assert np.allclose(both, alone) and (both[1] == 0).all() and (both[2] == 0).all() and (both[3] < 0).all()


def test_held_out_documents(spark):
    """Trained on one half, judged on the other; neither declarations nor labels of that half are seen."""
    docs = common.read_table(spark, DATA, "documents")
    half = docs.filter("doc_id % 2 = 0")
    held = docs.filter("doc_id % 2 = 1 AND lang IS NOT NULL AND length(text) > 20")
    gold = {r.doc_id: r.lang for r in held.collect()}
    rows = language_id.document_rows(held)
    assert rows.filter("declared IS NOT NULL").count() == 0
    got = language_id.language_id(rows, half).collect()
    assert len(got) > 400 and sum(r.lang == gold[r["key"].doc_id] for r in got) >= 0.98 * len(got)


def test_held_out_pages_by_their_text_alone(spark):
    """The declaration that the page makes is kept back and is what the answer is compared with."""
    docs, pages = (common.read_table(spark, DATA, n) for n in ("documents", "pages"))
    said = {r.page_id: r.lang for r in pages.select("page_id", F.regexp_extract("html", language_id._LANG, 1).alias("lang")).collect()}
    silent = language_id.page_rows(pages.withColumn("html", F.regexp_replace("html", "(?i)<html[^>]*>", "<html>")))
    got = [r for r in language_id.language_id(silent, docs).collect() if said[r["key"].page_id]]
    assert len(got) > 100 and all(r.declared is None for r in got)
    assert sum(r.lang == said[r["key"].page_id] for r in got) >= 0.95 * len(got)


def test_a_language_without_model_is_und(spark):
    docs = common.read_table(spark, DATA, "documents").filter("length(text) > 100 AND text IS NOT NULL")
    rows = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 3, None, "s"), (2, "zqx jvk wqz xkj qqz vvx " * 9, None, "s")], "doc_id long, text string, lang string, source string")
    got = {r["key"].doc_id: r.lang for r in language_id.language_id(language_id.document_rows(rows.union(docs.limit(50).select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1000))), docs).collect()}
    assert got[1] == got[2] == "und" and sum(v == "und" for v in got.values()) <= 3


def test_training_does_not_depend_on_order(spark):
    rows = [(i % 40, f"word{i % 7} some text {i}", ["aa", "bb"][i % 2], "s") for i in range(200)] + [(1000, "long " * 400_000, "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, other = language_id.train(docs, 15), language_id.train(docs.orderBy(F.rand(3)), 15)
    assert one[0] == other[0] and np.array_equal(one[1], other[1])
    ids = {(r.lang, r.doc_id) for r in language_id.sample(docs, 15).collect()}
    assert len(ids) == 30 and {k for k, _ in ids} == {"aa", "bb"}


def test_fusion_matches_the_formula(spark):
    """Every sum again, row by row, in plain Python."""
    rng = np.random.default_rng(2)
    known, rows = ["de", "en"], []
    hosts = ["a.x.de", "b.x.de", "y.com", "", None]
    for i in range(40):
        rows.append((i, hosts[i % 5], [None, "de", "en"][i % 3], [float(x) for x in rng.normal(-3, 1.0, 2)]))
    df = spark.createDataFrame(rows, "key long, host string, declared string, logs array<double>")
    got = {r.key: r for r in language_id.fused(df, known, common.Stash(spark)).collect()}

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def levels(h):
        if h is None:
            return (None, None, None)
        parts = h.split(".")
        return h, ".".join(parts[-2:]), parts[-1]

    p = {r[0]: soft(r[3]) for r in rows}
    total = lambda f: [sum(p[r[0]][k] for r in rows if f(r)) for k in (0, 1)]
    for key, host, said, logs in rows:
        own = p[key]
        left = lambda s: [max(a - b, 0.0) for a, b in zip(s, own)]
        prior = [0.5, 0.5]
        sets = [lambda r: True] + [lambda r, k=k: levels(r[1])[k] == levels(host)[k] for k in (2, 1, 0)]
        for f in sets:
            s = left(total(f))
            prior = [(a + 5 * b) / (sum(s) + 5) for a, b in zip(s, prior)]
        alike = [0.0, 0.0]
        if said:
            s, t = left(total(lambda r: r[2] == said)), left(total(lambda r: r[2] is not None))
            alike = [math.log((a + 1) / (b + 3)) for a, b in zip(s, t)]
        post = soft([a + math.log(b) + c for a, b, c in zip(logs, prior, alike)])
        if host is not None:  # a null host meets no other and is left to its text
            assert abs(got[key].probability - max(post)) < 1e-5
            assert got[key].lang == known[post.index(max(post))]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "en", "s")], "doc_id long, text string, lang string, source string")
    assert language_id.language_id(language_id.document_rows(docs), docs).count() == 2
    assert language_id.language_id(language_id.document_rows(docs.limit(0)), docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "no address", "<html lang=FR-ca><p>x")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "the and of with", "en", "s"), (2, "les des une et", "fr", "s")], "doc_id long, text string, lang string, source string")
    got = {r["key"].page_id: r.declared for r in language_id.language_id(language_id.page_rows(pages), docs).collect()}
    assert got == {1: None, 2: "fr"}


def test_every_labelled_language_is_fitted(spark):
    names = ["fil", "fi", *(chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(70))]
    docs = spark.createDataFrame([(i, f"word{k} {k}{k} " * 5, k, "s") for i, k in enumerate(names)], "doc_id long, text string, lang string, source string").coalesce(1)
    known, model, _ = language_id.train(docs)
    assert known == sorted(names) and model.shape == (72, 1 << 16)
    pages = spark.createDataFrame([(1, "http://a.b", "<html lang='fil-PH'>x")], "page_id long, url string, html string")
    assert language_id.evidence(language_id.page_rows(pages), model, np.zeros(72)).first().declared == "fil"
