import random

import corpus_pipeline
from tessera.llm import common, simhash
from tests.llm.test_decontaminate import _edits, _norm
from tests.llm.test_exact_and_simhash import _linked_pairs, _roots
from tests.llm.test_lines_and_packing import _brute as lines_brute

DATA = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = common.read_table(spark, DATA, "documents")
    stash, seen = common.Stash(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stash.put(stage(spark, docs, DATA), name.replace(" ", "-"))
        assert after.schema == docs.schema
        seen[name] = (docs.count(), after.count())
        if name != "line dedup":
            assert after.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        docs = after
    assert seen["line dedup"][0] == seen["line dedup"][1]
    assert seen["simhash near-dedup"][1] < seen["simhash near-dedup"][0]
    assert docs.selectExpr("count(DISTINCT text) = count(*)").first()[0]
    bench = [r.text for r in common.read_table(spark, DATA, "benchmark").collect()]
    assert not any(b in r.text for r in docs.collect() for b in bench)
    packed = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    assert sorted(i for r in packed for i in set(r.doc_ids)) and {i for r in packed for i in r.doc_ids} == {r.doc_id for r in docs.collect()}


def test_run_on_rows_of_every_odd_kind(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b\nc d\ne", None, "s", 9), (3, "a b\nc d\nf", "de", None, 9), (4, "x " * 5000, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {i for r in got for i in r.doc_ids} >= {2, 3, 4}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, and each decision again in plain Python."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(3)]
    boiler = "\n".join(" ".join(word() for _ in range(6)) for _ in range(3))
    base = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(5)) for _ in range(40)]
    texts = [*base, *(f"{base[k]}\n{boiler}\n{word()}" for k in range(8)), *(base[k + 10].replace(" ", " new ", 1) for k in range(6)), *(f"{word()} {passages[k % 3].upper()} {word()}" for k in range(5)), base[3], "", None]
    texts += [f"{word()} you idiot moron {word()} trash {k}" for k in range(30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    toxic = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts) if i % 3 or "idiot" in (t or "")]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = common.read_table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.Stash(spark).put(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i: t for i, t in enumerate(texts) if "idiot" not in (t or "")}
    assert kept["toxicity"] == clean
    assert kept["line dedup"] == {i: x for (i, _), x in lines_brute(list(clean.items()), 2).items()}
    lined = sorted(kept["line dedup"].items())
    lists = [simhash.shingle_hashes(t, 5).tolist() for _, t in lined]
    roots = _roots(len(lined), _linked_pairs(lists))
    assert kept["simhash near-dedup"] == {i: t for k, (i, t) in enumerate(lined) if roots[k] == k}
    found = {i for i, t in kept["simhash near-dedup"].items() if any(_edits(_norm(p), _norm(t)) <= min(len(_norm(p)) // 10, (len(_norm(p)) - 8) // 8) for p in passages)}
    assert found and kept["benchmark decontamination"] == {i: t for i, t in kept["simhash near-dedup"].items() if i not in found}
    bins = corpus_pipeline.packing_stage(spark, docs, "").collect()
    content = {p.doc_id: bytes(r.content[p.bin_offset : p.bin_offset + p.length]) for r in bins for p in r.pieces}
    assert content == {i: (t or "").encode() + b"\xff" for i, t in kept["benchmark decontamination"].items()}
