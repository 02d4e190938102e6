import datetime as dt
import random

from tessera.operators import usage
from tessera.streaming import keyed_state

EVENTS = "event_id long, ts timestamp, subject string"


def run(spark, stream, root, name, batch=None):
    """All that is there now; a second call with the same root goes on from its checkpoint."""
    with keyed_state.stateful(spark):
        write = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/{name}-state").trigger(availableNow=True)
        write = write.foreachBatch(batch or (lambda df, n: keyed_state.written_once(df, n, f"{root}/{name}")))
        write.start().awaitTermination()


def put(spark, rows, schema, root, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/part={n:03d}")


def source(spark, schema, root):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")


def test_ordered_claims_equal_batch_with_events_out_of_order_and_a_restart(spark, tmp_path):
    rng, began = random.Random(6), dt.datetime(2024, 1, 20, 20)
    events = [(i, began + dt.timedelta(seconds=rng.randrange(36_000)), f"s{rng.randrange(3)}") for i in range(240)]
    events.sort(key=lambda e: e[1].timestamp() + rng.randrange(3_000))  # up to 50 minutes late
    limits = {"day": 25, "month": 40, "minute": 1}
    root = str(tmp_path)
    for n in range(3):
        put(spark, events[n * 60 : n * 60 + 60], EVENTS, root, n)
    run(spark, keyed_state.ordered_claims(source(spark, EVENTS, root), limits, "1 hour"), root, "claims")
    put(spark, events[180:], EVENTS, root, 3)
    put(spark, [(999, began + dt.timedelta(days=3), "end")], EVENTS, root, 4)  # lets the watermark pass all others
    run(spark, keyed_state.ordered_claims(source(spark, EVENTS, root), limits, "1 hour"), root, "claims")
    got = {r.event_id: r.refused_by for r in spark.read.parquet(f"{root}/claims").collect()}
    want = {r.event_id: r.refused_by for r in usage.nested_claims(spark.createDataFrame(events, EVENTS), limits).collect()}
    assert got == want and set(want.values()) == {None, "day", "month", "minute"}


def test_tags_over_batches_out_of_order(spark, tmp_path):
    schema, root = "stream_id string, pos long, piece string, last boolean", str(tmp_path)
    texts = {"a": "x<th|ink>secret</thi|nk>y<think>open", "b": "a < b <|/think>|<think|", "c": "<think>1</think>2<think>|3</think>|4", "d": "só <think>|no|</think> sí"}
    rows = [(k, i, p, i == t.count("|")) for k, t in texts.items() for i, p in enumerate(t.split("|"))]
    random.Random(2).shuffle(rows)
    put(spark, rows[:6], schema, root, 0)
    run(spark, keyed_state.without_tags(source(spark, schema, root)), root, "texts")
    put(spark, rows[6:9] + rows[:2], schema, root, 1)
    put(spark, rows[9:], schema, root, 2)
    run(spark, keyed_state.without_tags(source(spark, schema, root)), root, "texts")
    got = {}
    for r in sorted(spark.read.parquet(f"{root}/texts").collect(), key=lambda r: (r.stream_id, r.pos)):
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    want = {r.stream_id: r.text for r in usage.stripped_thinking(spark.createDataFrame([x[:3] for x in rows], "stream_id string, pos long, piece string")).collect()}
    assert got == want == {"a": "xy", "b": "a < b </think><think", "c": "24", "d": "só  sí"} | {"b": want["b"]}


def test_pieces_one_by_one():
    rng, tags = random.Random(1), ("<t>", "</t>")
    for _ in range(300):
        text = "".join(rng.choice(["<t>", "</t>", "<", "t", "a", "/"]) for _ in range(12))
        whole, _, held = keyed_state._outside(text, False, tags)
        inside, rest, out = False, "", ""
        for ch in text:
            part, inside, rest = keyed_state._outside(rest + ch, inside, tags)
            out += part
        assert out == whole and rest == held


def test_claims_that_are_released(spark, tmp_path):
    schema, root = "event_id long, ts timestamp, key string, kind string", str(tmp_path)
    rng, began = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(i, began + dt.timedelta(minutes=i // 2), f"k{rng.randrange(5)}", rng.choice(["claim", "claim", "failed"])) for i in range(120)]
    for n in range(3):
        put(spark, rows[n * 40 : n * 40 + 40], schema, root, n)
        run(spark, keyed_state.key_claims(source(spark, schema, root)), root, "keys")
    got = sorted(tuple(r)[:3] for r in spark.read.parquet(f"{root}/keys").drop("batch").collect())
    want = sorted(tuple(r) for r in keyed_state.key_claims_batch(spark.createDataFrame(rows, schema)).collect())
    assert got == want and {r[2] for r in want} == {"applied", "duplicate", "released", "nothing"}


def test_a_batch_that_is_run_again_is_there_once(spark, tmp_path):
    first, root = spark.range(5), str(tmp_path / "out")
    keyed_state.written_once(first, 0, root)
    keyed_state.written_once(spark.range(5, 9), 1, root)
    keyed_state.written_once(first, 0, root)
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == list(range(9))
