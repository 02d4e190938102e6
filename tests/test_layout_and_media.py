import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import media as M
from tessera.operators import billing, layout


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


SPAN = "doc_id string, page int, pos long, text string, x double, y double, width double, height double, font_size double, font_name string, bold boolean, field boolean"


def span(pos, text, x, y, size=11.0, page=1):
    return ("d", page, pos, text, float(x), float(y), len(text) * size * 0.5, size, size, "f", False, False)


def test_a_page_with_everything(spark):
    rows = [span(0, "Annual report", 60, 780, 24.0), span(1, "Findings", 60, 740, 16.0), span(2, "Growth was inter-", 60, 700), span(3, "national this year.", 60, 686), span(4, "• first point", 60, 650), span(5, "• second point", 60, 636), span(6, "  ", 60, 620)]
    for r in range(4):
        rows += [span(10 + r * 3 + c, t, x, 590 - r * 16) for c, (t, x) in enumerate([(f"name{r}", 60), (f"q{r}", 240), (f"{r}00", 400)])]
    df = spark.createDataFrame(rows, SPAN)
    lines = layout.lines(df)
    assert lines.count() == 10
    assert layout.body_sizes(lines).first().body == 11.0
    got = layout.blocks(lines).orderBy("block_no").collect()
    assert [(b.type, b.level) for b in got] == [("heading", 1), ("heading", 2), ("paragraph", None), ("list", None), ("table", None)]
    assert got[2].text == "Growth was international this year." and got[3]["items"] == ["first point", "second point"]
    assert [list(r) for r in got[4]["rows"]] == [[f"name{r}", f"q{r}", f"{r}00"] for r in range(4)]
    assert layout.widest_gap(df.filter("pos >= 10")).first().x < 240


def test_rows_anchor_on_their_first_span():
    rows = layout.rows_of([{"x": 0, "y": y, "pos": i, "font_size": 10} for i, y in enumerate([100, 96, 92, 88])])
    assert [[s["y"] for s in r] for r in rows] == [[100, 96], [92, 88]]
    assert layout.upper_median([1, 2, 3, 4]) == 3 and layout.upper_median([]) == 12
    assert layout.direction("שלום") == 4 and layout.direction("abc") == -3
    assert layout.join_lines(["Anglo-", "Saxon", "inter-", "national"]) == "Anglo- Saxon international"


def test_first_box(spark):
    words = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 100.0, 100.0), (1, 2, 500.0, 5.0)], "page int, word_no int, cx double, cy double")
    boxes = spark.createDataFrame([(1, 5, 0.0, 0.0, 300.0, 300.0), (1, 3, 90.0, 90.0, 110.0, 110.0)], "page int, box_no int, x double, y double, right double, bottom double")
    assert {r.word_no: r.box_no for r in layout.first_box(words, boxes).collect()} == {0: 5, 1: 3, 2: None}


def test_billing_fold(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    log = [
        ("u", "k2", "not_renew", t(2), None, "S1", None, None), ("u", "k1", "create", t(3), "pro", "S1", t(20), None), ("u", "k1", "create", t(3), "pro", "S1", t(20), None), ("u", "k4", "create", t(5), "pro", "S1", t(9), None),
        ("v", "k5", "create", t(1), "team", "S2", t(10), None), ("v", "k6", "charge", t(10), None, "S2", t(28), None), ("v", "k7", "failed", t(11), None, "S2", None, None),
        ("w", "k8", "prepay", dt.datetime(2024, 1, 31, 5), "pro", None, None, 1), ("w", "k9", "prepay", dt.datetime(2024, 2, 1), "pro", None, None, 1),
    ]
    df = spark.createDataFrame(log, "user_id string, key string, type string, event_ts timestamp, plan string, code string, period_end timestamp, months int")
    got = {r.user_id: r for r in billing.settled(df).collect()}
    assert (got["u"].subscription_status, got["u"].current_period_end) == ("non-renewing", t(20))
    assert (got["v"].subscription_status, got["v"].current_period_end) == ("attention", t(28))
    assert got["w"].paid_until == dt.datetime(2024, 3, 29, 5)
    grants = spark.createDataFrame([("u", t(1), "team", 10), ("u", t(2), "pro", 5), ("u", t(3), "team", 1)], "user_id string, redeemed_at timestamp, plan string, days int")
    r = billing.redeemed(grants, F.lit(t(9)).cast("timestamp")).first()
    assert (r.team_until, r.pro_until) == (t(12), t(16))
    seat = lambda email: one(spark, billing.seat_error(F.lit("team"), F.lit("Me@x.y"), F.array(F.lit("a@x.y")), F.lit(email).cast("string"), 2))
    assert [seat(e) for e in (None, "me@x.y", "a@x.y", "b@x.y")] == ["invalid", "self", "duplicate", None]


@pytest.mark.parametrize("ip, out", [("1.2.3.4:80", "1.2.3.4"), ("::ffff:1.2.3.4", "1.2.3.4"), ("[2001:0db8::1]:443", "2001:db8:0:0::/64"), ("2001:db8:1:2:3:4:5:6%eth0", "2001:db8:1:2::/64"), ("x", "x")])
def test_addresses(spark, ip, out):
    assert one(spark, M.normal_ip(F.lit(ip))) == out


def test_media_functions(spark):
    assert one(spark, M.decamel(F.lit("KanyeWestVEVOMusic"))) == "Kanye West VEVO Music"
    assert one(spark, M.looks_garbled(F.lit("a\x01\x02"))) and not one(spark, M.looks_garbled(F.lit("plain")))
    assert one(spark, M.rtl_balance(F.lit("שלום ab"))) == 2
    assert [one(spark, M.file_kind(F.lit(n), F.lit(m))) for n, m in (("A.PDF", None), ("x", "image/png"), ("a.key", None), ("b.zip", None))] == ["pdf", "image", "legacy-slides", "other"]
    assert one(spark, M.file_from_disposition(F.lit("attachment; filename=\"a.txt\"; filename*=UTF-8''%C3%A9.txt"))) == "é.txt"
    assert [one(spark, M.number_label(F.lit(s), F.lit(n))) for s, n in (("alphaLcParenR", 28), ("romanUcPeriod", 1994), ("arabicParenBoth", 3), ("other", 4))] == ["ab)", "MCMXCIV.", "(3)", "4."]
    assert [one(spark, M.vbr_level(F.lit(k), F.lit(2), F.lit(False))) for k in (None, 64, 128)] == [2, 6, 3]
    assert one(spark, M.shortcode_id(F.lit("BAB"))) == str(64 * 64 + 1)
    assert one(spark, M.iso_seconds(F.lit('mediaPresentationDuration="PT1H2M3.5S"'))) == 3723.5
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    assert one(spark, M.retry_after_ms(F.lit(" 30 "), now)) == 30000
    assert one(spark, M.retry_after_ms(F.lit("Mon, 01 Jan 2024 00:00:05 GMT"), now)) == 5000
    assert one(spark, M.result_name(F.lit("a.pdf"), F.lit("extract"), F.array(F.lit(2), F.lit(3)))) == "a-pages-3-4.pdf"
    m = F.array(*(F.lit(float(x)) for x in (2, 0, 0, 2, 5, 6)))
    assert one(spark, M.compose(m, M.inverted(m))) == [1, 0, 0, 1, 0, 0]
    assert one(spark, M.placed(F.lit(100.0), F.lit(50.0), F.lit(200.0), F.lit(200.0), F.lit("fit"))).asDict() == {"x": 0.0, "y": 50.0, "scale": 2.0}
    assert one(spark, M.prefix_search(F.lit("mer pd"), F.lit("Merge PDF files")))
    assert one(spark, M.join_hyphens(F.lit("inter-\nnational\nAnglo-\nSaxon"))) == "international Anglo- Saxon"
    assert one(spark, M.safe_path(F.lit("u1/a.pdf"), F.lit("u1"))) and not one(spark, M.safe_path(F.lit("u1/../b"), F.lit("u1")))
    assert one(spark, M.first_match(F.lit("Video Unavailable"), [("private", "p"), ("unavailable", "u")], "x")) == "u"


def test_pages_are_read_one_after_the_other(spark, monkeypatch):
    """Pages that end within a batch or run over several are whole; letters are looked at one by one only where some run from right to left."""
    r = random.Random(2)
    texts = ["Total", "été 12", " 1,200 ", "שלום", "עולם 5", "3.5", "(a)", "x  y"]
    spans = [(d, p, k, r.choice(texts[:3] if d == "a" else texts), float(r.randrange(6) * 60), 700.0 - 12 * r.randrange(9), 30.0, 10.0, 10.0, "f", r.choice([None, True]), False) for d in "abc" for p in (1, 2, 3) for k in range(r.randrange(1, 40))]
    spans.append(("d", 1, 0, "  ", 0.0, 0.0, 1.0, 1.0, 1.0, "f", None, None))
    schema = "doc_id string, page int, pos int, text string, x double, y double, width double, height double, font_size double, font_name string, bold boolean, field boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    want = []
    for key in sorted({s[:2] for s in spans[:-1]}):
        rows = [dict(zip(names, s)) | {"bold": bool(s[10])} for s in spans if s[:2] == key]
        want += [(*key, k, x["text"], x["x"], x["right"], x["rtl"], [(c["text"], c["x"], c["right"]) for c in x["cells"]]) for k, x in enumerate(layout.lines_of(rows))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = layout.lines(spark.createDataFrame(spans, schema)).collect()
        assert sorted((g.doc_id, g.page, g.line_no, g.text, g.x, g.right, g.rtl, [tuple(c) for c in g.cells]) for g in got) == want
    monkeypatch.setattr(layout, "direction", None)
    plain = [{"text": t, "x": 60.0 * k, "y": 0.0, "pos": k, "width": 30.0, "font_size": 10.0, "bold": False, "field": False} for k, t in enumerate(["Größe", "12 ", "cm"])]
    assert [x["text"] for x in layout.lines_of(plain)] == ["Größe 12 cm"]
