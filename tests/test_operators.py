import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import text as T
from tessera.functions import titles
from tessera.operators import documents, graph, lists, matching, relational, usage, variants
from tessera.sources import readers, sinks
from tessera.streaming import usage_stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def heading(level, text, page=1):
    return {"type": "heading", "level": level, "text": text, "page": page}


def paragraph(text, page=1):
    return {"type": "paragraph", "text": text, "page": page}


def test_chunk_paths_and_sizes():
    assert [c["path"] for c in documents.pack_chunks([heading(3, "A"), paragraph("x"), heading(3, "B"), paragraph("y")], 100)] == ["A", "B"]
    got = documents.pack_chunks([heading(1, "Report"), heading(3, "Revenue"), paragraph("x", 2), heading(2, "Outlook", 3), paragraph("y", 3)], 100)
    assert [(c["path"], c["page"]) for c in got] == [("Report > Revenue", 1), ("Report > Outlook", 3)]
    long = " ".join(f"Sentence number {i} has a few words." for i in range(80))
    pieces = documents.split_to_fit(long, 600)
    assert all(len(p) <= 600 and p.endswith(".") for p in pieces) and " ".join(pieces) == long
    assert [len(p) for p in documents.split_to_fit("x" * 1500, 600)] == [600, 600, 300]
    rows = [["cell a", "cell b", str(i)] for i in range(60)]
    table = documents.pack_chunks([{"type": "table", "rows": rows, "page": 1}], 300)
    assert [line for c in table for line in c["text"].split("\n")] == [" | ".join(r) for r in rows]
    packed = documents.pack_chunks([paragraph("p" * 99) for _ in range(10)], 300)
    assert len(packed) == 5 and {len(c["text"]) for c in packed} == {200}


@pytest.mark.parametrize(
    "cell, value",
    [("0", 0), ("0.10", 0.1), ("-0.5", -0.5), ("1,900,000", 1.9e6), ("-3.5", -3.5), ("(120)", -120), ("(1,200.50)", -1200.5), ("123456789012345", 123456789012345), ("007012", None), ("0,123", None), ("1234567890123456", None), ("(5", None), ("5)", None), ("18%", None), ("12abc", None)],
)
def test_numeric_cells(spark, cell, value):
    assert one(spark, T.parse_numeric(F.lit(cell))) == value


@pytest.mark.parametrize("cell, out", [("=A1", "'=A1"), ("+1", "'+1"), ("@x", "'@x"), ("-cmd", "'-cmd"), ("-3.5", "-3.5"), ("-1,200.50", '"-1,200.50"'), ("-", "-"), ("-12%", "-12%"), ('a"b', '"a""b"'), ("a\nb", '"a\nb"')])
def test_csv_cells(spark, cell, out):
    assert one(spark, T.csv_cell(F.lit(cell))) == out


def test_entities_decode_once(spark):
    assert one(spark, T.html_text(F.lit("<p>a&amp;lt;b</p><script>x</script>&#233;&#xE9;&bogus;&#0; &#128512;<br>c<b>d</b>"))) == "a&lt;b\néé&bogus;&#0; 😀\ncd"


def test_small_text_functions(spark):
    assert [one(spark, T.column_name(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [one(spark, T.format_duration(F.lit(s))) for s in (5, 65, 3600, 3725)] == ["0:05", "1:05", "1:00:00", "1:02:05"]
    assert one(spark, T.grouped_digits(F.lit(1234567))) == "1\u00a0234\u00a0567"
    assert one(spark, T.normal_email(F.lit(" A@b.Co "))) == "a@b.co" and one(spark, T.normal_email(F.lit("a@b"))) is None
    assert one(spark, T.shown_code(F.lit("abcd-efgh ijkl.mnop"))) == "ABCD-EFGH-IJKL-MNOP"
    assert one(spark, N.split_names(F.lit("Rage x Kay and Ray, !!!, May & Jo"))) == ["Rage", "Kay", "Ray", "May", "Jo"]
    assert one(spark, N.split_names(F.lit("Florence + The Machine"))) == ["Florence + The Machine"] and one(spark, N.split_names(F.lit("Hall with Oates"))) == ["Hall with Oates"]
    assert one(spark, T.first_link(F.lit("see https://a.b/c?d=1). or"))) == "https://a.b/c?d=1"
    assert one(spark, T.lucene_escape(F.lit('a+b"'))) == 'a\\+b\\"'
    assert one(spark, T.dice(F.lit("night"), F.lit("nacht"))) == 0.25
    assert one(spark, T.half_up(F.lit(-2.5), 0)) == -2


def test_sinks(spark):
    blocks = [("d", [heading(2, "T"), paragraph("p"), {"type": "list", "ordered": True, "items": ["x", "y"], "page": 2}, {"type": "table", "rows": [["a|b", "c"], ["1", "2"]], "page": 2}])]
    df = spark.createDataFrame(blocks, f"doc_id string, blocks array<{documents.BLOCK}>")
    r = df.select(documents.to_markdown(F.col("blocks")).alias("m"), documents.to_plain_text(F.col("blocks")).alias("t"), documents.to_paged_text(F.filter("blocks", lambda b: b["page"].isNotNull())).alias("g"), documents.table_csv(F.col("blocks")[3]["rows"]).alias("c")).first()
    assert r.m == "## T\n\np\n\n1. x\n2. y\n\n| a\\|b | c |\n| --- | --- |\n| 1 | 2 |\n"
    assert r.t == "T\n\np\n\n• x\n• y\n\na|b\tc\n1\t2\n"
    assert r.g == "[Page 1]\n## T\n\np\n\n[Page 2]\n- x\n- y\n\na|b | c\n1 | 2"
    assert r.c == "﻿a|b,c\r\n1,2\r\n"
    entries = spark.createDataFrame([("l", 0, "-x", 65, "u"), ("l", 1, None, None, None)], "list_id string, pos int, title string, seconds int, url string")
    assert sinks.playlist_csv(entries).first().csv == '﻿"1","\'-x","1:05","u"\r\n"2","","",""\r\n'


def test_tables_over_page_breaks(spark):
    rows = [("d", 1, None, 1, [["h", "k"], ["1", "2"]]), ("d", 2, "table", 2, [["h", "k"], ["3", "4"]]), ("d", 3, "paragraph", 3, [["h", "k"], ["5", "6"]]), ("d", 4, "table", 4, [["x", "y"], ["7", "8"]])]
    df = spark.createDataFrame(rows, "doc_id string, block_no int, prev_type string, page int, rows array<array<string>>")
    got = {r.table_no: (r.page, r["rows"]) for r in documents.joined_tables(df).collect()}
    assert got == {1: (1, [["h", "k"], ["1", "2"], ["3", "4"]]), 2: (3, [["h", "k"], ["5", "6"], ["x", "y"], ["7", "8"]])}


def test_readers(spark, tmp_path):
    assert readers.text_of("é".encode("utf-16")) == "é" and readers.text_of(b"\xe9") == "é" and readers.text_of(b"a\0b") is None and readers.text_of("é".encode()) == "é"
    (tmp_path / "a.json").write_text('{"a": 1}\nbad\n')
    assert readers.ndjson(spark, str(tmp_path / "a.json"), "a int", strict=False).cache().filter("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        readers.ndjson(spark, str(tmp_path / "a.json"), "a int").collect()
    hits = spark.createDataFrame([("q", '{"recordings": [{"id": "00000000-0000-4000-8000-00000000a001", "title": "T", "score": 90, "artist-credit": [{"name": "A", "joinphrase": " & "}, {"name": "B"}], "releases": [{"id": "x", "date": "2001"}, {"id": "y", "date": "1999"}]}, {"id": "bad", "title": "x"}]}')], "query string, raw_json string")
    r = readers.search_hits(hits).collect()
    assert len(r) == 1 and (r[0].artist, r[0].date, r[0].releases) == ("A & B", "1999", 2)
    entries = spark.createDataFrame([("l", i, "[Deleted video]" if i == 1 else "t") for i in range(5)], "list_id string, pos int, title string")
    got = readers.playlist(entries, 3).collect()
    assert [r.pos for r in got] == [0, 2] and all(r.truncated for r in got)


def test_quota_limits(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "s", k) for i, k in enumerate(["consume", "consume", "consume", "refund", "refund", "refund", "consume"])]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, subject string, kind string")
    got = [r.remaining for r in usage.counters_with_refunds(df, "day", 2).orderBy("event_id").collect()]
    assert got == [1, 0, -1, 1, 2, 2, 1]
    assert [r.remaining for r in usage.admitted(df.filter("kind = 'consume'"), ["subject"], "day", 2, ["ts"]).orderBy("event_id").collect()] == [1, 0, -1, -1]
    assert [r.remaining for r in usage.admitted(df.limit(1), ["subject"], "day", 0, ["ts"]).collect()] == [-1]
    claims = usage.nested_claims(df.select("event_id", "ts", "subject"), {"day": 3, "minute": 1}).orderBy("event_id").collect()
    assert [r.refused_by for r in claims] == [None] * 3 + ["day"] * 4


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 7, 0, i % 7), f"s{i % 2}", "refund" if i % 5 == 4 else "consume") for i in range(40)]
    schema = "event_id long, ts timestamp_ntz, subject string, kind string"
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = {r.event_id: r.remaining for r in usage.counters_with_refunds(spark.read.parquet(f"{tmp_path}/in"), "day", 2).collect()}
    stream = usage_stream.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files=100)
    assert {r.event_id: r.remaining for r in usage_stream.run_to_end(usage_stream.admitted(stream, 2), "admitted").collect()} == batch
    firsts = usage_stream.run_to_end(usage_stream.first_of_each(stream, ["subject"], "100 days"), "firsts")
    assert firsts.count() == 2


def test_stream_keeps_state_by_shards(spark, tmp_path):
    """Python is called for shards, not for each subject's window; four micro-batches in the order of time, nulls and long ids among them."""
    rows = [(None if i == 77 else 2**60 + i, dt.datetime(2024, 1, 1 + i // 100, i % 100 // 5), None if i % 11 == 0 else 2**58 + i % 30, "refund" if i % 7 == 6 else None if i % 7 == 5 else "consume") for i in range(400)]
    schema = "event_id long, ts timestamp_ntz, subject long, kind string"
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    used, want = {}, []
    for event_id, ts, subject, kind in sorted(rows, key=lambda r: (r[1], r[0] is None, r[0])):
        have = used.get((subject, ts.date()), 0)
        used[subject, ts.date()] = max(0, have - 1) if kind == "refund" else min(2, have + 1)
        want.append((event_id, subject, -1 if kind != "refund" and have == 2 else 2 - used[subject, ts.date()]))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = usage_stream.admitted(stream, 2, shards=3).writeStream.format("memory").queryName("by_shards").trigger(availableNow=True).start()
    q.awaitTermination()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, spark.table("by_shards").collect()), key=order) == sorted(want, key=order)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4


def test_thinking_is_stripped_over_pieces(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(["x<th", "ink>secret", "</thi", "nk>y<think>open"])], "stream_id string, pos int, piece string")
    assert usage.stripped_thinking(df).first().text == "xy"
    assert usage.paced([0, 0, 0, 5], 1, 1.5) == [0, 1, None, 5]


def test_entitlements(spark):
    now = dt.datetime(2024, 1, 10)
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, "pro", "active", day(8), None, None, None, None), (2, "pro", "cancelled", day(9), "team", day(11), None, None), (3, "pro", "active", day(7), None, None, None, day(11)), (4, None, None, None, "pro", day(11), None, day(12)), (5, None, None, None, None, None, day(11), None)]
    df = spark.createDataFrame(rows, "id int, subscription_plan string, subscription_status string, current_period_end timestamp_ntz, prepaid_plan string, paid_until timestamp_ntz, team_until timestamp_ntz, pro_until timestamp_ntz")
    plans = relational.own_plans(df, F.lit(now).cast("timestamp_ntz"))
    assert {r.id: (r.plan, r.source) for r in plans.collect()} == {1: ("pro", "subscription"), 2: ("team", "prepaid"), 3: ("pro", "tester"), 4: ("pro", "prepaid"), 5: ("team", "tester")}
    users = spark.createDataFrame([(1, "A@x", 1), (6, "b@x", None), (7, "B@x", 1), (5, "own@x", 1)], "id int, email string, email_confirmed_at int")
    seats = spark.createDataFrame([(5, "b@x"), (5, "own@x"), (1, "a@x")], "owner_id int, email string")
    assert {r.id: r.plan for r in relational.effective_plans(users, plans, seats).collect()} == {1: "pro", 6: "free", 7: "team", 5: "team"}
    old, new = spark.createDataFrame([(1, "pro", "a")], "id int, plan string, name string"), spark.createDataFrame([(1, "team", "b"), (2, "team", "c")], "id int, plan string, name string")
    assert {tuple(r) for r in relational.guarded_write(old, new, "id", ["plan"], F.lit(False)).collect()} == {(1, "pro", "b"), (2, "team", "c")}


def test_page_lists(spark):
    assert one(spark, lists.page_list(F.lit("2 - 4, 7; -2 8-, x"), F.lit(9))) == [0, 1, 2, 3, 6, 7, 8]
    assert one(spark, lists.page_ranges(F.lit("5-3, 1 2; 4-, 99"), F.lit(5))) == [[2, 3, 4], [0], [1], [3, 4]]
    plan = spark.createDataFrame([("p", i, i) for i in range(5)], "plan_id string, pos long, id int")
    ids = lambda df: [r.id for r in df.orderBy("pos").collect()]
    assert ids(lists.move(plan, F.col("id").isin(0, 3), 99)) == [1, 2, 4, 0, 3]
    assert ids(lists.reverse(plan, F.col("id").isin(1, 3, 4))) == [0, 4, 2, 3, 1]
    assert ids(lists.reverse(plan, F.col("id") == 1)) == [4, 3, 2, 1, 0]
    assert ids(lists.append(plan, plan.withColumn("id", F.col("id") + 10))) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_graphs(spark):
    nodes = spark.createDataFrame([(i, b) for i, b in [(1, "r"), (2, "a"), (3, "a"), (4, "leaf"), (5, "leaf"), (6, "lost"), (7, "lost2")]], "id long, body string")
    edges = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (2, 4, "c"), (3, 5, "c"), (6, 7, "z"), (7, 6, "z"), (4, 99, "bad")], "src long, dst long, label string")
    roots = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in graph.unreachable(nodes, edges, roots).collect()} == {6, 7}
    assert [r.dst for r in graph.dangling(edges, nodes).collect()] == [99]
    keep = {r.id: r.keep for r in graph.deduplicated(nodes, edges.filter("dst <> 99")).collect()}
    assert (keep[5], keep[3], keep[6]) == (4, 2, 6)
    assert {r.id for r in graph.cascade(edges, spark.createDataFrame([(2,)], "id long"), spark.createDataFrame([(3,)], "id long")).collect()} == {2, 4, 99}
    tree = spark.createDataFrame([(1, None, 90), (2, 1, None), (3, 2, None), (4, 2, 180), (5, 5, None)], "id int, parent int, rotate int")
    assert {r.id: r["rotate"] for r in graph.inherited(tree, "rotate").collect()} == {1: 90, 2: 90, 3: 90, 4: 180, 5: None}


def test_candidates(spark):
    rows = [("q", 0, "A", "Song (Live)", "1990", 1, 90, True, 0.9), ("q", 1, "A", "Song", "1995", 1, 80, False, 0.8), ("q", 2, "B", "Song (Live)", "1991", 1, 95, True, 0.9), ("q", 3, "C", "Other", None, 1, 10, False, 0.1)]
    df = spark.createDataFrame(rows, "query string, pos int, artist string, title string, date string, releases int, score int, variant boolean, match double")
    best = matching.grouped_candidates(df)
    assert [(r.pos, r.match, r.place) for r in best.orderBy("place").collect()] == [(1, 0.9, 1), (2, 0.765, 2), (3, 0.1, 3)]
    assert matching.ambiguous(best).first().ambiguous is False
    assert one(spark, variants.video_plan(F.lit(140.0), F.lit(100.0), F.lit(True))) == "encode"


def test_closure_of_a_long_chain_is_whole(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 3)], "src long, dst long").coalesce(1).cache()
    roots = spark.createDataFrame([(0, 0)], "root long, id long")
    assert {(r.id, r.hops) for r in graph.reachable(edges, roots).collect()} == {(i, i) for i in range(71)}
    with pytest.raises(RuntimeError):
        graph.reachable(edges, roots, depth=3)


def test_name_keys(spark):
    rows = [("Beyoncé", "beyonce"), ("The B.I.G. & Don’t", "thebiganddont"), ("ＦＵＬＬ ﬁ", "fullfi"), ("東京 Москва", "東京москва"), ("Run-D.M.C.", "rundmc"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").select("*", N.name_key(F.col("t")).alias("got"), N.artist_key(F.col("t")).alias("a"))
    got = df.collect()
    assert all(r.got == r.want for r in got) and got[1].a == "biganddont"
    assert spark.range(1).select(N.artist_keys(F.array(F.lit("The Who"), F.lit("..."), F.lit("Beyoncé"))).alias("k")).first().k == ["who", "beyonce"]
    assert one(spark, T.clean_text(F.lit("e\u0301\r\nx\x07"))) == "é\nx"
    assert one(spark, T.lucene_escape(F.lit("AC/DC:\x01  a"))) == "AC\\/DC\\: a"
    assert [one(spark, T.column_name(F.lit(k))) for k in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_what_titles_say(spark):
    said = lambda f, t: one(spark, f(F.lit(t)))
    assert [said(titles.is_decoration, t) for t in ("Official Music Video", "Remastered 2009", "4K", "Don't Do It", "music video", "2009")] == [True, True, True, False, True, False]
    assert [said(titles.variant_of, t) for t in ("Live at Wembley", "KREAM Remix", "Acústico", "Cover Me", "Delivery")] == ["live", "remix", "acoustic", "cover", None]
    assert [said(titles.remixer_of, t) for t in ("KREAM Remix", "Official Remix", "remixed by Jo", "live")] == ["KREAM", None, "Jo", None]
    guests = titles.without_guests(F.lit("Umbrella ft. Jay-Z & Ray (prod. by X)"))
    assert one(spark, guests[0]) == "Umbrella" and one(spark, guests[1]) == ["Jay-Z", "Ray"]
    assert said(titles.without_end, "Hello Official MV") == "Hello" and said(titles.without_end, "Full Moon") == "Full Moon" and said(titles.trim_symbols, "★ Hello – ") == "Hello"
    assert said(titles.unquoted, "“Hello”") == "Hello" and said(titles.without_reaction, "FIRST TIME HEARING Stronger REACTION!!") == "Stronger"
    assert one(spark, titles.penalty_of(F.lit("Hello reaction (1 hour loop)"), F.lit(True))) == 0.65 and one(spark, titles.penalty_of(F.lit("Hello (Original Mix)"), F.lit(False))) == 0.0
    names_of = titles.artist_and_alias(F.lit("BTS (방탄소년단)")), titles.artist_and_alias(F.lit("周杰倫 Jay Chou"))
    assert [(one(spark, n), one(spark, a)) for n, a in names_of] == [("BTS", ["방탄소년단"]), ("周杰倫", ["Jay Chou"])]


def test_channels(spark):
    rows = [("Kanye West - Topic", "Kanye West", True, False), ("KanyeWestVEVO", "Kanye West", False, True), ("TaylorSwiftOfficial", "Taylor Swift", False, False), ("Adele Music Official Channel", "Adele", False, False), (None, None, False, False), ("Records", "Records", False, False)]
    got = titles.read_channels(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, channel string")).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {i: r[1:] for i, r in enumerate(rows)}


def test_songs_meet_the_catalog_both_ways(spark):
    songs = spark.createDataFrame([(1, "The Beyonce & Jay", "Crazy in Love!"), (2, "Chi-Lites", "Are You My Woman (Tell Me So)"), (3, "Someone", "Crazy in Love"), (4, "", "Crazy in Love")], "song int, artist string, title string")
    none = "CAST(NULL AS array<string>)"
    catalog = spark.createDataFrame([(7, "sample", "Beyoncé", "Crazy in Love", "The Chi-Lites", "Are You My Woman", 2003, 1970)], "entry int, relation string, artist string, title string, source_artist string, source_title string, year int, source_year int").selectExpr("*", *(f"{none} AS {c}" for c in ("title_aliases", "artist_aliases", "source_title_aliases", "source_artist_aliases")))
    found = matching.catalog_matches(songs, catalog)
    assert sorted(map(tuple, found.collect())) == [(1, 7, "forward"), (2, 7, "backward")]
    assert sorted(map(tuple, matching.first_year(found, catalog).collect())) == [(1, 2003), (2, 1970)]
    likest = matching.likest(F.array(F.lit("abc"), F.lit("night")), F.array(F.lit("nacht"), F.lit("xyz")))
    assert one(spark, likest) == pytest.approx(0.25)


def test_copies_in_the_catalog_are_compared_once(spark):
    """Each pair of copies is there, and is made by the last join: it is neither grouped nor sent on. Ids of several rows have all of their names."""
    schema, none = "entry int, relation string, artist string, title string, source_artist string, source_title string", "CAST(NULL AS array<string>)"
    with_aliases = lambda df: df.selectExpr("*", *(f"{none} AS {c}" for c in ("title_aliases", "artist_aliases", "source_title_aliases", "source_artist_aliases")))
    entries = [(i, "sample", "Nas", "The Message" if i % 2 else "Gold", "AZ", "Battle") for i in range(40)]
    songs = [(i, "AZ" if i % 3 == 0 else "Nas", "Battle" if i % 3 == 0 else "Message") for i in range(60)] + [(None, "Nas", "Message")]
    found = matching.catalog_matches(spark.createDataFrame(songs, "song int, artist string, title string"), with_aliases(spark.createDataFrame([*entries, (None, *entries[1][1:])], schema)))
    want = [(i, e, "backward") for i in range(0, 60, 3) for e in range(40)] + [(i, e, "forward") for i in range(60) if i % 3 for e in range(1, 40, 2)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = [(1, "Nas", "Battle"), (1, "AZ", "Message"), (2, "Nas", "Battle"), (1, "Nas", "Battle")]
    found = matching.catalog_matches(spark.createDataFrame(twice, "song int, artist string, title string"), with_aliases(spark.createDataFrame([entries[1], entries[1]], schema)))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "backward"), (1, 1, "forward")]
