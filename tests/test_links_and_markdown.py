import random

from pyspark.sql import functions as F

from tessera.functions import links
from tessera.operators import graph, markdown, matching, placements, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def tree(spark, text):
    """Blocks as nested lists: (type, text or cells, what stands under it)."""
    rows = sorted(markdown.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect(), key=lambda r: r.line_no)

    def under(parent):
        return [(r.type if r.type != "item" else f"item{r.list_no}{'.' + str(r.start) if r.ordered else ''}", r.text if r.type != "table" else [r.head, *r.rows], under(r.line_no)) for r in rows if r.parent == parent]

    return under(None)


def test_markdown_trees(spark):
    assert tree(spark, "# T\n\ntext\n- a\n\n- b\n  - c\n    more\n1. d\nend") == [
        ("heading", "T", []), ("paragraph", "text", []), ("item3", "a", []), ("item3", "b", [("item6", "c", [("paragraph", "more", [])])]), ("item8.1", "d", []), ("paragraph", "end", []),
    ]
    assert tree(spark, "| a | b \\| c |\n|---|:-:|\n| 1 |\n2 | 3 | 4\n\nx | y") == [("table", [["a", "b | c"], ["1", ""], ["2", "3"]], []), ("paragraph", "x | y", [])]
    assert tree(spark, "3) x\n4) y\n   - z\n\n\tdeep") == [("item0.3", "x", []), ("item0.3", "y", [("item2", "z", [("paragraph", "deep", [])])])]
    assert tree(spark, "- a\n - b\n* c\n1. d\n- e") == [("item0", "a", []), ("item0", "b", []), ("item0", "c", []), ("item3.1", "d", []), ("item4", "e", [])]
    assert tree(spark, "#no\n####### no\n- ") == [("paragraph", "#no", []), ("paragraph", "####### no", []), ("paragraph", "-", [])]
    assert tree(spark, "a | b\n---|---") == [("table", [["a", "b"]], [])]
    assert markdown.markdown_blocks(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).count() == 0
    assert markdown.markdown_blocks(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_nesting_is_limited_outside_of_fences(spark):
    deep = "> " * 30 + "x"
    rows = [(1, f"{deep}\n{' ' * 50}y\n~~~~\n{' ' * 50}code\n```\n~~~\n{deep}\n~~~~~\n\t\t\t\t\t\t\t\t\t\t\tz\n  > > q")]
    got = markdown.rejoined(markdown.limited_nesting(spark.createDataFrame(rows, "doc_id int, text string"))).first().text
    assert got.split("\n") == ["> " * 19 + "> x", " " * 40 + "y", "~~~~", " " * 50 + "code", "```", "~~~", deep, "~~~~~", " " * 40 + "z", "  > > q"]


def test_longest_common_lines(spark):
    rng = random.Random(3)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for k, y in enumerate(b):
            out.append(row[k] + 1 if x == y else max(row[k + 1], out[k]))
        return out

    cases = [([rng.choice("abcd") for _ in range(rng.randrange(14))], [rng.choice("abcd") for _ in range(rng.randrange(14))]) for _ in range(150)] + [(["y", "x", "z", "x"], ["x"]), (["x", "y", "x"], ["x"])]
    for r in spark.createDataFrame(cases, "a array<string>, b array<string>").select("a", "b", sequences.matched_lines(F.col("a"), F.col("b")).alias("p")).collect():
        pairs = [(p.a, p.b) for p in r.p]
        assert all(r.a[i] == r.b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len({i for i, _ in pairs}) == len(pairs) == length(r.a, r.b)
    ends = spark.createDataFrame([(["y", "x", "z", "x"], ["x"])], "a array<string>, b array<string>").select(sequences.matched_lines(F.col("a"), F.col("b")).alias("p")).first().p
    assert [tuple(p) for p in ends] == [(3, 0)]
    big = [f"u{k}" for k in range(20_000)]
    far = spark.createDataFrame([(["h", *big, "t"], ["h", *big[::-1], "t"])], "a array<string>, b array<string>")
    assert [len(far.select(sequences.matched_lines(F.col("a"), F.col("b"), most=m).alias("p")).first().p) for m in (1_000_000, None)] == [2, 3]


def test_catalog_names_and_versions(spark):
    none = "CAST(NULL AS array<string>)"
    entries = [(1, "sample", "Kanye West", "Stronger", "Daft Punk", "Harder, Better, Faster, Stronger"), (2, "sample", "Twista", "Slow Jamz", "Jamie Foxx", "Gold"), (3, "sample", "Nas", "The Message", "AZ", "Sugar Hill (Live)"), (4, "sample", "Lil Nas X", "Old Town Road", "Kim", "Battle")]
    catalog = spark.createDataFrame(entries, "entry int, relation string, artist string, title string, source_artist string, source_title string").selectExpr("*", *(f"{none} AS {c}" for c in ("title_aliases", "artist_aliases", "source_title_aliases", "source_artist_aliases")))
    songs = [(1, "Kanye West", "Stronger (Live)"), (2, "Kanye West", "Stronger (Deluxe)"), (3, "Kanye West feat. Jamie Foxx", "Gold"), (4, "Nas with AZ", "Sugar Hill (Live)"), (5, "AZ", "Sugar Hill"), (6, "Ray vs. Kim", "Battle"), (7, "Nas", "Message"), (8, "Lil Nas X x Billy", "Old Town Road"), (9, "Nas", "Old Town Road"), (10, "Kanye West", "Stronger - Acoustic"), (11, "NAS", "the message")]
    got = matching.catalog_matches(spark.createDataFrame(songs, "song int, artist string, title string"), catalog).collect()
    assert sorted(map(tuple, got)) == [(2, 1, "forward"), (3, 2, "backward"), (4, 3, "backward"), (5, 3, "backward"), (6, 4, "backward"), (7, 3, "forward"), (8, 4, "forward"), (11, 3, "forward")]


def test_links(spark):
    of = lambda x: one(spark, links.media_link(F.lit(x)))
    assert tuple(of("youtu.be/dQw4w9WgXcQ")) == ("youtube", "dQw4w9WgXcQ", "https://www.youtube.com/watch?v=dQw4w9WgXcQ", None)
    assert tuple(of("https://www.tiktok.com/t/ZM8abc/")) == ("tiktok", "ZM8abc", "https://www.tiktok.com/t/ZM8abc/", None)
    assert tuple(of("https://www.instagram.com/p/Cabcde/?img_index=3")) == ("instagram", "Cabcde", "https://www.instagram.com/p/Cabcde/?img_index=3", 3)
    assert tuple(of("HTTPS://X.com/a/status/12345/photo/2")) == ("x", "12345", "https://x.com/i/status/12345/video/2", 2)
    assert [of(x) for x in ("https://example.com/watch?v=dQw4w9WgXcQ", "https://youtube.com.evil.org/watch?v=dQw4w9WgXcQ", "", None, "https://x.com/a")] == [None] * 5


def test_sizes_and_page_list_problems(spark):
    assert [one(spark, links.size_text(F.lit(n).cast("long"))) for n in (0, None, 1, 1023, 1536, 1024**2, 5 * 1024**3 + 1)] == ["0 B", "0 B", "1 B", "1023 B", "1.5 KB", "1 MB", "5 GB"]
    problem = lambda t, n: one(spark, links.page_list_problem(F.lit(t), F.lit(n)))
    assert [problem(t, 5) for t in ("1-3, 5", "4-", "2-10", "", "5 - 3; 1 2")] == [None] * 5
    assert problem("7", 5) == "Page 7 isn't in this PDF (5 pages)." and problem("9-6", 1) == "Page 6 isn't in this PDF (1 page)." and problem("0", 5) == "Page 0 isn't in this PDF (5 pages)."
    assert problem("1, 2-x", 5) == problem("one", 5) == "Use commas between ranges, like 1-3, 5."


def test_values_of_nested_records(spark):
    of = lambda t, depth=40: one(spark, links.nested_value(F.lit(t), "k", depth))
    assert [of(t) for t in ('{"a":{"k":{"x":1}},"k2":1}', '[[{"k":0}],{"k":"v"}]', '{"k":{}}', '{"k":null,"b":{"k":1}}', "no k json", None, '{"b":{"c":{"k":[1]}}}')] == ['{"x":1}', '"v"', "{}", None, None, None, "[1]"]
    assert of("[" * 41 + '{"k":1}' + "]" * 41) is None and of("[" * 40 + '{"k":1}' + "]" * 40) == "1" and of("[" * 100_000) is None


def test_sound_graphs(spark):
    nodes = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), ("e", True), ("f", True), ("g", None)], "id string, ok boolean")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e"), ("e", "d"), ("f", "gone")], "src string, dst string")
    assert {r.id: r.sound for r in graph.sound(nodes, edges).collect()} == {"a": False, "b": False, "c": False, "d": True, "e": True, "f": False, "g": False}


def test_placements(spark):
    steps = [("p", 1, "Q", None, None), ("p", 2, "q", None, None), ("p", 3, "cm", [0.0, 10.0, -20.0, 0.0, 1.0, 1.0], None), ("p", 4, "Do", None, "im"), ("p", 5, "Do", None, "fm"), ("p", 6, "Q", None, None), ("p", 7, "Do", None, "im"), ("p", 8, "cm", [1.0], None), ("p", 9, "pattern", None, "fm")]
    steps += [("fm", 1, "cm", [3.0, 0.0, 0.0, 3.0, 0.0, 0.0], None), ("fm", 2, "Do", None, "im2"), ("fm", 3, "Do", None, "fm"), ("fm", 4, "Do", None, "nothing")]
    df = spark.createDataFrame(steps, "program string, pos int, op string, args array<double>, name string")
    got = placements.shown_sizes(df, spark.createDataFrame([("p", 2.0)], "program string, unit double"), spark.createDataFrame([("fm", [2.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "form string, matrix array<double>"), spark.createDataFrame([("im",), ("im2",)], "image string"))
    assert {r.image: (r.width, r.height) for r in got.collect()} == {"im": (20.0, 40.0), "im2": (120.0, 120.0)}
