import math
import random

import pytest

from tessera.operators import overlaps

CELLS, ANCHORS = "table_no long, row_no long, cell_no long, x double, right double, slack double", "table_no long, anchor_no long, x double, right double"


@pytest.mark.parametrize("large", [1_000_000, 40])
def test_cells_under_anchors_equal_all_pairs(spark, monkeypatch, large):
    """Rows of several cells, anchors of several intervals, without names or bounds, without end; tables that are dealt to several tasks."""
    monkeypatch.setattr(overlaps, "LARGE_TABLE", large)
    r = random.Random(3)
    at = lambda: r.choice([None, math.inf, -math.inf, *(float(r.randrange(60)) for _ in range(30))])
    end = lambda x: None if x is None else x + r.choice([-1.0, 0.0, 0.0, 1.0, 4.0, 9.0])
    cells = [(r.choice([None, 1, 2, 3, 4]), r.choice([None, *range(9)]), r.choice([None, *range(9)]), x := at(), end(x), r.choice([0.0, 0.5, 2.0])) for _ in range(400)]
    anchors = [(r.choice([None, 1, 2, 3, 5]), r.choice([None, *range(12)]), x := at(), end(x)) for _ in range(60)] + [(6, 1, 0.0, 1.0)]
    cells += [(7, 1, 1, None, None, 0.0), (7, 1, 2, 1.0, 0.0, 0.0)]
    want = {}
    for t, row, cell, x, right, slack in cells:
        n, aligned, claimed = want.setdefault((t, row), [0, set(), set()])
        want[t, row][0] += 1
        if None in (t, row, x):
            continue
        for u, anchor, left, end_ in anchors:
            if u == t and left is not None and left <= end_ and x - slack <= right + slack and x - slack <= end_ and left <= right + slack:
                aligned.add(cell)
                claimed.add(anchor)
    found = overlaps.cells_under_anchors(spark.createDataFrame(cells, CELLS), spark.createDataFrame(anchors, ANCHORS)).select("table_no", "row_no", "n_cells", "aligned", "claimed").collect()
    assert {tuple(f)[:2]: tuple(f)[2:] for f in found} == {k: (n, len(a - {None}), len(c - {None})) for k, (n, a, c) in want.items()} and len(found) == len(want)


def test_cells_under_anchors_form_no_pairs(spark):
    """20,000 cells over 20,000 anchors that all touch: 400 million pairs."""
    cells = spark.range(20_000).selectExpr("1L AS table_no", "id % 4 AS row_no", "id AS cell_no", "CAST(id % 7 AS DOUBLE) AS x", "100D AS right", "0D AS slack")
    anchors = spark.range(20_000).selectExpr("1L AS table_no", "id AS anchor_no", "CAST(id % 50 AS DOUBLE) AS x", "60D AS right")
    got = overlaps.cells_under_anchors(cells, anchors).collect()
    assert sorted((g.row_no, g.n_cells, g.aligned, g.claimed) for g in got) == [(k, 5000, 5000, 20_000) for k in range(4)]


def _lines(words, share):
    """As a fold over all words of a page."""
    out, firsts = {}, {}
    for page, no, _, y0, y1 in sorted(words, key=lambda w: (w[0], (w[3] is not None, w[3] or 0.0), w[2], w[1])):
        mine = firsts.setdefault(page, [])
        known = [] if None in (y0, y1) or y0 > y1 else [k for k, (a, b) in enumerate(mine) if a is not None and a <= b and min(b, y1) >= y0 and min(b, y1) - y0 > min(b - a, y1 - y0) * share]
        if not known:
            mine.append((None, None) if None in (y0, y1) else (y0, y1))
        out[page, no] = known[0] if known else len(mine) - 1
    return out


@pytest.mark.parametrize("share", [0.5, 0.9, 0.0, -0.5])
def test_words_join_the_first_line_they_overlap(spark, share):
    """Also words without height or bounds, upside down, without end; pages end within a task."""
    r = random.Random(5)
    height = lambda y: r.choice([None, y, y - 1.0, math.inf, *(y + r.randrange(1, 30) for _ in range(20))])
    words = [(p, no, r.randrange(5), y := r.choice([None, *(float(r.randrange(200)) for _ in range(30))]), height(y or 0.0)) for p in range(7) for no in range(60)]
    df = spark.createDataFrame([*words, (None, 1, 1, 1.0, 2.0)], "page int, word_no int, x0 int, y0 double, y1 double")
    got = overlaps.line_words(df, ["page"], share)
    assert got.columns == [*df.columns, "line_no"] and {(g.page, g.word_no): g.line_no for g in got.collect()} == _lines(words, share)


def test_lines_are_found_in_one_pass(spark, monkeypatch):
    """A chain of 20,000 words, each of which overlaps the next ones: nothing is written between, and no turns are taken."""
    from tessera.operators import stash

    monkeypatch.setattr(stash.Stash, "put", None)
    words = spark.range(20_000).selectExpr("1 AS page", "id AS word_no", "0 AS x0", "CAST(id AS DOUBLE) AS y0", "id + 10D AS y1")
    got = sorted((g.word_no, g.line_no) for g in overlaps.line_words(words, ["page"]).collect())
    assert got == [(k, k // 5) for k in range(20_000)]
