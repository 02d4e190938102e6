"""Where drawing programs show images. A program (a page's or a form's) is folded once, whoever calls it, to what it calls under which matrix; matrices along chains
of calls are then multiplied by joins, so programs run in parallel and a form that is drawn a thousand times is read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stash import Stash

IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def product(first: Column | list[float], then: Column | list[float]) -> list:
    """Six numbers of the matrix that is `first`, then `then` (rows: x, y, and where the origin goes)."""
    a, b = [first[i] for i in range(6)], [then[i] for i in range(6)]
    rows = [(a[i] * b[0] + a[i + 1] * b[2], a[i] * b[1] + a[i + 1] * b[3]) for i in (0, 2, 4)]
    return [*rows[0], *rows[1], rows[2][0] + b[4], rows[2][1] + b[5]]


def calls(steps: DataFrame) -> DataFrame:
    """steps (program, pos, op, args: six numbers of a cm, name) to the calls (program, target, matrix) that a program makes by 'Do' and 'gs' (under the matrix of that
    moment) and 'pattern' (under the program's own). 'q' saves the matrix, 'Q' takes the last one back, if there is one."""
    kind = dict(steps.dtypes)["program"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, now, saved = object(), IDENTITY, []
        for b in batches:
            found = []
            for own, op, args, name in zip(*(b.column(c).to_pylist() for c in ("program", "op", "args", "name"))):
                if own != program:
                    program, now, saved = own, IDENTITY, []
                if op == "q":
                    saved.append(now)
                elif op == "Q":
                    now = saved.pop() if saved else now
                elif op == "cm" and args is not None and len(args) == 6:
                    now = product(args, now)
                elif op in ("Do", "gs", "pattern") and name is not None:
                    found.append((own, name, IDENTITY if op == "pattern" else now))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("program").type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.float64()))], ["program", "target", "matrix"])

    ordered = steps.select("program", "pos", "op", "args", "name").repartition("program").sortWithinPartitions("program", "pos")
    return ordered.mapInArrow(run, f"program {kind}, target string, matrix array<double>")


def shown_sizes(steps: DataFrame, pages: DataFrame, forms: DataFrame, images: DataFrame, depth: int = 24) -> DataFrame:
    """image, width, height: the largest size at which pages (program, unit) show each of images (image), by themselves or by forms (form, matrix) that they call,
    `depth` calls deep at most. A form that is being drawn is not drawn inside of itself."""
    stash = Stash(steps.sparkSession)
    made = stash.put(calls(steps), "calls")
    to_images = made.join(images.select(F.col("image").alias("target")), "target")
    own = F.array(*product(F.col("form_matrix"), F.col("matrix")))
    to_forms = stash.put(made.join(forms.select(F.col("form").alias("target"), F.col("matrix").alias("form_matrix")), "target").select("program", "target", own.alias("step")), "forms")
    at = pages.select("program", F.col("unit").cast("double").alias("unit"), F.array(*map(F.lit, IDENTITY)).alias("base"), F.array(F.col("program").cast("string")).alias("path"))
    found = None
    for _ in range(depth + 1):
        at = stash.put(at, "at")
        if not at.limit(1).count():
            break
        m = product(F.col("matrix"), F.col("base"))
        size = at.join(to_images, "program").select(F.col("target").alias("image"), *((F.sqrt(m[i] * m[i] + m[i + 1] * m[i + 1]) * F.col("unit")).alias(n) for i, n in ((0, "width"), (2, "height"))))
        found = size if found is None else found.union(size)
        deeper = at.join(to_forms, "program").filter(~F.array_contains("path", F.col("target")))
        at = deeper.select(F.col("target").cast(dict(pages.dtypes)["program"]).alias("program"), "unit", F.array(*product(F.col("step"), F.col("base"))).alias("base"), F.array_append("path", F.col("target")).alias("path"))
    return found.groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"))
