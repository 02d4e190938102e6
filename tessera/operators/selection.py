"""Orders with their rule for nulls and ties, and what is taken from the top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(column: str) -> Column:
    """Descending, rows without a value in front."""
    return F.desc_nulls_first(column)


def by_year(column: str, newest: bool) -> Column:
    """Either direction, rows without a year at the end of both."""
    return F.desc_nulls_last(column) if newest else F.asc_nulls_last(column)


def in_custom_order(column: str | Column, order: list[str]) -> Column:
    """The place of a value in a list; values outside of it come last."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column) if isinstance(column, str) else column)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def at_most_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key; an error where there are more."""
    columns = [F.first(c).alias(c) for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.count("*").alias("__n"), *columns)
    return found.filter(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True))).select(*df.columns)


def batch_to_delete(df: DataFrame, old: Column, key: list[str], n: int) -> DataFrame:
    """The next rows that a bounded clean-up removes: the first n of those that are old, in order of the key."""
    return df.filter(old).orderBy(*key).limit(n)


def stable_partition(df: DataFrame, keys: list[str], first: Column, order: str) -> DataFrame:
    """A new place: within each group the rows that match come first, and both parts keep their order."""
    w = Window.partitionBy(*keys).orderBy(F.when(first, 0).otherwise(1), order)
    return df.withColumn("place", F.row_number().over(w))


def recently_used(df: DataFrame, key: str, when: str, most: int) -> DataFrame:
    """The keys that a cache of `most` places still holds, the last used first."""
    last = df.groupBy(key).agg(F.max(when).alias(when))
    return last.orderBy(F.desc(when), key).limit(most)


def related(lists: list[Column], own: Column, n: int) -> Column:
    """The lists one after another, each value once, without the own one, n at most."""
    return F.slice(F.array_distinct(F.filter(F.concat(*lists), lambda x: x != own)), 1, n)


def numbered_repeats(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """label, label-2, label-3 for the first, second, third row of a label."""
    n = F.row_number().over(Window.partitionBy(*keys, label).orderBy(order))
    return df.withColumn("shown", F.when(n == 1, F.col(label)).otherwise(F.concat_ws("-", F.col(label), n.cast("string"))))


def free_names(taken: DataFrame, name: str = "name", order: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """The name that each row gets when tables of fields are joined into one (for each of keys): its own if it is the first to have it, or else the name with
    the least number from 2 on that no row has as its own name, counted up with each repeat."""
    keys = keys or []
    rows = taken.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)))
    base = F.regexp_extract(name, r"^(.*)_([0-9]{1,9})$", 1)
    number = F.regexp_extract(name, r"^(.*)_([0-9]{1,9})$", 2).try_cast("int")
    used = rows.filter(number.isNotNull() & (number >= 2)).select(*keys, base.alias(name), number.alias("__number")).groupBy(*keys, name).agg(F.collect_set("__number").alias("__used"))
    repeats = rows.filter("__n > 1").join(used, [*keys, name], "left")
    held = F.coalesce("__used", F.array().cast("array<int>"))
    open_numbers = F.array_except(F.sequence(F.lit(2), F.col("__n") + F.size(held)), held)
    chosen = F.concat_ws("_", F.col(name), F.element_at(open_numbers, F.col("__n") - 1).cast("string"))
    return rows.filter("__n = 1").withColumn("shown", F.col(name)).drop("__n").unionByName(repeats.withColumn("shown", chosen).drop("__n", "__used"))


def nearest_within(wanted: DataFrame, offered: DataFrame, key: str, value: str, slack: float = 0.15) -> DataFrame:
    """wanted (key, value as wanted) and offered (key, value as offered): all offers within the slack of what is wanted, or else the closest one (the
    smaller one on ties)."""
    pairs = wanted.join(offered, key)
    apart = F.abs(F.col("wanted") - F.col("offered"))
    near = F.col("offered").between(F.col("wanted") * (1 - slack), F.col("wanted") * (1 + slack))
    w = Window.partitionBy(*wanted.columns)
    ranked = pairs.withColumn("__near", near).withColumn("__some", F.max("__near").over(w)).withColumn("__place", F.row_number().over(w.orderBy(apart, "offered")))
    return ranked.filter("__near OR (NOT __some AND __place = 1)").drop("__near", "__some", "__place")


def coalesced_lookup(rows: DataFrame, users: DataFrame, codes: list[str], answer: str) -> DataFrame:
    """The user by the first code that any user has: a left join for each code, the first answer wins."""
    out, found = rows, []
    for i, c in enumerate(codes):
        side = users.select(F.col(c).alias(f"__{i}"), F.col(answer).alias(f"__a{i}")).filter(f"__{i} IS NOT NULL").dropDuplicates([f"__{i}"])
        out = out.join(side, F.col(c) == F.col(f"__{i}"), "left")
        found.append(F.col(f"__a{i}"))
    return out.select(*rows.columns, F.coalesce(*found).alias(answer))


def overlay(own: DataFrame, inherited: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The own value of a name where there is one, and otherwise what is inherited."""
    both = own.withColumn("__rank", F.lit(0)).unionByName(inherited.withColumn("__rank", F.lit(1)))
    return both.groupBy(*keys).agg(F.min_by(value, "__rank").alias(value))


def contiguous(df: DataFrame, keys: list[str], group: str, order: str) -> DataFrame:
    """keys and whether each group of theirs is one run without gaps in the order."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(group).eqNullSafe(F.lag(group).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("__run", change).groupBy(*keys).agg(F.sum("__run").alias("__runs"), F.count_distinct(F.struct(group)).alias("__groups"))
    return runs.select(*keys, (F.col("__runs") == F.col("__groups")).alias("contiguous"))


def sections(sizes: DataFrame, rows: DataFrame, keys: list[str], size: str, order: str, place: str) -> DataFrame:
    """Rows by position into sections of given sizes, one after the other; rows beyond all sections have none."""
    w = Window.partitionBy(*keys).orderBy(order)
    bounds = sizes.withColumn("__end", F.sum(size).over(w)).withColumn("__start", F.col("__end") - F.col(size))
    on = [rows[k] == bounds[k] for k in keys] + [rows[place] > bounds["__start"], rows[place] <= bounds["__end"]]
    return rows.join(bounds, on, "left").select(*(rows[c] for c in rows.columns), bounds[order].alias("section"))


def scanned(pages: DataFrame, key: str, chars: str, is_scan: str) -> DataFrame:
    """Documents that need recognition: no text at all, or at least half of their pages are scans."""
    total = pages.groupBy(key).agg(F.coalesce(F.sum(chars), F.lit(0)).alias("__chars"), F.sum(F.col(is_scan).cast("int")).alias("__scans"), F.count("*").alias("__n"))
    return total.select(key, ((F.col("__chars") == 0) | (2 * F.col("__scans") >= F.col("__n"))).alias("scanned"))


def in_scope(page: Column, count: Column, scope: str, current: Column | None = None, spans: list[tuple[int, int]] = ()) -> Column:
    """Whether a page (from 1) belongs to all, the current one, the odd or even ones, or one of the spans."""
    inside = {"all": F.lit(True), "odd": page % 2 == 1, "even": page % 2 == 0, "current": page == (current if current is not None else F.lit(1))}
    if scope != "range":
        return inside[scope] & page.between(1, count)
    return F.exists(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spans)), lambda s: page.between(s["a"], s["b"])) & page.between(1, count)


def any_of(values: Column, routes: list[tuple[str, list[str]]]) -> Column:
    """The first route one of whose kinds is among the values; null if there is none."""
    out = F.lit(None).cast("string")
    for name, kinds in reversed(routes):
        out = F.when(F.arrays_overlap(values, F.array(*(F.lit(k) for k in kinds))), name).otherwise(out)
    return out


def box_profile(cells: DataFrame, keys: list[str], x: str, y: str, least: int) -> DataFrame:
    """The box of a bitmap's content from its marked cells: first and last row and column with at least `least` of them."""
    axis = lambda c, a, b: cells.groupBy(*keys, c).count().filter(F.col("count") >= least).groupBy(*keys).agg(F.min(c).alias(a), F.max(c).alias(b))
    return axis(x, "left", "right").join(axis(y, "top", "bottom"), keys)


def distinct_up_to(df: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """The number of distinct values, or limit + 1 for more: no group holds more than that many values at any time."""
    firsts = top(df.select(*keys, value).distinct(), keys, [F.col(value)], limit + 1)
    return firsts.groupBy(*keys).agg(F.count("*").alias("n"))


def best_sizes(formats: DataFrame, key: str) -> DataFrame:
    """formats (key, width, height, codec, bitrate, bytes, has_audio): for each frame height (the short side) the bytes of its best
    format (AVC first, then the higher bitrate, then the larger one), with the best audio added once where the format has none."""
    side = F.least("width", "height").alias("side")
    picture = formats.filter("width IS NOT NULL").groupBy(key, side).agg(F.max(F.struct((F.col("codec") == "avc1").alias("avc"), "bitrate", "bytes", "has_audio")).alias("best"))
    sound = formats.filter("width IS NULL").groupBy(F.col(key).alias("__key")).agg(F.max(F.struct("bitrate", "bytes")).alias("audio"))
    joined = picture.join(sound, picture[key] == sound["__key"], "left")
    more = F.when(F.col("best.has_audio"), F.lit(0)).otherwise(F.coalesce("audio.bytes", F.lit(0)))
    return joined.select(key, "side", (F.col("best.bytes") + more).alias("bytes"))


def edges_both_ways(edges: DataFrame, opposite: dict[str, str]) -> DataFrame:
    """edges (a, role, b) and each of them read from the other end."""
    names = F.create_map(*(F.lit(x) for pair in opposite.items() for x in pair))
    return edges.select("a", "role", "b").union(edges.select("b", names[F.col("role")], "a")).distinct()
