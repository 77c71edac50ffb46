"""Lookups and numbering along an order, with keys of any size: groups are cut into buckets of positions.

A window over a whole key would put a hot key into one task. Here windows run within (key, bucket); what carries over
from earlier buckets is found on one row per bucket and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions to a bucket.
WIDTH = 1 << 16


def _bucket(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def _same(a: DataFrame, b: DataFrame, names: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[prefix + n]) for n in names))


def as_of(probes: DataFrame, breaks: DataFrame, keys: list[str], at: str, source: str, value: str, width: int = WIDTH) -> DataFrame:
    """probes with `value` of the last row of breaks at or before `at`, of the same keys; null before the first.

    Of several breaks at one place, that of the greatest value counts. Rows with a null position get null.
    """
    own = probes.columns
    left = probes.select(*own, F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(breaks.schema[value].dataType).alias("_value"))
    right = breaks.filter(F.col(source).isNotNull()).select(*keys, F.col(source).cast("bigint").alias("_at"), F.lit(0).alias("_probe"), F.col(value).alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_bucket", _bucket(F.col("_at"), width))
    places = F.when(F.col("_probe") == 0, F.struct("_at", F.col("_value").alias("v")))
    buckets = both.groupBy(*keys, "_bucket").agg(F.max(places).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*(F.col(k).alias("_c" + k) for k in keys), F.col("_bucket").alias("_c_bucket"), F.last("_last", ignorenulls=True).over(before)["v"].alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_probe", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).filter("_probe = 1")
    joined = found.join(carried, _same(found, carried, [*keys, "_bucket"], "_c"), "left")
    answer = F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    return joined.select(*own, answer.alias(value))


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "k", width: int = WIDTH) -> DataFrame:
    """df with the number of each row among those of its keys, from 1, by a numeric column (ties in any order)."""
    own = df.columns
    rows = df.withColumn("_bucket", _bucket(F.col(order), width))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(*(F.col(k).alias("_c" + k) for k in keys), F.col("_bucket").alias("_c_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)))
    joined = inside.join(counts, _same(inside, counts, [*keys, "_bucket"], "_c"))
    return joined.select(*own, (F.col("_before") + F.col("_k")).alias(name))


def neighbour(df: DataFrame, keys: list[str], order: str, value: str, name: str, after: bool = True, width: int = WIDTH) -> DataFrame:
    """df with `value` of the row after (or before) each among those of its keys; null at the end. Positions of a key differ."""
    own = df.columns
    step, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    rows = df.withColumn("_bucket", _bucket(F.col(order), width)).withColumn("_held", F.struct(F.col(value).alias("v")))
    inside = rows.withColumn("_near", step("_held").over(Window.partitionBy(*keys, "_bucket").orderBy(order)))
    edges = rows.groupBy(*keys, "_bucket").agg(edge("_held", order).alias("_edge"))
    far = step("_edge").over(Window.partitionBy(*keys).orderBy("_bucket"))
    edges = edges.select(*(F.col(k).alias("_c" + k) for k in keys), F.col("_bucket").alias("_c_bucket"), far.alias("_far"))
    joined = inside.join(edges, _same(inside, edges, [*keys, "_bucket"], "_c"))
    return joined.select(*own, F.coalesce("_near", "_far")["v"].alias(name))


def cells_of(low: Column, high: Column) -> Column:
    """The fewest aligned cells of sizes of powers of two that make up [low, high): structs of level and cell, two a level at most."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, stop = F.ceil(low / size).cast("bigint"), F.floor(high / size).cast("bigint")
        cell = lambda c: F.struct(level.alias("level"), c.alias("cell"))
        left = F.when((first < stop) & (F.pmod(first, F.lit(2)) == 1), cell(first))
        right = F.when((first < stop) & (F.pmod(stop, F.lit(2)) == 1), cell(stop - 1))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


#: Cells of up to 2 ** 52 positions: what doubles, in which they are divided, hold exactly.
LEVELS = 52


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, prefix: str = "_r_") -> DataFrame:
    """Every point with every range of its keys that holds it (high excluded): the ranges' other columns get the prefix.

    A point meets a range in the one cell of the range that holds it, so rows are those that match, and a point is
    looked up once for each size of cells that there is. Positions are less than 2 ** 52 either way.
    """
    others = [c for c in ranges.columns if c not in keys]
    cut = ranges.filter(F.col(low) < F.col(high)).select(*keys, *(F.col(c).alias(prefix + c) for c in others), F.explode(cells_of(F.col(low), F.col(high))).alias("_cell"))
    levels = sorted(r[0] for r in cut.select("_cell.level").distinct().collect())  # LEVELS + 1 at most
    tried = points.select("*", F.explode(F.array(*(F.lit(n) for n in levels)) if levels else F.array().cast("array<int>")).alias("_level"))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_level"))
    tried = tried.withColumn("_cell", F.struct(F.col("_level").alias("level"), F.floor(F.col(at) / size).cast("bigint").alias("cell")))
    return tried.join(cut, [*keys, "_cell"]).drop("_cell", "_level")
