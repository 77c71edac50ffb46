"""Piecewise maps as tables: map columns, then `source` and `target`, one row an entry. Sources of a map differ unless said."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.kernels import rift
from tessera.operators.ordered import LEVELS, WIDTH, as_of, in_ranges, neighbour


def offsets(entries: DataFrame) -> DataFrame:
    return entries.withColumn("offset", F.col("target") - F.col("source"))


def last_offsets(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry's offset of each map."""
    return offsets(entries).groupBy(*keys).agg(F.max_by("offset", "source").alias("last_offset"))


def lookup(probes: DataFrame, entries: DataFrame, keys: list[str], at: str, rule: str, width: int = WIDTH) -> DataFrame:
    """lookups() by one rule, as `offset`."""
    return lookups(probes, entries, keys, at, {"offset": rule}, width)


def lookups(probes: DataFrame, entries: DataFrame, keys: list[str], at: str, rules: dict[str, str], width: int = WIDTH) -> DataFrame:
    """probes with the map's offset at each position, a column for each rule, from one lookup.

    Rules, for positions before the first source: "zero", "wrapping" (the last entry's offset), or "head" (as if an
    entry at 0 had the last offset, unless one is there; what is below it wraps). Without a map the offset is zero.
    """
    found = as_of(probes, offsets(entries), keys, at, "source", "offset", width)
    if any(rule != "zero" for rule in rules.values()):
        found = found.join(last_offsets(entries, keys), keys, "left")
    else:
        found = found.withColumn("last_offset", F.lit(None).cast("bigint"))
    each = {name: F.coalesce("offset", F.lit(0)) if rule == "zero" else F.coalesce("offset", "last_offset", F.lit(0)) for name, rule in rules.items()}
    own = [c for c in probes.columns if c not in rules]
    return found.select(*own, *(column.alias(name) for name, column in each.items()))


def collapsed(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Without entries that repeat the offset of the one before."""
    rows = neighbour(offsets(entries), keys, "source", "offset", "_before", after=False)
    return rows.filter(F.col("_before").isNull() | (F.col("_before") != F.col("offset"))).drop("_before", "offset")


def shortened(entries: DataFrame, keys: list[str]) -> DataFrame:
    """collapsed(), and by wrapping: a map of one entry moves all by it, or is none if it moves nothing; a first entry of the last's offset goes."""
    rows = offsets(collapsed(entries, keys))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("source").alias("_first"), F.min_by("offset", "source").alias("_a"), F.max_by("offset", "source").alias("_z"))
    rows = rows.join(ends, keys)
    one = F.col("_n") == 1
    kept = rows.filter(F.when(one, F.col("offset") != 0).otherwise((F.col("source") != F.col("_first")) | (F.col("_a") != F.col("_z"))))
    return kept.select(*keys, F.when(one, 0).otherwise(F.col("source")).cast("bigint").alias("source"), F.when(one, F.col("offset")).otherwise(F.col("target")).alias("target"))


def total(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both maps' offsets added at the breaks of either; breaks that change nothing go, unless a map is alone."""
    breaks = a.select(*keys, "source").union(b.select(*keys, "source")).distinct()
    found = lookup(breaks, a, keys, "source", "wrapping").withColumnRenamed("offset", "_a")
    found = lookup(found, b, keys, "source", "wrapping").withColumnRenamed("offset", "_b")
    both = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys).withColumn("_both", F.lit(True))
    found = found.join(both, keys, "left").withColumn("offset", F.col("_a") + F.col("_b"))
    kept = neighbour(found, keys, "source", "offset", "_before", after=False).filter(F.col("_both").isNull() | F.col("_before").isNull() | (F.col("_before") != F.col("offset")))
    return kept.select(*keys, "source", (F.col("source") + F.col("offset")).alias("target"))


def compose(first: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """The map that moves by `first`, then by `then`, from first's lowest source on.

    Below that the map wraps around the 64-bit range, which compose() of the kernels does.
    """
    pieces = neighbour(offsets(first), keys, "source", "source", "_end")
    images = pieces.select(*keys, "offset", (F.col("source") + 1 + F.col("offset")).alias("low"), F.coalesce(F.col("_end") + F.col("offset"), F.lit(1 << LEVELS)).alias("high"))
    cuts = in_ranges(then.select(*keys, F.col("source").alias("_break")), images, keys, "_break", "low", "high")
    cuts = cuts.select(*keys, (F.col("_break") - F.col("_r_offset")).alias("source"), F.col("_r_offset").alias("offset"))
    places = pieces.select(*keys, "source", "offset").unionByName(cuts).distinct()
    places = places.withColumnRenamed("offset", "_first").withColumn("_image", F.col("source") + F.col("_first"))
    found = lookup(places, then, keys, "_image", "wrapping")
    return found.select(*keys, "source", (F.col("_image") + F.col("offset")).alias("target"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of both; those of equal source stay."""
    return a.unionByName(b)


def moved(entries: DataFrame, by: Column) -> DataFrame:
    return entries.withColumn("source", F.col("source") + by)


def unset_vector(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Entries from 0 to n - 1 without a target."""
    rows = counts.select(*keys, F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))).alias("source"))
    return rows.select(*keys, F.col("source").cast("bigint").alias("source"), F.lit(None).cast("bigint").alias("target"))


def set_entries(vector: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Targets of updates where they are set and the vector has the source."""
    new = updates.select(*keys, "source", F.col("target").alias("_new"))
    return vector.join(new, [*keys, "source"], "left").withColumn("target", F.coalesce("_new", "target")).drop("_new")


def per_map(entries: DataFrame, keys: list[str], f, order: str = "ord") -> DataFrame:
    """f(list of entries) for each map, by the kernels; entries come sorted by source, then by a column."""
    schema = ", ".join(f"{k} {entries.schema[k].dataType.simpleString()}" for k in keys) + ", source bigint, target bigint"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["source"].to_pylist(), table[order].to_pylist(), table["target"].to_pylist(), strict=True), key=lambda r: r[:2])
        found = f([(s, rift.UNSET if t is None else t) for s, _, t in rows])
        columns = {k: pa.array([v.as_py()] * len(found), v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(columns | {"source": pa.array([s for s, _ in found], pa.int64()), "target": pa.array([t for _, t in found], pa.int64())})

    return entries.select(*keys, "source", "target", order).groupBy(*keys).applyInArrow(run, schema)


def reduced(entries: DataFrame, keys: list[str], drop_unset: bool, order: str = "ord") -> DataFrame:
    """One entry a source by vote, then shortened(). Votes depend on the order of a source's entries: a target that differs from the
    one that leads takes one from its lead, and leads itself once there is none. Entries without a target before the first
    that has one are dropped, if so asked; others vote as rift.UNSET. A list is one source's entries of one map."""
    entry = F.struct(F.col(order).alias("o"), F.coalesce("target", F.lit(rift.UNSET)).alias("t"))
    votes = entries.groupBy(*keys, "source").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]).alias("all"))
    if drop_unset:
        first = F.array_position(F.transform("all", lambda t: t != rift.UNSET), True)
        votes = votes.filter(first > 0).withColumn("all", F.slice("all", first.cast("int"), F.size("all")))
    state = lambda kept, lead: F.struct(kept.alias("kept"), lead.cast("int").alias("lead"))

    def step(s: Column, t: Column) -> Column:
        return F.when(s["kept"] == t, state(t, s["lead"] + 1)).when(s["lead"] > 0, state(s["kept"], s["lead"] - 1)).otherwise(state(t, F.lit(1)))

    kept = F.aggregate("all", state(F.element_at("all", 1), F.lit(0)), step)["kept"]
    return shortened(votes.select(*keys, "source", kept.alias("target")), keys)


def inverse(entries: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    return per_map(entries, keys, rift.inverse, order)


def offsets_to_rvas(sections: DataFrame, keys: list[str]) -> DataFrame:
    """From file offsets to addresses, by section, led by (0, 0)."""
    rows = sections.filter("va <> 0 and raw <> 0").select(*keys, F.col("raw").cast("bigint").alias("source"), F.col("va").cast("bigint").alias("target"))
    return _with_zero(sections, rows, keys)


def section_map(sections: DataFrame, keys: list[str]) -> DataFrame:
    """From addresses to file offsets, led by (0, 0); of equal addresses the first section's."""
    rows = sections.filter("va <> 0 and raw <> 0").groupBy(*keys, F.col("va").cast("bigint").alias("source")).agg(F.min_by("raw", "ord").cast("bigint").alias("target"))
    return _with_zero(sections, rows, keys)


def _with_zero(sections: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    zero = sections.select(*keys).distinct() if keys else sections.sparkSession.range(1).select()
    return rows.unionByName(zero.select(*keys, F.lit(0).cast("bigint").alias("source"), F.lit(0).cast("bigint").alias("target")))
