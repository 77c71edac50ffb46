"""Joins that pair rows of two tables one to one, or with the first match."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import in_ranges, neighbour, numbered

#: Ranges of which so many at most are sent to all executors and tried each.
BROADCAST_ROWS = 256
#: Hashes of grams that are sent to all executors at once (8 bytes each).
GRAM_HASHES = 4_000_000


def first_of_value(source: DataFrame, target: DataFrame, value: str, offset: str) -> DataFrame:
    """(source, target): each row's offset, and the lowest offset of the same value in target. Values are compared by SHA-256."""
    key = F.sha2(F.col(value).cast("string"), 256).alias("_key")
    first = target.select(key, F.col(offset).alias("_offset")).groupBy("_key").agg(F.min("_offset").alias("target"))
    return source.select(key, F.col(offset).alias("source")).join(first, "_key").select("source", "target")


def fifo(source: DataFrame, target: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(source, target): the k-th source row of a key with the k-th target row of it. Rows with a null in their key match none."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    a = numbered(source.filter(known).select(*keys, F.col(order).alias("source")), keys, "source")
    b = numbered(target.filter(known).select(*keys, F.col(order).alias("target")), keys, "target")
    return a.join(b, [*keys, "k"]).select("source", "target")


def first_match(source: DataFrame, target: DataFrame, names: list[str], order: str) -> DataFrame:
    """Each source row with the first target row of the same names; the target's columns get the prefix target_."""
    others = [c for c in target.columns if c not in names]
    best = target.groupBy(*names).agg(F.min_by(F.struct(*others), order).alias("_best"))
    joined = source.join(best, names)
    return joined.select(*source.columns, *(F.col("_best")[c].alias(f"target_{c}") for c in others))


def list_ranges(owners: DataFrame, rid: str, start: str, children: Column) -> DataFrame:
    """owners with `first` and `stop` of their lists: up to where the next owner's begins, or one past all children."""
    following, end = F.col("_following"), children + 1
    stop = F.when(following.isNull() | (following == 0) | (following > end), end).otherwise(following)
    return neighbour(owners, [], rid, start, "_following").select(*owners.columns, F.col(start).alias("first"), stop.alias("stop"))


def containing(probes: DataFrame, ranges: DataFrame, at: str, low: str, high: str, order: str) -> DataFrame:
    """Each probe with the first range, by order, that holds its position (high excluded); ranges' columns as a struct `range`.

    A few ranges are sent to all executors; more are met in the cells that make them up.
    """
    tagged = probes.withColumn("_probe", F.monotonically_increasing_id())
    row = F.struct(*ranges.columns).alias("_range")
    if ranges.count() <= BROADCAST_ROWS:
        held = F.broadcast(ranges.select(row, F.col(low).alias("_low"), F.col(high).alias("_high")))
        found = tagged.join(held, (F.col(at) >= F.col("_low")) & (F.col(at) < F.col("_high")), "left")
        best = found.groupBy("_probe", *probes.columns).agg(F.min_by("_range", F.col("_range")[order]).alias("range"))
        return best.drop("_probe")
    held = ranges.select(row, F.col(low).cast("bigint").alias("low"), F.col(high).cast("bigint").alias("high"))
    found = in_ranges(tagged.filter(F.col(at).isNotNull()).select("_probe", F.col(at).cast("bigint").alias("_at")), held, [], "_at", "low", "high")
    best = found.groupBy("_probe").agg(F.min_by("_r__range", F.col("_r__range")[order]).alias("range"))
    return tagged.join(best, "_probe", "left").drop("_probe")


def byte_histogram(rows: DataFrame, data: str) -> DataFrame:
    """(symbol, n): how often each byte occurs in a binary column, counted per batch, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(256, np.int64)
            for value in batch.column(0):
                if value.is_valid:
                    counts += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"symbol": pa.array(seen, pa.int32()), "n": pa.array(counts[seen], pa.int64())})

    return rows.select(data).mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def gram_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of the characters from each place on."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(points) - size + 1)
    found = np.zeros(n, np.uint64)
    for k in range(size):
        found = (found ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def shared_grams(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, item_id, shared): pairs of docs(doc_id, text) and items(item_id, text) with the distinct grams of characters that both have.

    Hashes of the items' grams tell which of a document's grams are looked at; those are joined by the characters
    themselves. Up to GRAM_HASHES are sent to all executors at once; beyond that, by parts of the hashes.
    """

    def cut(known: np.ndarray | None, part: int, parts: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hashes = gram_hashes(text, size)
                    use = hashes.view(np.int64) % parts == part
                    if known is not None and len(known):
                        use &= known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                    places, first = np.flatnonzero(use), {}
                    for i in places.tolist():
                        first.setdefault(text[i : i + size], int(hashes[i].view(np.int64)))
                    if first:
                        yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(first), pa.int64()), "hash": pa.array(list(first.values()), pa.int64()), "gram": pa.array(list(first), pa.string())})

        return run

    text = F.coalesce("text", F.lit("")).alias("text")
    schema = "key long, hash long, gram string"
    grams = items.select("item_id", text).mapInArrow(cut(None, 0, 1), schema).withColumnRenamed("key", "item_id").distinct()
    parts = -(-grams.select("hash").distinct().count() // GRAM_HASHES) or 1
    found = None
    for part in range(parts):
        own = grams.filter(F.pmod("hash", F.lit(parts)) == part)
        known = np.sort(np.array([r[0] for r in own.select("hash").distinct().collect()], np.int64).view(np.uint64))
        held = docs.select("doc_id", text).mapInArrow(cut(known, part, parts), schema) if len(known) else docs.select(F.col("doc_id").alias("key"), F.lit(0).cast("bigint").alias("hash"), F.lit("").alias("gram")).limit(0)
        pairs = held.select(F.col("key").alias("doc_id"), "gram").join(own.select("item_id", "gram"), "gram")
        pairs = pairs.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
        found = pairs if found is None else found.union(pairs)
    return found if parts == 1 else found.groupBy("doc_id", "item_id").agg(F.sum("shared").alias("shared"))


def by_sequence(source: DataFrame, target: DataFrame, owner: str, name: str, order: str) -> DataFrame:
    """(owner, source, target): within each owner, each child in order to the first unused one of its name.

    A source child that is mapped already (`mapped`, a column of source) ends its owner's list, as do all behind it.
    Rows of one owner and name are used one after another, so the k-th of them meets the k-th.
    """
    if "mapped" in source.columns:
        stop = source.filter("mapped").groupBy(owner).agg(F.min(order).alias("_stop"))
        source = source.join(stop, owner, "left").filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
    owners = source.select(F.col(order).alias("source"), F.col(owner))
    return fifo(source, target, [owner, name], order).join(owners, "source").select(F.col(owner).alias("owner"), "source", "target")
