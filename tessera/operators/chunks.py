"""Chunked containers as tables: an index of chunks, and the bytes of ranges out of the chunks that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.kernels import containers
from tessera.session import bounded_batches

CHUNK = "key long, chunk int, stored long, plain long, data binary"


def chunked(buffers: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, chunk, plain): each buffer's pieces of a size; none for an empty one."""
    n = F.octet_length(data)
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    rows = buffers.select(F.col(key), F.col(data).alias("_data"), F.explode(numbers).alias("chunk"))
    return rows.select(key, "chunk", F.substring("_data", F.col("chunk") * size + 1, F.lit(size)).alias("plain"))


def chunk_index(lengths: DataFrame, key: str, chunk: str, stored: str, start: int = 0) -> DataFrame:
    """lengths with `on_disk`, where each chunk begins: the sum of those before it."""
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("on_disk", F.lit(start) + F.coalesce(F.sum(stored).over(before), F.lit(0)))


def solid_chunks(resources: DataFrame, key: str, data: str) -> DataFrame:
    """One row a chunk of solid resources, still packed, so that they unpack in parallel."""
    bounded_batches(resources.sparkSession, 8)
    types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                layout = containers.SolidLayout.parse(raw)
                numbers = range(len(layout.stored))
                pieces = [raw[at : at + n] for at, n in zip(layout.offsets(), layout.stored, strict=True)]
                columns = [[k] * len(numbers), numbers, layout.stored, [layout.plain(number) for number in numbers], pieces]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "chunk", "stored", "plain", "data"])

    return resources.select(F.col(key).cast("long"), data).mapInArrow(run, CHUNK)


def reassembled(chunks: DataFrame, key: str, data: str) -> DataFrame:
    """(key, data): chunks of a buffer one after another."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.hex(data).alias("hex"))))
    return chunks.groupBy(key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), "")).alias(data))
