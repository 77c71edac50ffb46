"""Delta jobs as rows: id, reference, and target or delta. One job a row, in parallel: in Spark's own processes, what these don't do in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jvm
from tessera.functions.kernels import functions
from tessera.session import bounded_batches


#: Bytes of rows that a task of the codecs takes on, and tasks per core at least.
TASK_BYTES, TASKS_PER_CORE = 16 << 20, 4


def spread(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """rows dealt evenly over enough tasks for work that takes far longer than reading: by the size of `like` (or rows), and by cores.

    The estimated size of a join is that of a product, so joined rows are sized by what they were joined from.
    """
    size = int(str((rows if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, min(size // TASK_BYTES, 1_000_000)))


def create(jobs: DataFrame, version: str = "PA30", options: str = "") -> DataFrame:
    """jobs with a `delta` from `reference` to `target`. options: words of md5, sha1, sha256, bsdiff, auto."""
    bounded_batches(jobs.sparkSession)
    if "auto" in options.split():
        return jobs.withColumn("delta", functions()["delta_create_with"]("reference", "target", F.lit(version), F.lit(options)))
    return jvm.encoded(jobs, "delta", "delta_create_with", "reference", "target", F.lit(version), F.lit(options))


def apply(jobs: DataFrame, column: str = "result") -> DataFrame:
    """jobs with the target of `reference` and `delta`; a bad delta fails the query."""
    bounded_batches(jobs.sparkSession)
    return jvm.decoded(jobs, column, "delta_apply", "reference", "delta")


def try_apply(jobs: DataFrame) -> DataFrame:
    """jobs with `result` and, where there is none, `error`."""
    bounded_batches(jobs.sparkSession)
    found = jobs.withColumn("_tried", functions()["try_delta_apply"]("reference", "delta"))
    return found.select(*jobs.columns, F.col("_tried.result").alias("result"), F.col("_tried.error").alias("error"))


def try_apply_into(jobs: DataFrame, room: Column) -> DataFrame:
    """try_apply() into buffers of so many bytes: targets that are larger are errors, and are not decoded."""
    bounded_batches(jobs.sparkSession)
    found = jobs.withColumn("_tried", functions()["try_delta_apply_into"]("reference", "delta", room))
    return found.select(*jobs.columns, F.col("_tried.result").alias("result"), F.col("_tried.error").alias("error"))


def apply_reverse(jobs: DataFrame) -> DataFrame:
    """jobs with the `result`, and a delta `reverse` back from it."""
    return jvm.encoded(apply(jobs), "reverse", "delta_create_with", "result", "reference", F.lit("PA30"), F.lit(""))


def info(deltas: DataFrame) -> DataFrame:
    """The header's fields of each `delta`, beside the other columns."""
    bounded_batches(deltas.sparkSession)
    rest = [c for c in deltas.columns if c != "delta"]
    return deltas.withColumn("_h", functions()["delta_header"]("delta")).select(*rest, "_h.*")


def with_neighbour(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs of related buffers out of one table: each row's value, and that of the row with the key before it (or none)."""
    own = docs.select(F.col(key), F.encode(F.coalesce(F.col(value), F.lit("")), "UTF-8").alias("target"))
    before = own.select((F.col(key) + 1).alias(key), F.col("target").alias("reference"))
    pairs = own.join(before, key, "left").select(key, F.coalesce("reference", F.lit(b"")).alias("reference"), "target")
    return pairs if jvm.available(docs.sparkSession) else spread(pairs, docs)  # as the join deals them out, unless the codecs are slow
