"""Delta jobs that arrive as a stream: headers and targets of files as they land. Every job stands alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.kernels import functions
from tessera.session import bounded_batches

JOB = "id string, reference binary, delta binary"


def job_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Jobs (id, reference, delta) out of Parquet files that land in a folder."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def applied(jobs: DataFrame) -> DataFrame:
    """id, version, result and error of each job, streamed or not."""
    bounded_batches(jobs.sparkSession)
    f = functions()
    rows = jobs.withColumn("_h", f["try_delta_header"]("delta")).withColumn("_r", f["try_delta_apply"]("reference", "delta"))
    return rows.select("id", F.col("_h.result.version").alias("version"), F.col("_r.result").alias("result"), F.coalesce("_h.error", "_r.error").alias("error"))
