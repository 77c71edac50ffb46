"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Binary rows can be large: so many to an Arrow batch.
BATCH_ROWS = 64


def get_spark(app: str = "tessera", **config: str) -> SparkSession:
    """A session with adaptive execution and bounded Arrow batches. ANSI mode stays on."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (settings | config).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for what is planned from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) != str(rows):
        spark.conf.set(key, str(rows))
