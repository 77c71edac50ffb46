"""Suites of generated test inputs, and the matrix of inputs and modes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.kernels import cases
from tessera.session import bounded_batches

CASE = "id string, category string, reference binary, target binary"
#: Name, version and options of create() for each mode.
MODES = (("raw", "PA30", ""), ("bsdiff", "PA30", "bsdiff"), ("md5", "PA30", "md5"), ("sha256", "PA30", "sha256"), ("pa31", "PA31", ""))


def suite(spark: SparkSession, seed: int, count: int, categories: tuple[str, ...] = tuple(cases.GENERATORS)) -> DataFrame:
    """Cases of all categories; those of one are made in one task, each category in its own."""
    bounded_batches(spark, 8)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for category in batch.column(0).to_pylist():
                for name, reference, target in cases.GENERATORS[category](seed, count):
                    yield pa.RecordBatch.from_pydict({"id": [name], "category": [category], "reference": pa.array([reference], pa.binary()), "target": pa.array([target], pa.binary())})

    names = spark.createDataFrame([(c,) for c in categories], "category string").repartition(len(categories), "category")
    return names.mapInArrow(make, CASE)


def matrix(inputs: DataFrame, modes: tuple[tuple[str, str, str], ...] = MODES) -> DataFrame:
    """Every input under every mode: id gets the mode's name; version and options are added."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("mode"), F.lit(v).alias("version"), F.lit(o).alias("options")) for n, v, o in modes)))
    rows = inputs.select("*", each.alias("_m"))
    return rows.select(F.concat_ws(".", "id", "_m.mode").alias("id"), *(c for c in inputs.columns if c != "id"), "_m.version", "_m.options")
