"""Helpers shared by the training-data operators: scratch tables, Arrow maps, shared files."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session, whose
    executors are the driver, has a temporary one; a cluster is refused, as its executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str, scope: str = "op") -> str:
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    _MADE.setdefault(f"{spark.sparkContext.applicationId}/{scope}", []).append(path)
    return path


def store(df: DataFrame, tag: str, scope: str = "op", **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag, scope)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scope: str = "op") -> None:
    """Delete the scratch tables of a scope. Call it once what was made from them is written elsewhere."""
    for path in _MADE.pop(f"{spark.sparkContext.applicationId}/{scope}", []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows that a step of an Arrow map works on at once. Spark bounds a batch by its own rows and bytes; steps are slices of it.
STEP_ROWS = 512


def give_back() -> None:
    """Return free memory to the system, at the end of a task: workers are kept, and wait beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, without empty ones. No session setting is touched."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object] | pa.RecordBatch | None]], rows: int = STEP_ROWS) -> DataFrame:
    """Run make() once a task and its result on every slice of a batch; dicts of columns become batches of the schema."""
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in steps(batches, rows):
            out = step(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in fields], schema=fields)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def grouped_rows(rows: DataFrame, by: list[str], schema: str, make) -> DataFrame:
    """make() gives a step (a task each) to which the rows of a group come, in slices of batches, with whether the group begins.
    It returns tuples; called with None at the end. A group's rows are never held by Spark, only by the step."""
    fields = _arrow_schema(rows.sparkSession, schema)
    width = len(by)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = make(), None
        for batch in steps(batches):
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += step(row[:width] != last, row[width:])
                last = row[:width]
            if found:
                yield batch_of(found)
        if found := step(True, None):
            yield batch_of(found)

    return rows.mapInArrow(run, schema)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


@functools.lru_cache(maxsize=256)
def _fields(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return _fields(ddl)


#: Schemes that Hadoop and pyarrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str):
    """pyarrow's filesystem for a folder's URI, and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if not colon:
        return fs.FileSystem.from_uri("file://" + os.path.abspath(uri.removeprefix("file:")))
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def write_file(uri: str, name: str, chunks: list[bytes]) -> None:
    """Write one file of a shared folder whole, under a name of its own first, so that a lost task leaves no half file."""
    filesystem, folder = open_fs(uri)
    filesystem.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(temporary, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    filesystem.move(temporary, f"{folder}/{name}")


def filter_arrow(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]], rows: int = STEP_ROWS) -> DataFrame:
    """The rows of df, unchanged, for whose value of a column the test that make() returns says True."""
    at = [c.lower() for c in df.columns].index(column.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in steps(batches, rows):
            out = batch.filter(pa.array(test(batch.column(at).to_pylist()), pa.bool_()))
            if out.num_rows:
                yield out

    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # names may hold dots, which Arrow maps do not take
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
