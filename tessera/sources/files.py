"""Files as rows: whole binary files, and the JSON documents of test jobs and results."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_VERSION = 1
CASE = (
    "struct<id:string,category:string,reference:string,target:string,ours_delta:string,target_sha256:string,target_len:bigint,reference_sha256:string,reverse_delta:string,"
    "native:struct<file_type_set:bigint,set_flags:bigint,reset_flags:bigint,hash_alg:bigint>,directions:array<string>>"
)
JOB = f"schema_version int, domain string, seed decimal(20,0), cases array<{CASE}>"
DIRECTIONS = ("ours_to_native", "native_to_ours", "native_to_native", "ours_to_ours", "reverse_round_trip")
VERDICT = "struct<status:string,got_sha:string,got_len:bigint,gold:string,gold_len:bigint,message:string>"
RESULT = f"dll string, domain string, seed decimal(20,0), results array<struct<id:string,{','.join(f'{d}:{VERDICT}' for d in DIRECTIONS)}>>"


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and content of every file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def write_files(rows: DataFrame, folder: str, name: str = "path", data: str = "content") -> DataFrame:
    """Write each row's bytes as one file of a shared folder, by the last part of its name; give (name, size, sha256) of what was written.

    A file is written whole under another name first, so a task that is lost leaves none half written. Rows of one
    name write the same file, the last of them counts. Runs when the result is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        filesystem, top = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
        filesystem.create_dir(top, recursive=True)
        for batch in batches:
            found = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is None or content is None:
                    continue
                own = path.rstrip("/").rpartition("/")[2]
                partial = f"{top}/.{own}.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(partial, compression=None) as out:
                    out.write(content)
                filesystem.move(partial, f"{top}/{own}")
                found.append((own, len(content), hashlib.sha256(content).hexdigest()))
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("name", "size", "sha256"), (list(c) for c in zip(*found, strict=True)), strict=True)))

    return rows.select(name, data).mapInArrow(run, "name string, size long, sha256 string")


def cached_base(spark: SparkSession, cache: str, base: bytes | None = None) -> bytes:
    """The base manifest of a cache folder, where files are named by the first 8 bytes of their SHA-256; one that is given is put there.

    Several cached bases are an error unless one is given, and so are a missing one and bytes that their name does not fit.
    """
    if base is not None:
        named = spark.createDataFrame([(f"{hashlib.sha256(base).hexdigest()[:16]}.bin", bytearray(base))], "path string, content binary")
        write_files(named, cache).collect()
        return base
    found = binary_files(spark, cache, "*.bin").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{cache}: {'several bases' if found else 'no base'} cached")
    content = bytes(found[0].content)
    if not found[0].path.endswith(f"/{hashlib.sha256(content).hexdigest()[:16]}.bin"):
        raise ValueError(f"{found[0].path}: not the bytes that it is named by")
    return content


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents by path; a byte-order mark before them is passed over."""
    text = spark.read.option("wholetext", True).text(path)
    plain = F.regexp_replace("value", "^﻿", "")
    return text.select(F.from_json(plain, schema).alias("d")).select("d.*")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of the job documents; documents of another version fail the query."""
    jobs = _documents(spark, path, JOB)
    right = F.when(F.col("schema_version") == JOB_VERSION, F.lit(True)).otherwise(F.raise_error(F.lit("job document of another schema version")))
    rows = jobs.filter(right).select("domain", "seed", F.posexplode("cases").alias("ord", "c")).select("domain", "seed", "ord", "c.*")
    return rows.withColumn("reference_sha256", F.coalesce("reference_sha256", F.lit("")))


def write_jobs(cases: DataFrame, path: str, domain: str, seed: int) -> None:
    """One job document of all cases; meant for the bounded suites of test runs."""
    columns = cases.select(F.struct(*cases.columns).alias("c"))
    document = columns.agg(F.collect_list("c").alias("cases")).select(F.lit(JOB_VERSION).alias("schema_version"), F.lit(domain).alias("domain"), F.lit(seed).cast("decimal(20,0)").alias("seed"), "cases")
    document.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_cases(cases: DataFrame, folder: str, domain: str, seed: int) -> DataFrame:
    """cases(id, category, reference, target) as files of a folder, named by their digests, and one job document that names them."""
    digest = lambda c: F.concat(F.sha2(c, 256), F.lit(".bin"))
    rows = cases.select(F.explode(F.array("reference", "target")).alias("content")).select(digest("content").alias("path"), "content")
    write_files(rows, f"{folder}/files").count()
    named = cases.select("id", "category", digest("reference").alias("reference"), digest("target").alias("target"), F.sha2("target", 256).alias("target_sha256"), F.octet_length("target").cast("bigint").alias("target_len"), F.sha2("reference", 256).alias("reference_sha256"))
    write_jobs(named, f"{folder}/job", domain, seed)
    return read_jobs(cases.sparkSession, f"{folder}/job")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """dll, domain, seed, id, direction and the fields of each verdict that a result document has."""
    rows = _documents(spark, path, RESULT).select("dll", "domain", "seed", F.explode("results").alias("r"))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.col(f"r.{d}").alias("v")) for d in DIRECTIONS)))
    return rows.select("dll", "domain", "seed", "r.id", each.alias("e")).select("dll", "domain", "seed", "id", "e.direction", "e.v.*")
