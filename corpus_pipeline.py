"""A training corpus from raw documents: quality, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage's result is to be written as Parquet, and the next stage reads that: a stage deletes the scratch tables of
the one before it.

All stages alike: null texts are empty texts; null ids, sources and other values are carried; columns of any other
name, also of names that stages use themselves, are kept as they are; an empty table gives an empty result; long texts
are whole. Rows of one doc_id (or none) and one text are copies like any others to the dedup stages, which keep one row
of each group; the other stages treat each row by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, release, store, text_or_empty
from tessera.llm.decontam import drop_contaminated
from tessera.llm.exact_dedup import exact_duplicates, normalised
from tessera.llm.near import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import fit_quality, keep_quality

#: Up to so many dropped rows are sent to all executors (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DROPPED = 300_000


def _without(docs: DataFrame, found: DataFrame, key: F.Column, scope: str) -> DataFrame:
    """docs without the rows whose doc_id and key are in found(id, key, kept) as not kept; of rows that share a kept id and key, one stays."""
    same_key = found.groupBy("id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    dropped = store(same_key.filter(~F.col("kept") | (F.col("n") > 1)).select("id", "key", "kept"), "dropped", scope)
    if dropped.count() <= BROADCAST_DROPPED:
        dropped = F.broadcast(dropped)
    names = [F.col(f"`{n}`") for n in docs.columns]
    row_key = free_name(docs, "row_key")
    keyed = docs.withColumn(row_key, key)
    same = reduce(lambda a, b: a & b, (keyed["doc_id"].eqNullSafe(dropped["id"]), keyed[row_key] == dropped["key"]))
    rest = keyed.join(dropped, same, "left_anti").select(*names)
    repeated = dropped.filter("kept")
    if repeated.isEmpty():
        return rest
    longest = F.struct(-F.char_length(text_or_empty()), text_or_empty())
    one = keyed.join(repeated, same, "left_semi").groupBy("doc_id", row_key).agg(F.min_by(F.struct(*names), longest).alias("one_row"))
    return rest.union(one.select(*(F.col("one_row")[n].alias(n) for n in docs.columns)))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Without a model none is rejected."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "pipeline-quality")
    return docs if model is None else keep_quality(docs, model)


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one of the smallest id."""
    release(spark, "pipeline-quality")
    found = exact_duplicates(docs, "pipeline-exact")
    found = found.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "kept")
    return _without(docs, found, F.sha2(normalised(text_or_empty()), 256), "pipeline-exact")


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id: shingles of five words, similarity of 0.8."""
    release(spark, "pipeline-exact")
    found = near_duplicates(docs, scope="pipeline-near")
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("key"), "kept")
    return _without(docs, found, F.xxhash64(text_or_empty()), "pipeline-near")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    release(spark, "pipeline-near")
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scope="pipeline-leaks")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    release(spark, "pipeline-leaks")
    return pack(docs, scope="pipeline-pack")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}", f"pipeline-out-{k}")
        release(spark, f"pipeline-out-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier cannot be expressed in SQL, nor can token ids.
ORACLE_SQL = None
