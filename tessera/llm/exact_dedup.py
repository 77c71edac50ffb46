"""Exact dedup with a log-structured merge index of digests, in DataFrame operations only.

A memtable is one task's share of the input; it is flushed as a run: a Parquet file sorted by digest, with the row's
number. The runs' filter has a slot, a 64-bit hash, for each digest, and how many rows fell into it. Rows alone in their
slot are alone in their group: they are read once more, to be answered, but not merged. Compaction merges the others of all
runs into one level with, for each digest, the row that stays (most code points, then the smallest identifier, then the
first in the runs) and the group's size. Digests that more than one row has are hits; the bytes of every hit are
compared. Should different bytes share a digest, the index is built again with a wider key.

Nulls: a null text is the empty text; a null doc_id sorts after all others, so it stays only in a group without any other
id. Repeated rows count each, and of rows that share the identifier that stays, or have none, one is kept. An empty table
gives an empty result. Columns other than doc_id and text are not looked at. A text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import store, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"
#: Up to so many slots or digests of hits are sent to all executors (100 bytes each at most); more are joined by a shuffle.
BROADCAST_HITS = 200_000


def normalised(text: Column) -> Column:
    """The text without white space: what decides whether two rows are equal."""
    return F.regexp_replace(text, WHITE, "")


def _digest(norm: Column, wide: bool) -> Column:
    digest = F.unhex(F.sha2(norm, 256))
    return F.concat(digest, F.unhex(F.sha2(norm, 512))) if wide else digest


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_HITS else df


class DigestIndex:
    """Runs, their filter, and the compacted level of one table of (doc_id, text)."""

    def __init__(self, docs: DataFrame, wide: bool = False, scope: str = "op"):
        self.wide, self.scope = wide, scope
        self.docs = docs.select(F.col("doc_id"), text_or_empty().alias("text"))

    def flush(self) -> DataFrame:
        """Write the sorted runs: (digest, slot, n_chars, doc_id, row), one file a task."""
        rows = self.docs.select(
            _digest(normalised(F.col("text")), self.wide).alias("digest"),
            F.char_length("text").cast("long").alias("n_chars"),
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("slot", F.xxhash64("digest"))
        self.runs = store(rows.sortWithinPartitions("digest"), "lsm-run", self.scope)
        return self.runs

    def filter(self) -> DataFrame:
        """The slots that more than one row fell into; only numbers are shuffled for it."""
        slots = self.runs.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1").select("slot")
        self.slots = store(slots, "lsm-filter", self.scope)
        return self.slots

    def compact(self) -> DataFrame:
        """Merge what passes the filter: (digest, keep_id, keep_row, group_size) of the digests that more than one row has."""
        merged = self.runs.join(_small(self.slots), "slot", "left_semi")
        best = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
        level = merged.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
        level = level.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
        self.level = store(level.sortWithinPartitions("digest"), "lsm-level", self.scope)
        return self.level

    def collisions(self) -> DataFrame:
        """Digests that different bytes share: the least and the greatest bytes of each group of hits differ."""
        norm = self.docs.select(normalised(F.col("text")).alias("norm")).withColumn("digest", _digest(F.col("norm"), self.wide))
        hits = _small(self.level.select("digest"))
        extremes = norm.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        return extremes.filter(F.col("lo") != F.col("hi")).select("digest")

    def resolve(self) -> DataFrame:
        """One row a document: doc_id, keep_id, group_size, kept, digest."""
        found = self.runs.join(_small(self.level), "digest", "left")
        alone = F.col("group_size").isNull()
        return found.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
            "digest",
        )


def exact_duplicates(docs: DataFrame, scope: str = "op") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    for wide in (False, True):
        index = DigestIndex(docs, wide, scope)
        index.flush()
        index.filter()
        index.compact()
        if wide or index.collisions().isEmpty():
            break
    sha = F.lower(F.hex(F.substring("digest", 1, 32)))
    return index.resolve().select("doc_id", "keep_id", "group_size", "kept", sha.alias("text_sha256"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT doc_id, length(t) AS n_chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM d
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
