"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is found in a document if at least `threshold` of the item's distinct shingles of five words are
among the document's. Items are partitioned by their number of shingles (powers of two). In a partition of items
with up to n shingles, an item's sketch is k = floor((1 - threshold) * n) + 1 of its shingle hashes: those that the
fewest items have, the smallest of these first. An item that is contained lacks at most k - 1 shingles of any document,
so at least one sketch value is among the document's shingles: the search misses nothing, however long the document
is, and phrases that many items share are in few sketches. Candidates are verified by counting the item's shingles in
the document, word by word.

(Banded MinHash of whole documents, the usual form, would compare sets of very different size: an item of 30
shingles in a document of 5,000 has a Jaccard similarity below 0.01, which 128 hashes find less than half the time.)

How it runs: the sketches are a table. Documents are read once; those with a sketch value are stored with their values.
Up to BROADCAST_SKETCHES values are sent to the executors for that, as one sorted array; with more, all documents are
stored with all their values, and the join with the sketches, which follows anyway, tells which they have. A candidate's
items are brought to its document, not the other way round, so a document is in one place once.

Words are the runs of letters and digits of the lower-cased text. A text of fewer than five words has its whole
sequence as one shingle; one without words has none and is never found and finds nothing. Null texts are empty;
null ids are carried. Repeated rows, of either table, are each searched; items of one text are searched once and
reported each. An empty table of either kind finds nothing. Only the columns doc_id, item_id and text are read.
Documents of any length are whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, grouped_rows, map_arrow, store, text_or_empty

WORD = re.compile(r"[^\W_]+")
WIDTH, THRESHOLD = 5, 0.8
#: Up to so many sketch values are sent to all executors (8 bytes each); see above for more.
BROADCAST_SKETCHES = 4_000_000
#: Up to so many contaminated texts are sent to all executors (about 100 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 300_000
#: Hashes of words that a task keeps at hand.
CAPACITY = 500_000
SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """Hashes of words, kept for those seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CAPACITY:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode())
        return found

    def shingles(self, found: list[str], width: int) -> np.ndarray:
        """The different hashes of the words' shingles, sorted; the whole sequence has one if it is shorter."""
        own = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        n = max(len(own) - width + 1, min(1, len(own)))
        hashes = np.full(n, len(own[:width]), np.uint64)
        for k in range(min(width, len(own))):
            hashes = (hashes ^ own[k : k + n]) * _MULTIPLIER
            hashes ^= hashes >> np.uint64(29)
        return np.unique(hashes)


def shingles(found: list[str], width: int) -> set[tuple]:
    """The different shingles themselves."""
    if len(found) <= width:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(width))))


def _sketches(benchmark: DataFrame, width: int, threshold: float, scope: str) -> tuple[DataFrame, DataFrame]:
    """(hash, item) of the sketches, and (item, item_id, text) of all items; item tells texts apart."""
    items = benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("text"), F.sha2(text_or_empty(), 256).alias("item"))
    items = store(items, "leak-items", scope)

    def make():
        own = WordHashes()
        return lambda batch: {"item": batch.column(0), "hashes": [own.shingles(words(t), width).view(np.int64) for t in batch.column(1).to_pylist()]}

    texts = items.dropDuplicates(["item"]).select("item", "text")
    each = store(map_arrow(texts, "item string, hashes array<long>", make).select("item", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")), "leak-hashes", scope)
    shared = each.groupBy("hash").agg(F.count("*").alias("m")).filter("m > 1")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("m", F.lit(1)).alias("m"), "hash")))  # the shingles of one item
    partition = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    size = (F.floor((1 - F.lit(threshold)) * partition + 1e-9) + 1).cast("int")
    least = each.join(shared, "hash", "left").groupBy("item", "n").agg(order.alias("all")).select("item", F.explode(F.slice("all", F.lit(1), size)).alias("one"))
    return store(least.select(F.col("one.hash").alias("hash"), "item"), "leak-sketches", scope), items


def _with_values(docs: DataFrame, sketches: DataFrame, width: int, scope: str) -> DataFrame:
    """(row, doc_id, text, hashes) of the documents that could hold an item: one row each, stored."""
    values = sketches.select("hash").distinct()
    known = None
    if values.count() <= BROADCAST_SKETCHES:
        known = np.sort(np.array([r[0] for r in values.collect()], np.int64)).view(np.uint64)
        known = docs.sparkSession.sparkContext.broadcast(np.sort(known))

    def make():
        own, state = WordHashes(), [TaskContext.get().partitionId() << 40]
        wanted = None if known is None else known.value

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            found = [own.shingles(words(t), width) for t in batch.column(1).to_pylist()]
            if wanted is not None:
                found = [x[among(wanted, x)] for x in found]
            rows = np.arange(len(found)) + state[0]
            state[0] += len(found)
            use = np.array([len(x) > 0 for x in found])
            kept = pa.array(use)
            hashes = pa.array([x.view(np.int64) for x in found if len(x)], pa.list_(pa.int64()))
            return {"row": rows[use], "doc_id": batch.column(0).filter(kept), "text": batch.column(1).filter(kept), "hashes": hashes}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    return store(map_arrow(rows, "row long, doc_id long, text string, hashes array<long>", make), "leak-docs", scope)


def among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _found(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float, scope: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, item, n, found) of rows and item texts in them; the rows (row, doc_id, text); the items (item, item_id, text)."""
    sketches, items = _sketches(benchmark, width, threshold, scope)
    rows = _with_values(docs, sketches, width, scope)
    pairs = rows.select("row", F.explode("hashes").alias("hash")).join(sketches, "hash").select("row", "item").distinct()
    pairs = store(pairs, "leak-pairs", scope)
    texts = items.dropDuplicates(["item"]).select("item", "text")
    own = rows.select("row", F.lit(None).cast("string").alias("item"), "text").join(pairs.select("row").distinct(), "row", "left_semi")
    both = own.unionByName(pairs.join(texts, "item").select("row", "item", "text"))
    both = both.repartition("row").sortWithinPartitions("row", F.col("item").isNotNull())

    def make():
        state: list[set] = [set()]

        def step(begins: bool, row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            item, text = row[1:]
            mine = shingles(words(text), width)
            if begins:
                state[0] = mine
                return []
            n = len(mine & state[0])
            return [(row[0], item, len(mine), n)] if n >= threshold * len(mine) - 1e-9 else []

        return step

    placed = both.select(F.col("row").alias("of"), "row", "item", "text")
    return store(grouped_rows(placed, ["of"], "row long, item string, n long, found long", make), "leak-found", scope), rows, items


def find_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, scope: str = "op") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for all pairs of a document and an item in it."""
    found, rows, items = _found(docs, benchmark, width, threshold, scope)
    named = found.join(rows.select("row", "doc_id"), "row").join(items.select("item", "item_id"), "item")
    return named.select("doc_id", "item_id", F.col("n").alias("n_shingles"), F.col("found").alias("n_found"), (F.col("found") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, scope: str = "op") -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    found, rows, _ = _found(docs, benchmark, width, threshold, scope)
    bad = rows.join(found.select("row").distinct(), "row", "left_semi").select(F.sha2("text", 256).alias("bad")).distinct()
    bad = store(bad, "leak-texts", scope)
    if bad.count() <= BROADCAST_TEXTS:
        bad = F.broadcast(bad)
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(text_or_empty(), 256))
    return keyed.join(bad, keyed[key] == bad["bad"], "left_anti").select(*(F.col(f"`{n}`") for n in docs.columns))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), iw AS (
  SELECT row_number() OVER () AS row_id, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)
), its AS (
  SELECT DISTINCT row_id, item_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT row_id, item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), n AS (
  SELECT row_id, count(*) AS n_shingles FROM its GROUP BY row_id
), f AS (
  SELECT doc_id, row_id, any_value(item_id) AS item_id, count(*) AS n_found
  FROM its JOIN ds USING (s) GROUP BY doc_id, row_id
)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment
FROM f JOIN n USING (row_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""
