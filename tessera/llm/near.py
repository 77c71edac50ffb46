"""Near duplicates by the similarity of shingle sets, found over SimHash and least-hash keys and verified exactly.

Documents are near duplicates if the sets of their word shingles (of five words, see simhash.py) have a Jaccard
similarity of at least 0.8; a group is what such links connect. Documents of one set are one node from the start.

Keys of a node are the Golay keys of its fingerprint (simhash.search_keys: fingerprints within two bits share one),
and, as fingerprints at a similarity of 0.8 differ in ten bits on average, the least hash of its set in each of eight
classes of hashes: a pair at 0.8 shares none with probability 0.2 ** 8. All nodes with one key are a bucket.

1. Stars: each node of a bucket is compared with the bucket's first node. Most buckets hold one group, and this
   connects it, so work and rows are in proportion to the bucket's size.
2. Buckets of a least hash whose nodes are not all connected then are compared wholly, but for pairs connected already.
   Up to BLOCK_ROWS nodes meet in one place. Larger buckets are split by further least hashes, BANDS keys of BAND_ROWS
   of them (a pair at 0.8 shares none with probability (1 - 0.8 ** BAND_ROWS) ** BANDS, three in a million), again and
   again while that gives fewer rows: unlike texts that share a passage part at once. A node has these keys once, however
   many of the buckets it is in, so they are at most BANDS rows a node. Others are compared in blocks: the
   nodes outside the bucket's largest connected part visit all blocks of the bucket. Where those nodes fit into one place
   (a large group of copies, with texts close to it but not of it) this is at most twice the bucket's rows, so it is not
   split. No bucket is capped and no pair of a bucket is passed over.

Every comparison is of whole sets, exact; only pairs whose sizes or shared shingles cannot reach the similarity are
left out.

Null texts are empty; texts without words have one set, so they are one group. Null doc_ids are carried: a group's
component_id is null only if it has no other. Repeated rows are rows of one group each. An empty table gives no rows.
Only the columns doc_id and text are read, whatever others are called. Long texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import grouped_rows, map_arrow, store, text_or_empty
from tessera.llm.components import components
from tessera.llm.simhash import fingerprint, search_keys, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Classes of shingle hashes whose least are keys.
CLASSES = 8
#: Further least hashes: keys of a node and hashes to a key.
BANDS, BAND_ROWS = 18, 3
#: Nodes and bytes of sets that meet in one place.
BLOCK_ROWS, BLOCK_BYTES = 1024, 32 << 20
#: Up to so many rows that say which texts are needed are sent to all executors (at most 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 300_000
ROWS = "id long, doc_id long, text_hash long, digest binary, n int, classes array<long>, golay array<long>, text string"
MIX = np.uint64(0x9E3779B97F4A7C15)


# --- Sets ---------------------------------------------------------------------------------------------------


def shingle_set(text: str, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a text without words has the hash zero."""
    rows = shingle_hashes(text, width)
    return np.unique(rows.view(">u8").ravel().astype(np.uint64)) if len(rows) else np.zeros(1, np.uint64)


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sets without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def least_of_classes(hashes: np.ndarray, classes: int) -> list[int]:
    """The least of the sorted hashes in each class that has one, with the class in its low bits."""
    kind = (hashes & np.uint64(classes - 1)).astype(np.int64)
    present, first = np.unique(kind, return_index=True)  # hashes are sorted, so the first is the least
    return ((hashes[first] & ~np.uint64(classes - 1)) | present.astype(np.uint64)).view(np.int64).tolist()


def band_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    """BANDS keys, each of the least hashes of the set in BAND_ROWS orders of its own; every level has other orders."""
    keys = np.empty(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        order = np.uint64(level * BANDS * BAND_ROWS)
        for band in range(BANDS):
            key = np.uint64(band)
            for _ in range(BAND_ROWS):
                order += np.uint64(1)
                mixed = (hashes ^ (order * MIX)) * np.uint64(0xBF58476D1CE4E5B9)
                key = (key ^ (mixed ^ (mixed >> np.uint64(31))).min()) * MIX
            keys[band] = key ^ (key >> np.uint64(29))
    return keys.view(np.int64)


def _rows(docs: DataFrame, width: int, scope: str) -> DataFrame:
    """One row a document with its keys and text, stored. id tells rows apart; digest tells sets apart."""

    def make():
        state = [TaskContext.get().partitionId() << 40]

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            digests, sizes, classes, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text, width)
                prints.append(fingerprint(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)))  # of the set, whatever repeats
                sizes.append(len(hashes))
                classes.append(least_of_classes(hashes, CLASSES))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            keys, owners = search_keys(np.array(prints, np.int64))
            order = np.argsort(owners, kind="stable")
            ends = np.cumsum(np.bincount(owners, minlength=len(prints)))
            golay = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys[order], pa.int64()))
            ids = np.arange(len(prints)) + state[0]
            state[0] += len(prints)
            own = {"id": ids, "doc_id": batch.column(0), "text_hash": batch.column(2), "text": batch.column(1)}
            return own | {"digest": digests, "n": sizes, "classes": classes, "golay": golay}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty(), F.xxhash64(text_or_empty()))
    return store(map_arrow(rows, ROWS, make), "near-rows", scope)


# --- Groups of rows that meet in one place ------------------------------------------------------------------


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_texts(members: DataFrame, texts: DataFrame) -> DataFrame:
    return texts.join(_small(members), "id")


# --- Stars --------------------------------------------------------------------------------------------------


def _stars(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, scope: str) -> DataFrame:
    """Links (a, b) of nodes and the first node of a bucket that they are in, verified."""
    keys = nodes.select("id", "n", F.explode(F.concat("classes", "golay")).alias("key"))
    first = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("first")).filter("m > 1")
    pairs = keys.join(first, "key").filter((F.col("id") != F.col("first.id")) & _sizes_allow(F.col("n"), F.col("first.n"), similarity))
    pairs = store(pairs.select(F.col("first.id").alias("star"), "id").distinct(), "near-stars", scope)
    sizes = store(pairs.groupBy("star").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "near-star-sizes", scope)
    own = pairs.join(sizes, "star").select("star", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id")
    every = sizes.select("star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("star").alias("id"))
    members = store(own.union(every), "near-star-members", scope)
    placed = _with_texts(members, texts).select("star", "block", "id", "text")
    placed = placed.repartition("star", "block").sortWithinPartitions("star", "block", F.col("id") != F.col("star"))

    def make():
        state = [None]

        def step(begins: bool, row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            own = shingle_set(row[1], width)
            if begins:
                state[:] = [row[0], own]
                return []
            return [(state[0], row[0])] if set_similarity(state[1], own) >= similarity else []

        return step

    return store(grouped_rows(placed, ["star", "block"], "a long, b long", make), "near-star-links", scope)


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= similarity


# --- Buckets that are not connected -------------------------------------------------------------------------


def _mixed(rows: DataFrame, least: int = 2) -> DataFrame:
    """key, m, other (nodes outside the largest connected part), main (that part), blocks and chunks (places that all, or the others, fill) of the
    buckets in rows(key, id, n, label) with more than one label and `least` nodes: stars have compared the two of a least hash, not those of parts."""
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("part"), F.sum("n").alias("n"))
    sizes = parts.groupBy("key").agg(
        F.sum("part").alias("m"), (F.sum("n") * 8).alias("bytes"), (F.sum("part") - F.max("part")).alias("other"), F.max_by("label", F.struct("part", "label")).alias("main")
    )
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    chunks = F.ceil(F.greatest(F.col("other") / BLOCK_ROWS, F.col("other") / F.col("m") * F.col("bytes") / BLOCK_BYTES)).cast("int")
    return sizes.filter((F.col("other") > 0) & (F.col("m") >= least)).select("key", "m", "other", "main", blocks.alias("blocks"), chunks.alias("chunks"))


#: Rows that meet if the nodes outside the largest part visit all blocks; buckets for which that can be more than twice their rows.
_WORK = "if(blocks = 1, m, m * chunks + other * blocks)"
_SPLIT = "blocks > 1 and chunks > 1"


def _work(sizes: DataFrame) -> int:
    return sizes.agg(F.sum(F.expr(_WORK))).first()[0] or 0


def _split(rows: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, level: int, scope: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(key, id, n, label) of the parts, by further hashes, of the buckets that these split to less work, the parts' sizes, and the keys of
    those buckets. A node has its keys once, however many of the buckets it is in: nodes of one bucket that share a key meet there."""
    whole = sizes.filter(_SPLIT)
    large = store(rows.join(whole.select("key"), "key", "left_semi"), "near-large", scope)
    wanted = store(large.groupBy("id", "n", "label").agg(F.count("*").alias("times")), "near-wanted", scope)

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            own = dict(zip(("id", "n", "label", "times"), batch.columns, strict=False))
            return own | {"band": [band_keys(shingle_set(t, width), level).tolist() for t in batch.column(4).to_pylist()]}

        return step

    bands = map_arrow(_with_texts(wanted, texts).select("id", "n", "label", "times", "text"), "id long, n int, label long, times long, band array<long>", make)
    fine = store(bands.select("id", "n", "label", "times", F.explode("band").alias("key")), "near-fine", scope)
    parts = store(_mixed(fine), "near-fine-sizes", scope)
    # A part's work is due from its nodes, and a node's from the buckets that it is in, in equal shares.
    due = fine.join(parts.select("key", (F.expr(_WORK) / F.col("m")).alias("due")), "key").groupBy("id").agg((F.sum("due") / F.first("times")).alias("due"))
    due = large.join(due, "id").groupBy("key").agg(F.sum("due").alias("due"))
    better = whole.join(due, "key", "left").filter(F.coalesce("due", F.lit(0)) < F.expr(_WORK))
    better = store(better.select(*whole.columns), "near-better", scope)
    kept = fine.join(parts.select("key"), "key", "left_semi")
    kept = kept.join(_small(large.join(better, "key", "left_semi").select("id").distinct()), "id", "left_semi")
    kept = store(kept.select("key", "id", "n", "label"), "near-kept", scope)
    parts = store(_mixed(kept), "near-kept-sizes", scope)
    return (kept, parts, better.select("key")) if _work(parts) < _work(better) else None


def _meetings(nodes: DataFrame, texts: DataFrame, width: int, scope: str) -> DataFrame:
    """(key, block, chunk, visits, id, label): who meets where. Without visitors all in a place meet, else visitors and the others."""
    rows = nodes.select("id", "n", "label", F.explode("classes").alias("key"))
    sizes = store(_mixed(rows, 3), "near-mixed", scope)
    rows = store(rows.join(sizes.select("key"), "key", "left_semi"), "near-rows-mixed", scope)
    found, level = [], 0
    while True:
        if sizes.filter(_SPLIT).isEmpty():
            found.append((rows, sizes))
            break
        split = _split(rows, sizes, texts, width, level, scope)
        if split is None:
            found.append((rows, sizes))
            break
        fine, parts, better = split
        found.append((rows.join(better, "key", "left_anti"), sizes.join(better, "key", "left_anti")))
        rows, sizes, level = fine, parts, level + 1
    met = None
    for rows, sizes in found:
        placed = rows.join(sizes.select("key", "main", "blocks", "chunks"), "key")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")
        at = lambda block, chunk, visits: F.struct(block.alias("block"), chunk.alias("chunk"), F.lit(visits).alias("visits"))
        last = lambda n: F.when(F.col("blocks") > 1, F.col(n) - 1).otherwise(0)
        homes = placed.select("key", "id", "label", F.explode(F.transform(F.sequence(F.lit(0), last("chunks")), lambda c: at(F.col("block"), c, False))).alias("at"))
        guests = placed.filter((F.col("blocks") > 1) & (F.col("label") != F.col("main")))
        guests = guests.select("key", "id", "label", F.explode(F.transform(F.sequence(F.lit(0), last("blocks")), lambda b: at(b, chunk, True))).alias("at"))
        both = homes.union(guests).select("key", "at.*", "id", "label")
        met = both if met is None else met.union(both)
    return met


def joined(ids: list[int], labels: list[int], visits: list[bool], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (label, label) of similar rows of different labels, without those whose ends are connected already."""
    labels, visits = np.array(labels), np.array(visits)
    _, root = np.unique(labels, return_inverse=True)
    if not root.any():
        return []
    sizes = np.array([len(x) for x in sets])
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[codes] > 1
    few = np.add.reduceat(shared, np.cumsum(sizes) - sizes, dtype=np.int64)  # shingles that any other row has
    codes = codes[shared]
    ends = np.cumsum(few)
    mark = np.zeros(len(counts) + 1, bool)
    any_guest, links = visits.any(), []
    for i in np.flatnonzero(few > 0).tolist():
        if any_guest and not visits[i]:
            continue
        reach = np.minimum(few, few[i])
        use = (root != root[i]) & (reach / (sizes + sizes[i] - reach) >= similarity)
        if any_guest:
            use &= ~visits
        else:
            use[: i + 1] = False
        near = np.flatnonzero(use)
        if not len(near):
            continue
        mine = codes[ends[i] - few[i] : ends[i]]
        mark[mine] = True
        if len(near) > 64:
            total = np.concatenate([[0], np.cumsum(mark[codes])])
            both = total[ends[near]] - total[ends[near] - few[near]]
        else:
            both = np.array([np.count_nonzero(mark[codes[ends[j] - few[j] : ends[j]]]) for j in near.tolist()])
        mark[mine] = False
        for j in near[both / (sizes[near] + sizes[i] - both) >= similarity].tolist():
            if root[i] != root[j]:
                links.append((int(labels[i]), int(labels[j])))
                root[root == root[j]] = root[i]
    return links


def _bucket_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, scope: str) -> DataFrame:
    """Links (a, b) of labels, verified, that connect the buckets of nodes(id, n, classes, label) as far as their texts do."""
    by = ["key", "block", "chunk"]
    members = store(_meetings(nodes, texts, width, scope), "near-meetings", scope)
    placed = _with_texts(members, texts).select(*by, "id", "label", "visits", "text")
    placed = placed.repartition(*by).sortWithinPartitions(*by)

    def make():
        held: list[tuple] = []

        def step(begins: bool, row: tuple | None) -> list[tuple]:
            found = []
            if begins and held:
                ids, labels, visits, sets = (list(x) for x in zip(*held, strict=True))
                found = joined(ids, labels, visits, sets, similarity)
                held.clear()
            if row is not None:
                held.append((*row[:3], shingle_set(row[3], width)))
            return found

        return step

    return store(grouped_rows(placed, by, "a long, b long", make), "near-bucket-links", scope)


# --- Groups -------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, scope: str = "op") -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), component_id (the group's smallest doc_id) and kept (of one row of the group) for every row of docs."""
    rows = _rows(docs, width, scope)
    texts = rows.select("id", "text")
    sets = store(rows.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "near-sets", scope)
    nodes = rows.select("id", "n", "classes", "golay").join(sets.select(F.col("node").alias("id")), "id", "left_semi")
    nodes = store(nodes, "near-nodes", scope)
    labels = components(_stars(nodes, texts, width, similarity, scope), scope)
    labelled = nodes.select("id", "n", "classes").join(labels, F.col("id") == F.col("node"), "left")
    labelled = store(labelled.select("id", "n", "classes", F.coalesce("root", "id").alias("label")), "near-labelled", scope)
    more = components(_bucket_links(labelled, texts, width, similarity, scope), scope)
    roots = labelled.select("id", "label").join(more, F.col("label") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("root", "label").alias("root"))
    # Rows of a set that others have too go by the set's node; most rows are their own node.
    copied = _small(sets.filter("copies > 1").select("digest", "node"))
    named = rows.select("id", "doc_id", "text_hash", "digest").join(copied, "digest", "left")
    named = named.select("id", "doc_id", "text_hash", F.coalesce("node", "id").alias("node")).join(roots, "node")
    named = store(named.select("id", "doc_id", "text_hash", "root"), "near-named", scope)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "id")).alias("first")
    firsts = named.groupBy("root").agg(first, F.count("*").alias("m"))
    grouped = _small(store(firsts.filter("m > 1").select("root", "first"), "near-groups", scope))
    named = named.join(grouped, "root", "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return named.select("doc_id", "text_hash", component.alias("component_id"), (alone | (F.col("id") == F.col("first.id"))).alias("kept"))
