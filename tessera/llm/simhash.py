"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's fingerprint has a bit set if over half the XXH64 hashes of its word shingles have it. Fingerprints
within two bits are linked, and documents reached over links are a group.

Search: the 64 bits are three segments. Of at most two differing bits, at least one segment has none; then the
others have at most two between them. The binary Golay code has a codeword within three bits of any word of 23,
so two words that differ in up to two bits have a codeword within four bits of both (the one nearest to a word
half-way). A key is a segment's own bits with the index of a codeword within four bits of the next segment: one
to six keys for each of the three segments, and linked fingerprints share at least one. Fingerprints that share a
key are compared.

Groups of copies have one fingerprint, so only different fingerprints are searched. A key that many different
fingerprints share is not compared pair by pair: each of its fingerprints goes to itself and its 64 neighbours at
one bit. Those that meet are within two bits of each other, and any two within two bits meet, so linking all that
meet to one of them gives the same components, with at most 65 in one place.

near.py finds documents by the similarity of their shingle sets, over the same keys and others.

Words are runs of characters other than space and 09-0D, lower-cased in A-Z. A text of fewer words than a shingle
has one shingle, the whole sequence; one without words (or null) has the fingerprint zero. A null doc_id is
carried and is the smallest of a group only if it is the only one. Repeated rows have the same fingerprint. An
empty table gives no rows. Long texts are hashed whole, in blocks.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, store, text_or_empty
from tessera.llm.components import components

SEED, WIDTH, BITS = 42, 3, 2
#: Different fingerprints of one key that are compared pair by pair.
SMALL = 64
BLOCK = 1 << 15
# The Golay code's generator polynomial, and where the segments lie.
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))


# --- Golay code ---------------------------------------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and for each remainder the patterns of up to four bits that have it (-1: no more)."""
    upper = np.array([_remainder(x << 11) for x in range(1 << 12)], np.int64)
    single = [_remainder(1 << b) for b in range(23)]
    patterns = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            r = 0
            for b in bits:
                r ^= single[b]
            patterns[r, used[r]] = sum(1 << b for b in bits)
            used[r] += 1
    return upper, patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each word of 23 bits, the indices of the codewords within four bits: six columns, -1 where there are fewer."""
    upper, patterns = golay_tables()
    found = patterns[upper[words >> 11] ^ (words & 0x7FF)]
    return np.where(found >= 0, (words[:, None] ^ found) >> 11, -1)


def segments(prints: np.ndarray) -> list[np.ndarray]:
    prints = prints.view(np.uint64)
    return [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]


def search_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint) such that fingerprints within two bits share a key."""
    parts = segments(prints)
    keys, owners = [], []
    for k in range(3):
        indices = codeword_indices(parts[(k + 1) % 3])
        row, column = np.nonzero(indices >= 0)
        keys.append((k << 34) | (parts[k][row] << 12) | indices[row, column])
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


# --- Fingerprints -------------------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle, as rows of eight bytes, the highest first."""
    words = text.encode().lower().split()
    digest = xxhash.xxh64_digest
    if not words:
        return np.zeros((0, 8), np.uint8)
    if len(words) <= width:
        found = [digest(b" ".join(words), SEED)]
    elif width == 3:
        found = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        found = [digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(width)))]
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp for every row of docs."""
    def make():
        return lambda batch: {"doc_id": batch.column(0), "fp": [fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty()), "doc_id long, fp long", make)


# --- Search -------------------------------------------------------------------------------------------------


def bucket_pairs(rows: DataFrame, most_bits: int, small: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) within buckets of up to `small` rows, and the rows of larger ones. rows: key, id, fp; each (key, id) once."""
    item = F.struct("id", "fp")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(item).alias("lo"), F.max(item).alias("hi"))
    sizes = store(sizes.filter("n > 1"), "buckets", scope)
    close = lambda x, y: F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= most_bits
    two = sizes.filter((F.col("n") == 2) & close(F.col("lo"), F.col("hi"))).select(F.col("lo.id").alias("a"), F.col("hi.id").alias("b"))
    some = rows.join(sizes.filter((F.col("n") > 2) & (F.col("n") <= small)).select("key"), "key", "left_semi")
    listed = some.groupBy("key").agg(F.collect_list(item).alias("all"))  # at most `small` in a list
    linked = F.flatten(
        F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y["id"] > x["id"]) & close(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"))))
    )
    more = listed.select(F.explode(linked).alias("p")).select("p.a", "p.b")
    large = rows.join(sizes.filter(F.col("n") > small).select("key"), "key", "left_semi")
    return two.union(more), large


def fingerprint_links(nodes: DataFrame, scope: str = "op") -> DataFrame:
    """Links (a, b) between the different fingerprints in nodes(fp) whose components are those of all links of up to two bits."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, object]:
            prints = batch.column(0).to_numpy()
            keys, owners = search_keys(prints)
            return {"key": keys, "id": prints[owners], "fp": prints[owners]}

        return step

    keys = map_arrow(nodes.select("fp"), "key long, id long, fp long", make)
    links, large = bucket_pairs(keys, BITS, SMALL, scope)
    changes = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    near = F.transform(changes, lambda change: F.col("fp").bitwiseXOR(change))
    met = large.select("fp").distinct().select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("all"))
    star = met.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return links.union(star.filter("a <> b"))


def simhash_groups(docs: DataFrame, scope: str = "op") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of the group, for every row of docs."""
    prints = store(fingerprints(docs), "prints", scope)
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", scope)
    roots = components(fingerprint_links(nodes, scope), scope)
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = store(linked.select("fp", "root").join(least, "root").select("fp", "smallest"), "linked", scope)
    final = nodes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
