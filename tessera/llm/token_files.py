"""Token-id shards with a minimal perfect hash index of document keys.

A shard file holds the raw ids of its documents one after another, the keys in that order, and an index: a
minimal perfect hash gives each key a slot, and a slot has a fingerprint of its key, the offset of its ids and
their number. A lookup reads one word of bits a level (two levels on average), a rank and a slot, whatever the number of
documents, and the ids asked for. The manifest has each shard's range of keys, so a lookup over a set of shards opens one
(more only for a key whose rows fill several).

    magic | ids | keys: doc_id int64, is_null uint8, occurrence uint32 | bits and ranks | slots | footer | its length | magic

The hash has levels: on each, a key that has its place to itself keeps it, and the others go on to the next. A
key's slot is the number of places kept before its own.

Nulls: null texts are empty and have the end id only; null doc_ids come first. Rows with the same doc_id are
different documents, in the order of their texts, told apart by their occurrence. An empty table has no shards.
A document of any length lies in one shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import _arrow_schema, new_path, open_fs, steps, store, text_or_empty
from tessera.llm.tokens import DEFAULT_VOCABULARY, encoder

MAGIC = b"TESSTOK1"
#: A shard is closed beyond so many bytes of ids or so many documents.
SHARD_BYTES, SHARD_DOCS = 128 << 20, 1 << 20
READ_BYTES = 8 << 20
LOAD = 2.0
SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<i8"), ("length", "<i8")])
MANIFEST = "part int, shard int, file string, n_docs long, n_tokens long, first_id long, last_id long, nulls long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(doc_ids: np.ndarray, is_null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(doc_ids.view(np.uint64), 1) ^ mix(occurrence.astype(np.uint64) * np.uint64(2) + is_null.astype(np.uint64), 2)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bits of all levels, and ranks every 64 bits."""

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        with np.errstate(over="ignore"):
            while len(left):
                if len(sizes) > 200:
                    raise ValueError("keys repeat")
                size = -(-int(len(left) * LOAD + 1) // 64) * 64
                place = mix(left, 3 + len(sizes)) % np.uint64(size)
                alone = np.bincount(place.astype(np.int64), minlength=size) == 1
                sizes.append(size)
                levels.append(alone)
                left = left[~alone[place.astype(np.int64)]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        counts = flat.reshape(-1, 64).sum(axis=1) if len(flat) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)])[:-1].astype("<u4") if len(flat) else np.zeros(0, "<u4")
        return cls(sizes, np.packbits(flat, bitorder="little").view(np.uint8), ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that were not built in (others get a slot that is not theirs)."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        words = self.bits.view("<u8") if len(self.bits) else np.zeros(0, "<u8")
        with np.errstate(over="ignore"):
            for level, size in enumerate(self.sizes):
                place = (mix(keys[left], 3 + level) % np.uint64(size)).astype(np.int64) + self.starts[level]
                word, bit = words[place >> 6], (place & 63).astype(np.uint64)
                here = (word >> bit) & np.uint64(1) == 1
                below = word & ((np.uint64(1) << bit) - np.uint64(1))
                found[left[here]] = self.ranks[place[here] >> 6] + np.bitwise_count(below[here])
                left = left[~here]
        return found


class ShardWriter:
    def __init__(self, filesystem, path: str, code: str):
        self.out, self.code = filesystem.open_output_stream(path, compression=None), code
        self.out.write(MAGIC)
        self.ids, self.nulls, self.seen, self.lengths, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, occurrence: int, ids: bytes) -> None:
        self.out.write(ids)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.seen.append(occurrence)
        self.lengths.append(len(ids) // (2 if self.code == "H" else 4))
        self.bytes += len(ids)

    def close(self) -> tuple[int, int, int | None, int | None, int]:
        """Documents, tokens, the least and the greatest key, and how many keys are null."""
        ids, nulls, seen = np.array(self.ids, "<i8"), np.array(self.nulls, "u1"), np.array(self.seen, "<u4")
        lengths = np.array(self.lengths, "<i8")
        keys = key_hash(ids, nulls, seen)
        index = PerfectHash.build(keys)
        slots = index.slots(keys)
        table = np.zeros(len(keys), SLOT)
        table["fingerprint"][slots] = fingerprint(keys)
        table["offset"][slots] = np.cumsum(lengths) - lengths
        table["length"][slots] = lengths
        at, sections = len(MAGIC) + self.bytes, {}
        for name, part in (("ids", ids), ("nulls", nulls), ("seen", seen), ("bits", index.bits), ("ranks", index.ranks), ("table", table)):
            self.out.write(part.tobytes())
            sections[name] = [at, part.nbytes]
            at += part.nbytes
        footer = json.dumps({"code": self.code, "sizes": index.sizes, "sections": sections}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        own = ids[nulls == 0]
        least, most = (int(own[0]), int(own[-1])) if len(own) else (None, None)  # documents come in order
        return len(keys), int(lengths.sum()), least, most, int(nulls.sum())


def fingerprint(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys, 0) >> np.uint64(32)).astype("<u4")


class Shard:
    """A shard opened for keyed access."""

    def __init__(self, filesystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a shard")
        length = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.file.read_at(length, size - 16 - length))
        self.dtype = "<u2" if footer["code"] == "H" else "<u4"
        self.width = int(self.dtype[2])
        self.sections, self.sizes = footer["sections"], footer["sizes"]

    def _part(self, name: str, kind) -> np.ndarray:
        at, size = self.sections[name]
        return np.frombuffer(self.file.read_at(size, at), kind)

    @cached_property
    def ids(self) -> np.ndarray:
        return self._part("ids", "<i8")

    @cached_property
    def nulls(self) -> np.ndarray:
        return self._part("nulls", "u1")

    @cached_property
    def seen(self) -> np.ndarray:
        return self._part("seen", "<u4")

    @cached_property
    def index(self) -> PerfectHash:
        return PerfectHash(self.sizes, self._part("bits", "u1"), self._part("ranks", "<u4"))

    @cached_property
    def table(self) -> np.ndarray:
        return self._part("table", SLOT)

    def find(self, ids: np.ndarray, nulls: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key's ids; length -1 for keys that the shard does not have."""
        keys = key_hash(ids, nulls, seen)
        slots = self.index.slots(keys)
        ok = slots >= 0
        ok[ok] = self.table["fingerprint"][slots[ok]] == fingerprint(keys[ok])
        rows = self.table[np.where(ok, slots, 0)] if len(self.table) else np.zeros(len(keys), self.table.dtype)
        return np.where(ok, rows["offset"], 0), np.where(ok, rows["length"], -1)

    def read(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(length * self.width, len(MAGIC) + offset * self.width), self.dtype)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """Ids of one document, or None. Reads what it probes, not the index."""
        key = key_hash(np.array([doc_id or 0], "<i8"), np.array([doc_id is None], "u1"), np.array([occurrence], "<u4"))
        start = 0
        for level, size in enumerate(self.sizes):
            with np.errstate(over="ignore"):
                place = int(mix(key, 3 + level)[0] % np.uint64(size)) + start
            start += size
            word = int.from_bytes(self.file.read_at(8, self.sections["bits"][0] + 8 * (place >> 6)), "little")
            if word >> (place & 63) & 1:
                rank = int.from_bytes(self.file.read_at(4, self.sections["ranks"][0] + 4 * (place >> 6)), "little")
                slot = rank + (word & ((1 << (place & 63)) - 1)).bit_count()
                row = np.frombuffer(self.file.read_at(SLOT.itemsize, self.sections["table"][0] + SLOT.itemsize * slot), SLOT)[0]
                return self.read(int(row["offset"]), int(row["length"])) if row["fingerprint"] == fingerprint(key)[0] else None
        return None


class ShardSet:
    """Keyed access over the shards of a manifest: its rows, one a shard, tell which shards can have a key."""

    def __init__(self, manifest: DataFrame, folder: str):
        rows = manifest.select("file", "first_id", "last_id", "nulls").orderBy("part", "shard").collect()
        self.filesystem, self.top = open_fs(folder)
        self.null_files = [r["file"] for r in rows if r["nulls"]]
        ranged = [r for r in rows if r["first_id"] is not None]
        self.files, self.first, self.last = ([r[k] for r in ranged] for k in ("file", "first_id", "last_id"))
        self.open: dict[str, Shard] = {}

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        files = self.null_files if doc_id is None else self.files[bisect_left(self.last, doc_id) : bisect_right(self.first, doc_id)]
        for file in files:
            if file not in self.open:
                self.open[file] = Shard(self.filesystem, f"{self.top}/{file}")
            if (found := self.open[file].get(doc_id, occurrence)) is not None:
                return found
        return None


def write_shards(docs: DataFrame, folder: str, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 0) -> DataFrame:
    """Write shards in ascending order of doc_id; return the manifest: part, shard, file, n_docs, n_tokens, base."""
    fields = _arrow_schema(docs.sparkSession, MANIFEST)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = open_fs(folder)
        filesystem.create_dir(top, recursive=True)
        encode = encoder(vocabulary)
        end = end_id.to_bytes(2 if encode.code == "H" else 4, "little")
        part, done, shard, name = TaskContext.get().partitionId(), [], None, ""
        last, occurrence = object(), 0
        for batch in steps(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                occurrence = occurrence + 1 if doc == last else 0
                last = doc
                if shard is None:
                    name = f"{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
                    shard = ShardWriter(filesystem, f"{top}/{name}", encode.code)
                shard.add(doc, occurrence, encode.encode(text) + end)
                if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                    done.append((part, len(done), name, *shard.close()))
                    shard = None
        encode.forget()
        if shard is not None:
            done.append((part, len(done), name, *shard.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], schema=fields)

    manifest = store(rows.mapInArrow(write, MANIFEST), "token-manifest")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_base"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    return manifest.withColumn("inside", inside).join(parts, "part").withColumn("base", F.col("part_base") + F.col("inside")).drop("inside", "part_base")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Look every key of every shard up in its index: doc_id, start, n_tokens, ids_crc32."""
    fields = _arrow_schema(manifest.sparkSession, DOCUMENT)

    def rows(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
        offsets, lengths = shard.find(shard.ids, shard.nulls, shard.seen)
        if (lengths < 0).any():
            raise ValueError("a key is not in its shard's index")
        at, n = 0, len(offsets)
        while at < n:
            to = at + 1
            while to < n and to - at < 8192 and (offsets[to] + lengths[to] - offsets[at]) * shard.width <= READ_BYTES:
                to += 1
            ids = shard.read(int(offsets[at]), int(offsets[to - 1] + lengths[to - 1] - offsets[at])).astype("<u4")
            starts = (offsets[at:to] - offsets[at]).tolist()
            crcs = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(starts, lengths[at:to].tolist(), strict=True)]
            columns = [
                pa.array(shard.ids[at:to], pa.int64(), mask=shard.nulls[at:to].astype(bool)),
                pa.array(offsets[at:to] + base), pa.array(lengths[at:to]), pa.array(crcs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)
            at = to

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = open_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from rows(Shard(filesystem, f"{top}/{name}"), base)

    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "base").repartition(spread, "file").mapInArrow(read, DOCUMENT)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-shards")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_shards(manifest, folder)
