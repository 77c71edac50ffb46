"""Executable images as tables: headers, sections, directories, relocations, functions, metadata cells, heaps, bodies, tokens, maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.kernels import cli_map, cli_metadata, cli_transform, pe, pe_transform, x64
from tessera.operators.matching import first_match
from tessera.session import bounded_batches


def exploded(images: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """rows(*columns) of every image, as a table; images that are none give no rows."""
    bounded_batches(images.sparkSession, 8)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = list(rows(*values))
                except ValueError:
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    return images.select(*columns).mapInArrow(run, schema)


def headers(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    def rows(k, raw):
        i = pe.parse(raw)
        yield k, i.machine, i.plus, i.base, i.size, i.timestamp, i.checksum, i.managed, pe.is_native_i386(raw), pe.CLASSIC.get(i.machine)

    return exploded(images, [key, data], "image_id long, machine int, plus boolean, base decimal(20,0), size long, timestamp long, checksum long, managed boolean, native_i386 boolean, file_type long", rows)


def sections(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    def rows(k, raw):
        for n, s in enumerate(pe.parse(raw).sections):
            yield k, n, s.name, s.va, s.vsize, s.raw, s.raw_size, s.flags

    return exploded(images, [key, data], "image_id long, ord int, name string, va long, vsize long, raw long, raw_size long, flags long", rows)


def directories(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    def rows(k, raw):
        for name, (rva, size) in zip(pe.DIRECTORIES, pe.parse(raw).directories, strict=False):
            yield k, name, rva, size

    return exploded(images, [key, data], "image_id long, kind string, rva long, size long", rows)


def relocations(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    def rows(k, raw):
        rewriter = pe_transform.Rewriter(bytearray(raw), pe.parse(raw), [], 0)
        for rva, kind, extra in rewriter.relocation_entries():
            yield k, rva, kind, extra

    return exploded(images, [key, data], "image_id long, rva long, kind int, extra int", rows)


def functions(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    """Function records of x64 images, with the number of their instructions."""

    def rows(k, raw):
        image = pe.parse(raw)
        for at in pe_transform.Rewriter(bytearray(raw), image, [(0, 0)], 0).functions():
            begin, end, unwind = (pe.u32(raw, at + o) for o in (0, 4, 8))
            place, n, rva = image.offset(begin), 0, begin
            while place is not None and rva < end and (size := x64.decode(raw[place + rva - begin : place + min(rva - begin + x64.LONGEST, end - begin)])[0]):
                rva, n = rva + size, n + 1
            yield k, begin, end, unwind, n

    return exploded(images, [key, data], "image_id long, first_rva long, end_rva long, unwind_rva long, instructions int", rows)


def cells(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    """Every cell of every metadata table: raw value, and for references the table and row that it names."""

    def rows(k, raw):
        layout = cli_metadata.parse(raw)
        for table, (name, columns) in cli_metadata.SCHEMA.items():
            for rid, row in layout.rows(raw, table):
                for c in columns:
                    value = row[c.name]
                    of, to = (c.of, value) if c.kind == "table" else cli_metadata.coded_parts(c.of, value) if c.kind == "coded" else (None, None)
                    yield k, table, name, rid, c.name, c.kind, value, of, to

    return exploded(images, [key, data], "image_id long, table int, table_name string, rid long, name string, kind string, value long, to_table int, to_rid long", rows)


def heap_values(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    def rows(k, raw):
        layout = cli_metadata.parse(raw)
        for heap, values in (("strings", layout.strings), ("user_strings", layout.user_strings)):
            if heap in layout.streams:
                yield from ((k, heap, offset, value) for offset, value in values(raw))

    return exploded(images, [key, data], "image_id long, heap string, offset long, value binary", rows)


def bodies(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    def rows(k, raw):
        for b in cli_metadata.bodies(raw, pe.parse(raw), cli_metadata.parse(raw)):
            yield k, b.rid, b.rva, b.place, b.header, b.code, b.total

    return exploded(images, [key, data], "image_id long, rid long, rva long, file_offset long, header_size long, code_size long, total_size long", rows)


def tokens(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    """Every token that an instruction names."""

    def rows(k, raw):
        for b in cli_metadata.bodies(raw, pe.parse(raw), cli_metadata.parse(raw)):
            start = b.place + b.header
            for at in cli_transform.token_places(raw[start : start + b.code]):
                token = pe.u32(raw, start + at)
                yield k, b.rid, at, token >> 24, token & 0xFFFFFF

    return exploded(images, [key, data], "image_id long, rid long, code_offset long, to_table int, to_rid long", rows)


def metadata_maps(pairs: DataFrame, key: str = "pair_id", source: str = "source", target: str = "target") -> DataFrame:
    """The map between two managed images, by space: a heap, a table's number, or addresses."""

    def rows(k, a, b):
        found, addresses = cli_map.Builder(a, cli_metadata.parse(a), b, cli_metadata.parse(b)).build()
        for space, entries in (found.spaces() | {"rva": addresses}).items():
            yield from ((k, space, s, t) for s, t in entries)

    return exploded(pairs, [key, source, target], "pair_id long, space string, source long, target long", rows)


def coded_index(raw: Column, kind: str) -> tuple[Column, Column, Column]:
    """Tag, table (null for an unused tag) and row of coded indexes of a kind."""
    bits, tables = cli_metadata.CODED[kind]
    tag = raw.bitwiseAND(F.lit((1 << bits) - 1))
    known = {n: t for n, t in enumerate(tables) if t is not None}
    table = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), tag.cast("int"))
    return tag, table, F.shiftright(raw, bits)


def relocation_pages(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of relocation entries(rva, kind) by page of 4096: entries, whether padded to four bytes, size, first place in the page, sum of the words."""
    inside = F.pmod("rva", F.lit(4096))
    pages = entries.groupBy(*keys, F.floor(F.col("rva") / 4096).alias("page")).agg(F.count("*").alias("entries"), F.min(inside).alias("first"), F.sum(F.col("kind") * 4096 + inside).alias("words"))
    odd = F.pmod("entries", F.lit(2))
    return pages.select(*keys, "page", "entries", (odd == 1).alias("padded"), (8 + 2 * (F.col("entries") + odd)).alias("size"), "first", "words")


def imports(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    """Every imported function: its library, name or ordinal, and the place of its address."""

    def rows(k, raw):
        yield from ((k, *r) for r in pe.imports(raw, pe.parse(raw)))

    return exploded(images, [key, data], "image_id long, dll string, name string, ordinal int, rva long", rows)


def exports(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    """Every exported function: its ordinal, its name if it has one, and its address."""

    def rows(k, raw):
        yield from ((k, *r) for r in pe.exports(raw, pe.parse(raw)))

    return exploded(images, [key, data], "image_id long, ordinal long, name string, rva long", rows)


def resources(images: DataFrame, key: str = "image_id", data: str = "content") -> DataFrame:
    """Every resource: its path of three names or numbers, and where its data are."""

    def rows(k, raw):
        yield from ((k, *r) for r in pe.resources(raw, pe.parse(raw)))

    return exploded(images, [key, data], "image_id long, path string, rva long, size long", rows)


def sections_by_name(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target): addresses just before each section of sections(), and of the first of its name in the other image."""
    found = first_match(source.select(*keys, "name", "va"), target.select(*keys, "name", "va", "ord"), [*keys, "name"], "ord")
    return found.select(*keys, (F.col("va") - 1).cast("bigint").alias("source"), (F.col("target_va") - 1).cast("bigint").alias("target"))


def by_name(source: DataFrame, target: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, source, target): addresses of imports() or exports() of equal names (the first in the other image)."""
    a = source.filter(F.col("name").isNotNull()).select(*keys, *names, F.col("rva").alias("source"))
    b = target.filter(F.col("name").isNotNull()).groupBy(*keys, *names).agg(F.min("rva").alias("target"))
    return a.join(b, [*keys, *names]).select(*keys, "source", "target")
