"""Expressions on binary columns: signatures, checksums, framing, fixed-offset fields. All are built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MD5, SHA1, SHA256 = 0x8003, 0x8004, 0x800C


def utf8(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def signature(data: Column, algorithm: int) -> Column:
    """Hex digest by algorithm number."""
    if algorithm == MD5:
        return F.md5(data)
    if algorithm == SHA1:
        return F.sha1(data)
    if algorithm == SHA256:
        return F.sha2(data, 256)
    raise ValueError("unsupported hash algorithm")


def hash_matches(data: Column, algorithm: Column, expected: Column) -> Column:
    """True where there is nothing to verify, or the digest is the expected one; null for unknown algorithms."""
    digest = F.when(algorithm == MD5, F.md5(data)).when(algorithm == SHA1, F.sha1(data)).when(algorithm == SHA256, F.sha2(data, 256))
    return F.when((algorithm == 0) | (F.octet_length(expected) == 0), F.lit(True)).otherwise(digest == F.lower(F.hex(expected)))


def crc(data: Column) -> Column:
    return F.crc32(data)


def crc_register(data: Column) -> Column:
    """CRC-32 without its final complement."""
    return F.crc32(data).bitwiseXOR(F.lit(0xFFFFFFFF))


def is_dcm(data: Column) -> Column:
    return F.substring(data, 1, 4) == F.unhex(F.lit("44434D01"))


def dcm_wrap(data: Column) -> Column:
    return F.concat(F.unhex(F.lit("44434D01")), data)


def dcm_strip(data: Column) -> Column:
    """What is wrapped; null where nothing is."""
    return F.when(is_dcm(data), F.substring(data, F.lit(5), F.octet_length(data)))


def version(data: Column) -> Column:
    """PA19, PA30 or PA31 by the first bytes; else null."""
    magic = F.substring(data, 1, 4)
    found = F.when(magic == utf8(F.lit("PA19")), "PA19")
    for name in ("PA30", "PA31"):
        found = found.when(magic == utf8(F.lit(name)), name)
    return found


def u32_at(data: Column, offset: int) -> Column:
    """A little-endian unsigned 32-bit field; null past the end."""
    byte = lambda k: F.conv(F.hex(F.substring(data, offset + k + 1, 1)), 16, 10).cast("bigint")
    value = sum((byte(k) * (1 << 8 * k) for k in range(1, 4)), byte(0))
    return F.when(F.octet_length(data) >= offset + 4, value)


def pa19_fields(data: Column) -> dict[str, Column]:
    """Fields of a PA19 header by expressions alone; the interleave table's place doesn't depend on the window's field."""
    flags = u32_at(data, 4)
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    interleave = F.when(has(8), u32_at(data, 28)).otherwise(F.lit(0))
    start = F.lit(24) + F.when(has(4), 4).otherwise(0) + F.when(has(8), 4 + 12 * interleave).otherwise(0)
    return {
        "flags": flags, "old_size": u32_at(data, 8), "old_crc": u32_at(data, 12), "new_size": u32_at(data, 16), "new_crc": u32_at(data, 20),
        "window": F.when(has(4), F.pow(F.lit(2), u32_at(data, 24)).cast("bigint")).otherwise(F.lit(0x20000)), "interleave": interleave, "data_start": start,
    }


def looks_like_manifest(data: Column) -> Column:
    head = F.substring(data, 1, 512)
    return (F.position(utf8(F.lit("<?xml")), head) > 0) & (F.position(utf8(F.lit("<assembly")), head) > 0)


def fill_offset(data: Column) -> Column:
    """Where the first two zero bytes are; the length if there are none."""
    at = F.position(F.unhex(F.lit("0000")), data)
    return F.when(at > 0, at - 1).otherwise(F.octet_length(data))
