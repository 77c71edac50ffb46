"""Creating and applying deltas: header, preprocessing data for executables, and the codec's data."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.kernels import bsdiff, cli_map, cli_metadata, cli_transform, containers, hashes, lzx, pa19, pe, pe_transform, reversal, rift
from tessera.kernels.bits import BitReader, BitWriter
from tessera.kernels.cli_map import CliMap
from tessera.kernels.cli_metadata import Layout
from tessera.kernels.errors import DeltaError, malformed, truncated
from tessera.kernels.rift import Map

# Fixed values of the format.
PA19, PA30, PA31 = b"PA19", b"PA30", b"PA31"
HEADER, MOST, MOST_HASH = 12, 64 << 20, 33
RAW, REVERSAL, EXECUTABLE_SET = 1, 0x100, 0xF
RAW_FLAGS, BSDIFF_FLAGS, X86_FLAGS, X64_FLAGS = 0x20000, 0x100, 0xE1FE, 0xE63E
CLASSIC_TYPES, CLI4_TYPES = {0x2, 0x4, 0x8}, {0x10, 0x20, 0x40, 0x80}


@dataclass
class Header:
    version: str
    file_time: int = 0
    file_type_set: int = RAW
    file_type: int = RAW
    flags: int = RAW_FLAGS
    target_size: int = 0
    hash_algorithm: int = 0
    target_hash: bytes = b""
    extra: tuple[int, int, int, bytes] | None = None  # of PA31


@dataclass
class Parsed:
    header: Header
    preprocess: bytes
    data: bytes


def _int32(value: int) -> int:
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def _hash(reader: BitReader) -> bytes:
    found = reader.buffer()
    if len(found) > MOST_HASH:
        raise DeltaError("hash too large", f"{len(found)} bytes, at most {MOST_HASH}")
    return found


def _read_header(delta: bytes) -> tuple[Header, BitReader]:
    """The header, and the reader after it."""
    if len(delta) < HEADER:
        raise truncated("delta")
    magic = bytes(delta[:4])
    if magic not in (PA30, PA31):
        raise DeltaError("bad magic", magic.hex())
    outer = BitReader(delta[HEADER:])
    nested = magic == PA31
    reader = BitReader(outer.buffer()) if nested else outer
    found = Header(magic.decode(), int.from_bytes(delta[4:HEADER], "little"))
    found.file_type_set, found.file_type, found.flags, found.target_size = (reader.varint() for _ in range(4))
    found.hash_algorithm = _int32(reader.varint())
    found.target_hash = _hash(reader)
    if found.target_size < 0:
        raise malformed("negative target size")
    if nested:
        found.extra = (*(_int32(reader.varint()) for _ in range(3)), _hash(reader))
    return found, outer


def header(delta: bytes) -> Header:
    """The header of a delta of any version."""
    if delta[:4] == PA19:
        old = pa19.parse(delta)
        return Header("PA19", flags=old.flags, target_size=old.new_size)
    return _read_header(delta)[0]


def parse(delta: bytes) -> Parsed:
    if delta[:4] == PA19:
        raise malformed("PA19 has no preprocessing data")
    found, reader = _read_header(delta)
    if found.file_type_set & REVERSAL:
        return Parsed(found, b"", reader.buffer())
    return Parsed(found, reader.buffer(), reader.buffer())


# --- Preprocessing data -------------------------------------------------------------------------------------


@dataclass
class Preprocess:
    """What the target of an executable's delta looks like, and the map of its addresses."""

    base: int = 0
    checksum: int = 0
    timestamp: int = 0
    sections: Map = field(default_factory=list)  # from addresses to file offsets, of the target
    metadata: Layout = field(default_factory=lambda: Layout(present=False))
    addresses: Map = field(default_factory=list)  # from source to target
    cli: CliMap = field(default_factory=CliMap)


def read_preprocess(data: bytes) -> Preprocess:
    reader = BitReader(data)
    found = Preprocess(reader.bits(64), reader.bits(32), reader.bits(32), rift.read_map(reader), cli_metadata.read_record(reader), rift.read_map(reader))
    if reader.remaining():
        found.cli = cli_map.read(reader)
    return found


def write_preprocess(found: Preprocess) -> bytes:
    writer = BitWriter()
    writer.bits(found.base, 64)
    writer.bits(found.checksum, 32)
    writer.bits(found.timestamp, 32)
    rift.write_map(writer, found.sections)
    cli_metadata.write_record(writer, found.metadata)
    rift.write_map(writer, found.addresses)
    cli_map.write(writer, found.cli)
    return writer.finish()


def copy_map(reference: bytes, found: Preprocess, cli_entries: Map) -> Map:
    """From positions in the output to positions in the reference, as the codec counts them."""
    image = pe.try_parse(reference)
    if image is None:
        return rift.merged(found.sections, found.addresses)
    forward = rift.compose(rift.compose(pe.offsets_to_rvas(image), found.addresses), found.sections)
    back = rift.inverse(forward)
    return rift.moved(rift.merged(back, cli_entries), len(reference))


def _reference_as_target(reference: bytes, found: Preprocess, flags: int, managed: bool) -> tuple[bytes, Map]:
    """The rewritten reference, and the map of copies from it."""
    data = bytearray(reference)
    pe.zero_checksum(data)
    layout = cli_metadata.parse(bytes(data)) if managed else None
    image = pe.try_parse(data)
    if image:
        pe_transform.transformed(data, image, found.addresses, flags, found.base, found.timestamp)
        if layout and flags & pe_transform.CLI_CODE:
            cli_transform.transform_code(data, image, layout, found.cli)
        if layout and flags & pe_transform.CLI_METADATA:
            cli_transform.transform_metadata(data, layout, found.cli, found.addresses)
    entries = cli_transform.compression_map(layout, found.metadata, found.cli, data) if layout else []
    return bytes(data), copy_map(reference, found, entries)


# --- Applying -----------------------------------------------------------------------------------------------


def _is_managed(reference: bytes) -> bool:
    image = pe.try_parse(reference)
    return bool(image and image.managed)


def _preprocess_of(reference: bytes, parsed: Parsed) -> tuple[Preprocess | None, bool]:
    """The preprocessing data, if any, and whether managed metadata is rewritten; managed images of later kinds aren't supported."""
    if parsed.header.file_type == RAW or not parsed.preprocess:
        return None, False
    managed = _is_managed(reference)
    if managed and parsed.header.file_type not in CLASSIC_TYPES:
        raise DeltaError("unsupported", "CLI4 managed image" if parsed.header.file_type in CLI4_TYPES else "managed image of unknown type")
    found = read_preprocess(parsed.preprocess)
    if not managed and (found.metadata.present or found.cli):
        raise DeltaError("unsupported", "managed metadata for a reference that has none")
    return found, managed


def _expand(reference: bytes, rewritten: bytes, parsed: Parsed, copies: Map | None) -> bytes:
    size = parsed.header.target_size
    if parsed.data[:4] == containers.MAGIC.to_bytes(4, "little"):
        plain = containers.read_container(parsed.data)
        return plain if len(plain) == size else bsdiff.patch(reference, size, plain)
    return bytes(lzx.decompress(rewritten, parsed.data, size, copies).out)


def apply(reference: bytes, delta: bytes, verify: bool = True) -> bytes:
    """The target of a delta."""
    if delta[:4] == PA19:
        return pa19.apply(reference, delta)
    parsed = parse(delta)
    head = parsed.header
    if head.target_size > MOST:
        raise malformed("target size exceeds 64 MiB")
    if head.file_type_set & REVERSAL:
        out = reversal.apply(reference, parsed.data, head.target_size)
    else:
        found, managed = _preprocess_of(reference, parsed)
        rewritten, copies = _reference_as_target(reference, found, head.flags, managed) if found else (reference, None)
        result = bytearray(_expand(reference, rewritten, parsed, copies))
        if found:
            old = pe.timestamp(reference)
            if old and old != found.timestamp:
                pe.replace_timestamps(result, old, found.timestamp)
        if head.flags & pe_transform.UNDO_CALLS:
            pe.undo_calls(result)
        out = bytes(result)
    if verify:
        hashes.verify(out, head.hash_algorithm, head.target_hash)
    return out


def apply_into(reference: bytes, delta: bytes, room: int) -> bytes:
    """The target, if it fits in so many bytes; the size in the header is looked at before anything is decoded."""
    size = pa19.parse(delta).new_size if delta[:4] == PA19 else parse(delta).header.target_size
    if size > room:
        raise malformed(f"target of {size} bytes does not fit in {room}")
    return apply(reference, delta)


# --- Creating -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    version: str = "PA30"
    hash_algorithm: int = hashes.NONE
    codec: str = "lzx"  # or "bsdiff": the same data under another flag
    file_type: str = "raw"  # or "auto": as executables, where both are of one supported machine


def _executables(reference: bytes, target: bytes) -> tuple[int, bytes, bytes] | None:
    """File type, flags and data for a pair of executables; None if they are not such a pair."""
    source, image = pe.try_parse(reference), pe.try_parse(target)
    if not source or not image or source.machine != image.machine or image.machine not in (pe.I386, pe.AMD64):
        return None
    found = Preprocess(image.base, 0, image.timestamp, pe.section_map(target))
    flags = X64_FLAGS if image.plus else X86_FLAGS
    data = bytearray(reference)
    pe.zero_checksum(data)
    if rewritten := pe.try_parse(data):
        pe_transform.transformed(data, rewritten, found.addresses, flags, found.base, found.timestamp)
    packed = lzx.compress(bytes(data), target, copy_map(reference, found, []))
    return flags, write_preprocess(found), packed


def create(reference: bytes, target: bytes, options: Options = Options()) -> bytes:  # noqa: B008
    pair = _executables(reference, target) if options.file_type == "auto" else None
    if pair:
        flags, preprocess, data = pair
        head = Header(options.version, 0, EXECUTABLE_SET, pe.CLASSIC[pe.parse(target).machine], flags, hash_algorithm=hashes.SHA256)
    else:
        preprocess, data = b"", lzx.compress(reference, target)
        head = Header(options.version, flags=BSDIFF_FLAGS if options.codec == "bsdiff" else RAW_FLAGS, hash_algorithm=options.hash_algorithm)
    digest = hashes.signature(target, head.hash_algorithm) if head.hash_algorithm else b""
    outer = BitWriter()
    inner = BitWriter() if options.version == "PA31" else outer
    for value in (head.file_type_set, head.file_type, head.flags, len(target), head.hash_algorithm):
        inner.varint(value)
    inner.buffer(digest)
    if inner is not outer:
        for _ in range(3):
            inner.varint(0)
        inner.buffer(b"")
        outer.buffer(inner.finish())
    outer.buffer(preprocess)
    outer.buffer(data)
    return options.version.encode() + bytes(8) + outer.finish()


def apply_and_reverse(reference: bytes, delta: bytes) -> tuple[bytes, bytes]:
    """The target, and a delta back from it to the reference."""
    target = apply(reference, delta)
    return target, create(target, reference)
