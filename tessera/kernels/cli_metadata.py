"""The tables and heaps embedded in managed images: where they are, how wide their columns are, and their rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.kernels import pe
from tessera.kernels.bits import BitReader, BitWriter
from tessera.kernels.errors import malformed, truncated
from tessera.kernels.pe import u16, u32, u64

TABLES = 64
SENTINEL = 0x40

# Coded indexes with their tag bits and the tables of their tags.
CODED = {
    "TypeDefOrRef": (2, (0x02, 0x01, 0x1B)),
    "HasConstant": (2, (0x04, 0x08, 0x17)),
    "HasCustomAttribute": (5, (0x06, 0x04, 0x01, 0x02, 0x08, 0x09, 0x0A, 0x00, 0x0E, 0x17, 0x14, 0x11, 0x1A, 0x1B, 0x20, 0x23, 0x26, 0x27, 0x28, 0x2A, 0x2C, 0x2B)),
    "HasFieldMarshal": (1, (0x04, 0x08)),
    "HasDeclSecurity": (2, (0x02, 0x06, 0x20)),
    "MemberRefParent": (3, (0x02, 0x01, 0x1A, 0x06, 0x1B)),
    "HasSemantics": (1, (0x14, 0x17)),
    "MethodDefOrRef": (1, (0x06, 0x0A)),
    "MemberForwarded": (1, (0x04, 0x06)),
    "Implementation": (2, (0x26, 0x23, 0x27)),
    "CustomAttributeType": (3, (SENTINEL, SENTINEL, 0x06, 0x0A, SENTINEL)),
    "ResolutionScope": (2, (0x00, 0x1A, 0x23, 0x01)),
    "TypeOrMethodDef": (1, (0x02, 0x06)),
}

# Tables with their columns. u8, u16, u32 and rva are plain; S, G and B are offsets in the heaps of
# strings, GUIDs and blobs; a number is a row of that table; a name is a coded index.
_COLUMNS = """
00 Module Generation:u16 Name:S Mvid:G EncId:G EncBaseId:G
01 TypeRef ResolutionScope:ResolutionScope Name:S Namespace:S
02 TypeDef Flags:u32 Name:S Namespace:S Extends:TypeDefOrRef FieldList:04 MethodList:06
03 FieldPtr Field:04
04 Field Flags:u16 Name:S Signature:B
05 MethodPtr Method:06
06 MethodDef Rva:rva ImplFlags:u16 Flags:u16 Name:S Signature:B ParamList:08
07 ParamPtr Param:08
08 Param Flags:u16 Sequence:u16 Name:S
09 InterfaceImpl Class:02 Interface:TypeDefOrRef
0a MemberRef Class:MemberRefParent Name:S Signature:B
0b Constant Type:u8 Padding:u8 Parent:HasConstant Value:B
0c CustomAttribute Parent:HasCustomAttribute Type:CustomAttributeType Value:B
0d FieldMarshal Parent:HasFieldMarshal NativeType:B
0e DeclSecurity Action:u16 Parent:HasDeclSecurity PermissionSet:B
0f ClassLayout PackingSize:u16 ClassSize:u32 Parent:02
10 FieldLayout Offset:u32 Field:04
11 StandAloneSig Signature:B
12 EventMap Parent:02 EventList:14
13 EventPtr Event:14
14 Event EventFlags:u16 Name:S EventType:TypeDefOrRef
15 PropertyMap Parent:02 PropertyList:17
16 PropertyPtr Property:17
17 Property Flags:u16 Name:S Type:B
18 MethodSemantics Semantics:u16 Method:06 Association:HasSemantics
19 MethodImpl Class:02 MethodBody:MethodDefOrRef MethodDeclaration:MethodDefOrRef
1a ModuleRef Name:S
1b TypeSpec Signature:B
1c ImplMap MappingFlags:u16 MemberForwarded:MemberForwarded ImportName:S ImportScope:1a
1d FieldRVA Rva:rva Field:04
1e ENCLog Token:u32 FuncCode:u32
1f ENCMap Token:u32
20 Assembly HashAlgId:u32 MajorVersion:u16 MinorVersion:u16 BuildNumber:u16 RevisionNumber:u16 Flags:u32 PublicKey:B Name:S Culture:S
21 AssemblyProcessor Processor:u32
22 AssemblyOS OSPlatformId:u32 OSMajorVersion:u32 OSMinorVersion:u32
23 AssemblyRef MajorVersion:u16 MinorVersion:u16 BuildNumber:u16 RevisionNumber:u16 Flags:u32 PublicKeyOrToken:B Name:S Culture:S HashValue:B
24 AssemblyRefProcessor Processor:u32 AssemblyRef:23
25 AssemblyRefOS OSPlatformId:u32 OSMajorVersion:u32 OSMinorVersion:u32 AssemblyRef:23
26 File Flags:u32 Name:S HashValue:B
27 ExportedType Flags:u32 TypeDefId:u32 TypeName:S TypeNamespace:S Implementation:Implementation
28 ManifestResource Offset:u32 Flags:u32 Name:S Implementation:Implementation
29 NestedClass NestedClass:02 EnclosingClass:02
2a GenericParam Number:u16 Flags:u16 Owner:TypeOrMethodDef Name:S
2b MethodSpec Method:MethodDefOrRef Instantiation:B
2c GenericParamConstraint Owner:2a Constraint:TypeDefOrRef
"""
PLAIN = {"u8": 1, "u16": 2, "u32": 4, "rva": 4}
HEAPS = {"S": "strings", "G": "guid", "B": "blob"}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # plain, heap, "table" or "coded"
    of: int | str  # the table, or the coded index


def _column(text: str) -> Column:
    name, kind = text.split(":")
    if kind in PLAIN:
        return Column(name, kind, 0)
    if kind in HEAPS:
        return Column(name, HEAPS[kind], 0)
    return Column(name, "coded", kind) if kind in CODED else Column(name, "table", int(kind, 16))


SCHEMA: dict[int, tuple[str, tuple[Column, ...]]] = {
    int(line[:2], 16): (line.split()[1], tuple(map(_column, line.split()[2:]))) for line in _COLUMNS.strip().splitlines()
}
#: Streams by name.
STREAMS = {"#Strings": "strings", "#US": "user_strings", "#Blob": "blob", "#GUID": "guid", "#~": "tables"}


def coded_parts(kind: str, raw: int) -> tuple[int | None, int]:
    """Table (None: no such tag) and row of a coded index."""
    bits, tables = CODED[kind]
    tag = raw & ((1 << bits) - 1)
    return tables[tag] if tag < len(tables) else None, raw >> bits


def column_width(column: Column, counts: list[int], widths: dict[str, int]) -> int:
    if column.kind in PLAIN:
        return PLAIN[column.kind]
    if column.kind == "table":
        return 2 if counts[column.of] < 1 << 16 else 4
    if column.kind == "coded":
        bits, tables = CODED[column.of]
        return 2 if max((counts[t] for t in tables if t != SENTINEL), default=0) < 1 << (16 - bits) else 4
    return widths[column.kind]


def compressed(data: bytes, at: int = 0) -> tuple[int, int]:
    """Value and width of a compressed unsigned integer of one, two or four bytes, highest first."""
    if at >= len(data):
        raise truncated("compressed integer")
    first = data[at]
    width, mask = (1, 0x7F) if first < 0x80 else (2, 0x3FFF) if first < 0xC0 else (4, 0x1FFFFFFF)
    if first >= 0xE0:
        raise malformed("reserved CLI compressed unsigned integer prefix")
    if at + width > len(data):
        raise truncated("compressed integer")
    return int.from_bytes(data[at : at + width], "big") & mask, width


def put_compressed(data: bytearray, at: int, width: int, value: int) -> bool:
    """Write in as many bytes as were there; False if it doesn't fit."""
    limit, mark = {1: (1 << 7, 0), 2: (1 << 14, 0x8000), 4: (1 << 29, 0xC0000000)}[width]
    if value >= limit:
        return False
    data[at : at + width] = (value | mark).to_bytes(width, "big")
    return True


@dataclass
class Layout:
    """Where tables and heaps are, by name: (offset in the file, size); and the tables' rows."""

    streams: dict[str, tuple[int, int]] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("strings", "guid", "blob"), 2))
    valid: int = 0
    counts: list[int] = field(default_factory=lambda: [0] * TABLES)
    sizes: list[int] = field(default_factory=lambda: [0] * TABLES)
    places: list[int | None] = field(default_factory=lambda: [None] * TABLES)
    present: bool = True
    offset: int = 0
    size: int = 0
    rva: int = 0
    stream_count: int = 0
    headers_end: int = 0
    version: str = ""
    sorted_mask: int = 0

    def width(self, column: Column) -> int:
        return column_width(column, self.counts, self.widths)

    def place_tables(self, at: int, end: int) -> None:
        """Rows of all tables follow each other."""
        for table, n in enumerate(self.counts):
            if n:
                self.sizes[table] = sum(map(self.width, SCHEMA[table][1]))
                self.places[table] = at
                at += n * self.sizes[table]
                if at > end:
                    raise malformed("CLI metadata: table stream is too small")

    def present_tables(self) -> Iterator[int]:
        for table in range(TABLES):
            if self.valid >> table & 1:
                if table not in SCHEMA:
                    raise malformed("CLI metadata: unknown present table id")
                yield table

    def columns(self, table: int) -> Iterator[tuple[Column, int, int]]:
        """Each column with its offset in a row and its width."""
        at = 0
        for column in SCHEMA[table][1]:
            n = self.width(column)
            yield column, at, n
            at += n

    def row_place(self, table: int, rid: int) -> int:
        if not 0 < rid <= self.counts[table]:
            raise malformed("CLI metadata: row RID is out of range")
        return self.places[table] + (rid - 1) * self.sizes[table]

    def row(self, data: bytes, table: int, rid: int) -> dict[str, int]:
        """A row's raw values by column."""
        place = self.row_place(table, rid)
        if place + self.sizes[table] > len(data):
            raise truncated("CLI row")
        return {c.name: int.from_bytes(data[place + at : place + at + n], "little") for c, at, n in self.columns(table)}

    def rows(self, data: bytes, table: int) -> Iterator[tuple[int, dict[str, int]]]:
        for rid in range(1, self.counts[table] + 1):
            yield rid, self.row(data, table, rid)

    # --- Heaps ------------------------------------------------------------------------------------------

    def heap(self, data: bytes, name: str) -> bytes:
        if name not in self.streams:
            raise malformed(f"CLI metadata: missing {name} stream")
        at, n = self.streams[name]
        if at + n > len(data):
            raise truncated("CLI heap")
        return bytes(data[at : at + n])

    def string(self, data: bytes, offset: int) -> str:
        heap = self.heap(data, "strings")
        end = heap.find(0, offset) if offset <= len(heap) else -1
        if offset and end < 0:
            raise malformed("CLI metadata: bad #Strings value")
        return heap[offset:end].decode() if offset else ""

    def counted(self, data: bytes, name: str, offset: int) -> bytes:
        """A value of the heaps of blobs and user strings."""
        if not offset:
            return b""
        heap = self.heap(data, name)
        n, width = compressed(heap, offset)
        if offset + width + n > len(heap):
            raise truncated("CLI heap value")
        return heap[offset + width : offset + width + n]

    def guid(self, data: bytes, index: int) -> bytes | None:
        """Sixteen bytes by number, from 1; 0 is none."""
        if not index:
            return None
        found = self.heap(data, "guid")[16 * index - 16 : 16 * index]
        if len(found) < 16:
            raise truncated("CLI GUID")
        return found

    def strings(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """Offset and bytes of every string but the empty ones."""
        heap, at = self.heap(data, "strings"), 1
        while at < len(heap):
            end = heap.find(0, at)
            if end < 0:
                raise malformed("CLI #Strings heap: unterminated value")
            if end > at:
                yield at, heap[at:end]
            at = end + 1

    def user_strings(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """Offset and bytes, with the length before them, of every record; bytes that begin none are passed over."""
        heap, at = self.heap(data, "user_strings"), 0
        while at < len(heap):
            try:
                n, width = compressed(heap, at)
            except ValueError as error:
                if getattr(error, "kind", "") == "truncated":
                    return
                at += 1
                continue
            end = at + width + n
            if end > len(heap):
                at += 1
                continue
            if end - at != 1:
                yield at, heap[at:end]
            at = end


# --- In an image --------------------------------------------------------------------------------------------


def parse(data: bytes) -> Layout:
    """The metadata of a managed image."""
    image = pe.parse(data)
    rva, _ = image.directory(pe.CLR)
    header = image.offset(rva) if rva else None
    if header is None:
        raise malformed("PE: missing CLR runtime header")
    if header + 0x48 > len(data):
        raise truncated("CLR header")
    found = Layout(rva=u32(data, header + 8), size=u32(data, header + 12))
    place = image.offset(found.rva) if found.rva and found.size else None
    if place is None:
        raise malformed("CLI metadata: empty metadata directory")
    found.offset = place
    root = bytes(data[place : place + found.size])
    if len(root) < found.size:
        raise truncated("CLI metadata")
    if root[:4] != b"BSJB":
        raise malformed("CLI metadata: bad BSJB signature")
    version_end = 16 + u32(root, 12)
    if version_end + 4 > len(root):
        raise truncated("CLI metadata")
    found.version = root[16:version_end].split(b"\0")[0].decode()
    at = (version_end + 3 & ~3) + 4
    found.stream_count = u16(root, at - 2)
    if not found.stream_count:
        raise malformed("CLI metadata: no streams")
    names = set()
    for _ in range(found.stream_count):
        end = root.find(0, at + 8)
        if end < 0:
            raise malformed("CLI metadata: unterminated stream name")
        offset, size, name = u32(root, at), u32(root, at + 4), root[at + 8 : end].decode()
        if name in names:
            raise malformed("CLI metadata: duplicate stream name")
        if offset + size > len(root):
            raise truncated("CLI stream")
        names.add(name)
        if name in STREAMS:
            found.streams[STREAMS[name]] = place + offset, size
        at = end + 4 & ~3
    found.headers_end = place + at
    if "tables" not in found.streams:
        raise malformed("CLI metadata: missing #~ stream")
    start, size = found.streams["tables"]
    if size < 24:
        raise truncated("CLI tables")
    for bit, heap in enumerate(("strings", "guid", "blob")):
        found.widths[heap] = 4 if data[start + 6] >> bit & 1 else 2
    found.valid, found.sorted_mask = u64(data, start + 8), u64(data, start + 16)
    at = start + 24
    for table in found.present_tables():
        if at + 4 > start + size:
            raise truncated("CLI tables")
        found.counts[table], at = u32(data, at), at + 4
    found.place_tables(at, start + size)
    return found


# --- In a delta ---------------------------------------------------------------------------------------------

_ORDER = ("strings", "user_strings", "blob", "guid", "tables")


def read_record(reader: BitReader) -> Layout:
    """The target's layout without its bytes; not present: an empty one."""
    if not reader.bits(1):
        return Layout(present=False)
    found = Layout()
    found.offset, found.size, found.rva, found.stream_count, found.headers_end = (reader.bits(32) for _ in range(5))
    for name in _ORDER:
        place = reader.bits(32), reader.bits(32)
        if any(place) or name == "tables":
            found.streams[name] = place
    for heap in ("strings", "guid", "blob"):
        found.widths[heap] = 4 if reader.bits(1) else 2
    found.valid = reader.bits(64)
    for table in found.present_tables():
        found.counts[table] = reader.bits(32)
    if not found.size or not found.stream_count:
        raise malformed("CLI metadata: empty metadata directory or no streams")
    end = found.offset + found.size
    for at, n in [(found.headers_end, 0), *found.streams.values()]:
        if at < found.offset or at + n > end:
            raise malformed("CLI metadata: stream exceeds metadata")
    start, size = found.streams["tables"]
    first = start + 24 + 4 * found.valid.bit_count()
    if first > start + size:
        raise malformed("CLI metadata: table stream is too small")
    found.place_tables(first, start + size)
    return found


def write_record(writer: BitWriter, layout: Layout) -> None:
    writer.bits(layout.present, 1)
    if not layout.present:
        return
    for value in (layout.offset, layout.size, layout.rva, layout.stream_count, layout.headers_end):
        writer.bits(value, 32)
    for name in _ORDER:
        for value in layout.streams.get(name, (0, 0)):
            writer.bits(value, 32)
    for heap in ("strings", "guid", "blob"):
        writer.bits(layout.widths[heap] == 4, 1)
    writer.bits(layout.valid, 64)
    for table in layout.present_tables():
        writer.bits(layout.counts[table], 32)


# --- Method bodies ------------------------------------------------------------------------------------------


@dataclass
class Body:
    rid: int
    rva: int
    place: int
    header: int
    code: int
    total: int


def body_layout(data: bytes, place: int, room: int) -> tuple[int, int, int] | None:
    """Sizes of header, code and the whole body, with its extra sections; None if it is no body."""
    room = min(room, len(data) - place)
    if room <= 0:
        return None
    first = data[place]
    if first & 3 == 2:
        found = 1, first >> 2, 1 + (first >> 2)
        return found if found[2] <= room else None
    if first & 3 != 3 or room < 12:
        return None
    flags = u16(data, place)
    header, code = (flags >> 12) * 4, u32(data, place + 4)
    total = header + code
    if header < 12 or total > room:
        return None
    more = flags & 8
    while more:
        total = total + 3 & ~3
        if total + 4 > room:
            return None
        kind = data[place + total]
        total += 4 + (int.from_bytes(data[place + total + 1 : place + total + 4], "little") if kind & 0x40 else data[place + total + 1])
        if total > room:
            return None
        more = kind & 0x80
    return header, code, total


def bodies(data: bytes, image: pe.Image, layout: Layout) -> Iterator[Body]:
    for rid, row in layout.rows(data, 0x06):
        rva = row["Rva"]
        section = next((s for s in image.sections if s.raw_size and s.va <= rva < s.va + s.raw_size), None) if rva else None
        if section:
            place = section.raw + rva - section.va
            if sizes := body_layout(data, place, section.raw_size - (rva - section.va)):
                yield Body(rid, rva, place, *sizes)
