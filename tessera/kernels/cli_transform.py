"""Rewriting a managed reference's metadata and code by a map, and the map of where its parts are in the target."""

from __future__ import annotations

from tessera.kernels import pe
from tessera.kernels.cli_map import CliMap, map_coded
from tessera.kernels.cli_metadata import SCHEMA, TABLES, Layout, bodies, column_width, compressed, put_compressed
from tessera.kernels.rift import Map, offset_or_zero, offset_wrapping

# Signature grammars by table; element types.
SIGNATURES = {0x06: "method", 0x0A: "member", 0x04: "field", 0x17: "property", 0x1B: "type", 0x11: "method"}
SIMPLE = {*range(0x02, 0x0F), 0x16, 0x18, 0x19, 0x1C}
VOID, PTR, BYREF, VALUE, CLASS, VAR, ARRAY, GENERIC, TYPED, FN, VECTOR, MVAR, REQUIRED, OPTIONAL = (
    0x01, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x14, 0x15, 0x16, 0x1B, 0x1D, 0x1E, 0x1F, 0x20,
)
FIELD_CALL, GENERIC_CALL = 0x06, 0x10
# Bytes of operands by opcode, ranges (first, last); -1: a token, -2: a jump table.
TOKEN, SWITCH = -1, -2
OPERANDS = {
    1: ((0x0E, 0x13), (0x1F, 0x1F), (0x2B, 0x37), (0xDE, 0xDE)),
    4: ((0x20, 0x20), (0x22, 0x22), (0x29, 0x29), (0x38, 0x44), (0xDD, 0xDD)),
    8: ((0x21, 0x21), (0x23, 0x23)),
    SWITCH: ((0x45, 0x45),),
    TOKEN: ((0x27, 0x28), (0x6F, 0x75), (0x79, 0x79), (0x7B, 0x81), (0x8C, 0x8D), (0x8F, 0x8F), (0xA3, 0xA5), (0xC2, 0xC2), (0xC6, 0xC6), (0xD0, 0xD0)),
}
OPERANDS_FE = {2: ((0x09, 0x0E),), 1: ((0x12, 0x12),), TOKEN: ((0x06, 0x07), (0x15, 0x16), (0x1C, 0x1C))}
USER_STRING, METHOD_DEF = 0x70, 0x06
LAST_SOURCE = 0xFFFFFFFF


def _operand(kinds: dict[int, tuple[tuple[int, int], ...]], op: int) -> int:
    return next((n for n, ranges in kinds.items() for a, b in ranges if a <= op <= b), 0)


# --- Signatures ---------------------------------------------------------------------------------------------


class _Walker:
    """Walks a signature in a buffer and maps the types in it; stops where it isn't understood or ends."""

    def __init__(self, data: bytearray, start: int, end: int, tables: list[Map]):
        self.data, self.at, self.end, self.tables = data, start, end, tables

    def byte(self) -> int:
        if self.at >= self.end:
            raise EOFError
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        value, width = compressed(bytes(self.data[self.at : min(self.end, self.at + 4)]))
        self.at += width
        return value

    def reference(self) -> None:
        start = self.at
        raw = self.number()
        mapped = map_coded(raw, "TypeDefOrRef", self.tables)
        if mapped != raw:
            put_compressed(self.data, start, self.at - start, mapped)

    def modifiers(self) -> None:
        while self.at < self.end:
            ahead = self.data[self.at]
            if ahead in (REQUIRED, OPTIONAL):
                self.at += 1
                self.reference()
            elif ahead & 0xF0 == 0x40:
                self.at += 1
            else:
                return

    def parameter(self) -> None:
        self.modifiers()
        kind = self.byte()
        if kind not in (VOID, TYPED):
            self.at -= kind != BYREF
            self.type()

    def type(self) -> None:
        kind = self.byte()
        while kind in (REQUIRED, OPTIONAL) or kind & 0xF0 == 0x40:
            if kind in (REQUIRED, OPTIONAL):
                self.reference()
            kind = self.byte()
        if kind in SIMPLE:
            return
        if kind in (PTR, VECTOR):
            self.type()
        elif kind in (VALUE, CLASS):
            self.reference()
        elif kind in (VAR, MVAR):
            self.number()
        elif kind == ARRAY:
            self.type()
            self.number()
            for _ in range(2):  # sizes, lower bounds
                for _ in range(self.number()):
                    self.number()
        elif kind == GENERIC:
            self.type()
            for _ in range(self.number()):
                self.type()
        elif kind == FN:
            self.method()
        else:
            raise EOFError

    def method(self) -> None:
        if self.byte() & GENERIC_CALL:
            self.number()
        for _ in range(1 + self.number()):
            self.parameter()

    def field(self) -> None:
        self.byte()
        self.type()

    def property(self) -> None:
        self.byte()
        n = self.number()
        self.type()
        for _ in range(n):
            self.parameter()

    def member(self) -> None:
        (self.field if self.data[self.at : self.end][:1] == bytes([FIELD_CALL]) else self.method)()


def transform_signature(data: bytearray, start: int, end: int, grammar: str, tables: list[Map]) -> None:
    try:
        getattr(_Walker(data, start, end, tables), grammar)()
    except (EOFError, ValueError):
        pass  # what was walked stays mapped


def _transform_blob(data: bytearray, layout: Layout, offset: int, grammar: str, tables: list[Map]) -> None:
    if "blob" not in layout.streams:
        return
    start, size = layout.streams["blob"]
    end = min(start + size, len(data))
    try:
        n, width = compressed(bytes(data[start + offset : min(end, start + offset + 4)]))
    except ValueError:
        return
    first = start + offset + width
    if first + n <= end:
        transform_signature(data, first, first + n, grammar, tables)


# --- Metadata -----------------------------------------------------------------------------------------------


def transform_metadata(data: bytearray, layout: Layout, cli_map: CliMap, addresses: Map) -> None:
    """Map every cell of every table, where it fits; then the signatures, at the source's offsets."""
    heaps = {"strings": cli_map.strings, "guid": cli_map.guid, "blob": cli_map.blob, "rva": addresses}
    signatures = set()
    for table in range(TABLES):
        for rid in range(1, layout.counts[table] + 1):
            place = layout.row_place(table, rid)
            for column, at, n in layout.columns(table):
                if place + at + n > len(data):
                    break
                value = int.from_bytes(data[place + at : place + at + n], "little")
                if column.kind == "blob" and value and table in SIGNATURES:
                    signatures.add((table, value))
                mapped = value
                if column.kind == "coded":
                    mapped = map_coded(value, column.of, cli_map.tables)
                elif value and (entries := cli_map.tables[column.of] if column.kind == "table" else heaps.get(column.kind)):
                    mapped = (value + offset_or_zero(entries, value)) & 0xFFFFFFFF
                if mapped >> 8 * n == 0:
                    pe.put(data, place + at, mapped, n)
    for table, offset in sorted(signatures):
        _transform_blob(data, layout, offset, SIGNATURES[table], cli_map.tables)


# --- Code ---------------------------------------------------------------------------------------------------


def token_places(code: bytes) -> list[int]:
    """Where operands are tokens, up to where instructions end or break off."""
    found, at = [], 0
    while at < len(code):
        op, at = code[at], at + 1
        if op == 0xFE:
            if at >= len(code):
                break
            n, at = _operand(OPERANDS_FE, code[at]), at + 1
        else:
            n = _operand(OPERANDS, op)
        if n == SWITCH:
            if at + 4 > len(code):
                break
            n = 4 + 4 * pe.u32(code, at)
        if at + abs(4 if n == TOKEN else n) > len(code):
            break
        if n == TOKEN:
            found.append(at)
        at += 4 if n == TOKEN else n
    return found


def map_token(raw: int, tables: list[Map], user_strings: Map) -> int:
    """A token: its table in the top byte, its row or offset below."""
    table, rid = raw >> 24, raw & 0xFFFFFF
    entries = tables[table] if table < TABLES else user_strings if table == USER_STRING else []
    return table << 24 | (rid + offset_or_zero(entries, rid)) & 0xFFFFFF


def transform_code(data: bytearray, image: pe.Image, layout: Layout, cli_map: CliMap) -> None:
    """Map the tokens of all method bodies. In constructors only those of methods are, as the format has it."""
    only_methods = [entries if t == METHOD_DEF else [] for t, entries in enumerate(cli_map.tables)]
    for body in list(bodies(data, image, layout)):
        start = body.place + body.header
        try:
            name = layout.string(data, layout.row(data, METHOD_DEF, body.rid)["Name"])
        except ValueError:
            name = ""
        tables, user = (only_methods, []) if name in (".ctor", ".cctor") else (cli_map.tables, cli_map.user_strings)
        for at in token_places(bytes(data[start : start + body.code])):
            pe.put(data, start + at, map_token(pe.u32(data, start + at), tables, user))


# --- Where parts are in the target --------------------------------------------------------------------------


def _row_offset(table: int, size: int, rid: int) -> int:
    return table + ((rid - 1) * size if rid > 0 else rid)


def compression_map(source: Layout, target: Layout, cli_map: CliMap, transformed: bytes) -> Map:
    """From file offsets in the target to those in the transformed source, for heaps, tables and columns that change width."""
    if not target.present:
        return []
    fill = bytes(transformed).find(b"\0\0")
    fill = len(transformed) if fill < 0 else fill
    found: Map = []

    def stream(name: str, size: int) -> tuple[int, int] | None:
        if name not in source.streams or not target.streams.get(name, (0, 0))[1]:
            return None
        return source.streams[name][0], target.streams[name][0]

    def add(entries: Map, from_: int, to: int, from_size: int, to_size: int) -> None:
        """Rows of a size each; size 0: plain offsets."""
        if not entries:
            found.append((to, from_))
        for s, t in entries:
            if s > LAST_SOURCE:
                break
            found.append((to + t, from_ + s) if not from_size else (_row_offset(to, to_size, t), _row_offset(from_, from_size, s)))

    for name in ("strings", "user_strings", "blob"):
        if places := stream(name, 0):
            add(getattr(cli_map, name), *places, 0, 0)
    if places := stream("guid", 16):
        add(cli_map.guid, *places, 16, 16)
    for table in range(TABLES):
        from_, to = source.places[table], target.places[table]
        if from_ is None or to is None:
            continue
        add(cli_map.tables[table], from_, to, source.sizes[table], target.sizes[table])
        found += _width_holes(table, source, target, cli_map.tables[table], fill)
    return sorted(found, key=lambda e: e[0])


def _width_holes(table: int, source: Layout, target: Layout, entries: Map, fill: int) -> Map:
    """What is new in widened columns is copied from zeros; what follows a changed column, from where it was."""
    found, a, b = [], 0, 0
    columns = SCHEMA[table][1]
    for k, column in enumerate(columns):
        narrow, wide = column_width(column, source.counts, source.widths), column_width(column, target.counts, target.widths)
        last = k + 1 == len(columns)
        if narrow != wide and {narrow, wide} == {2, 4} and not (last and wide == 2):
            for rid in range(1, source.counts[table] + 1):
                here = _row_offset(source.places[table], source.sizes[table], rid) + a
                there = _row_offset(target.places[table], target.sizes[table], rid + offset_wrapping(entries, rid)) + b
                if wide == 4:
                    found.append((there + 2, fill))
                    if not last:
                        found.append((there + 4, here + 2))
                else:
                    found.append((there + 2, here + 4))
        a, b = a + narrow, b + wide
    return found
