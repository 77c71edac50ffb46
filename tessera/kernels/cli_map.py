"""Maps between the heaps and tables of two managed images: their stored form, mapping of tokens, and building."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.kernels import rift
from tessera.kernels.bits import BitReader, BitWriter
from tessera.kernels.cli_metadata import CODED, SCHEMA, SENTINEL, TABLES, Column, Layout, coded_parts
from tessera.kernels.rift import IntFormat, Map

MISS = 0xFFFFFFFF
HEAP_SPACES = ("strings", "user_strings", "blob")


@dataclass
class CliMap:
    """From positions in the source's heaps and rows of its tables to the target's."""

    strings: Map = field(default_factory=list)
    user_strings: Map = field(default_factory=list)
    blob: Map = field(default_factory=list)
    guid: Map = field(default_factory=list)
    tables: list[Map] = field(default_factory=lambda: [[] for _ in range(TABLES)])

    def __bool__(self) -> bool:
        return any((self.strings, self.user_strings, self.blob, self.guid, *self.tables))

    def spaces(self) -> dict[str, Map]:
        """All maps by name; a table's is its number in hex."""
        return {"strings": self.strings, "user_strings": self.user_strings, "blob": self.blob, "guid": self.guid} | {f"{t:02x}": m for t, m in enumerate(self.tables)}


def read(reader: BitReader) -> CliMap:
    if not reader.bits(1):
        return CliMap()
    heap = IntFormat.read(reader), IntFormat.read(reader)
    table = IntFormat.read(reader), IntFormat.read(reader)
    found = [rift.read_entries(reader, *heap) for _ in HEAP_SPACES]
    found += [rift.read_entries(reader, *table) for _ in range(1 + TABLES)]
    return CliMap(*found[:4], found[4:])


def write(writer: BitWriter, cli_map: CliMap) -> None:
    writer.bits(bool(cli_map), 1)
    if not cli_map:
        return
    groups = [[cli_map.strings, cli_map.user_strings, cli_map.blob], [cli_map.guid, *cli_map.tables]]
    formats = [rift.formats_for(maps) for maps in groups]
    for own in formats:
        for f in own:
            f.write(writer)
    for maps, own in zip(groups, formats, strict=True):
        for entries in maps:
            rift.write_entries(writer, entries, *own)


# --- Tokens -------------------------------------------------------------------------------------------------


def one_target_each(entries: Map) -> Map:
    """Of equal sources the last, in order."""
    return sorted(dict(entries).items())


def map_coded(raw: int, kind: str, tables: list[Map]) -> int:
    """A coded index by its table's map; before the first row, by the last entry. Unchanged without a table or a map."""
    bits, _ = CODED[kind]
    table, rid = coded_parts(kind, raw)
    if table in (None, SENTINEL) or table not in SCHEMA or not tables[table]:
        return raw
    moved = rid + rift.offset_wrapping(one_target_each(tables[table]), rid)
    return ((moved & 0xFFFFFFFF) << bits | raw & ((1 << bits) - 1)) & 0xFFFFFFFF


def map_coded_exact(raw: int, kind: str, tables: list[Map]) -> int:
    """As map_coded(), of rows that are in the map; else MISS."""
    bits, _ = CODED[kind]
    table, rid = coded_parts(kind, raw)
    if table in (None, SENTINEL) or table not in SCHEMA or not tables[table]:
        return MISS
    target = rift.exact_target(one_target_each(tables[table]), rid)
    if target is None or target & 0xFFFFFFFF == MISS:
        return MISS
    return ((target & 0xFFFFFFFF) << bits | raw & ((1 << bits) - 1)) & 0xFFFFFFFF


# --- Building -----------------------------------------------------------------------------------------------

# How rows are matched, in this order. A list of columns: by equal keys, first come first served. A
# pair: the rows that an owner's list has, by name.
STEPS: tuple[tuple[int, tuple[str, ...] | tuple[int, str, str]], ...] = (
    (0x20, ("Name",)),
    (0x23, ("Name",)),
    (0x00, ("Name",)),
    (0x1A, ("Name",)),
    (0x02, ("Name", "Namespace")),
    (0x04, (0x02, "FieldList", "Name")),
    (0x06, (0x02, "MethodList", "Name")),
    (0x08, (0x06, "ParamList", "Name")),
    (0x01, ("Name", "Namespace")),
    (0x0A, ("Name", "Class")),
    (0x12, ("Parent",)),
    (0x14, (0x12, "EventList", "Name")),
    (0x15, ("Parent",)),
    (0x17, (0x15, "PropertyList", "Name")),
    (0x0B, ("Parent",)),
    (0x0D, ("Parent",)),
    (0x0E, ("Parent",)),
    (0x0F, ("Parent",)),
    (0x10, ("Field",)),
    (0x18, ("Method",)),
    (0x1C, ("ImportName", "MemberForwarded")),
    (0x1D, ("Field",)),
    (0x26, ("Name",)),
    (0x28, ("Name",)),
    (0x2A, ("Name", "Owner")),
    (0x2B, ("Method",)),
    (0x2C, ("Owner",)),
    (0x0C, ("Parent",)),
)
TYPE_DEF, TYPE_REF, NESTED = 0x02, 0x01, 0x29
NAMESPACE = 0x80000000


def heap_map(source: list[tuple[int, bytes]], target: list[tuple[int, bytes]], zero: bool) -> Map:
    """From each value's offset to the first of the same value in the target."""
    first: dict[bytes, int] = {}
    for offset, value in target:
        first.setdefault(value, offset)
    found = {0: 0} if zero else {}
    for offset, value in sorted(source, key=lambda e: e[0]):
        if value in first:
            found.setdefault(offset, first[value])
    return sorted(found.items())


class _Side:
    """One image and its metadata."""

    def __init__(self, data: bytes, layout: Layout):
        self.data, self.layout = data, layout
        self.cache: dict[int, dict[int, dict[str, int]]] = {}

    def rows(self, table: int) -> dict[int, dict[str, int]]:
        if table not in self.cache:
            self.cache[table] = dict(self.layout.rows(self.data, table))
        return self.cache[table]

    def heap(self, name: str) -> list[tuple[int, bytes]]:
        if name not in self.layout.streams:
            return []
        return list((self.layout.strings if name == "strings" else self.layout.user_strings)(self.data))

    def enclosing(self) -> dict[int, int]:
        """The type around each nested type."""
        n, found = self.layout.counts[TYPE_DEF], {}
        for row in self.rows(NESTED).values():
            if 0 < row["NestedClass"] <= n and 0 < row["EnclosingClass"] <= n:
                found[row["NestedClass"]] = row["EnclosingClass"]
        return found

    def span(self, owner: int, column: str, rid: int, child: int) -> range:
        """Rows of a list: up to where the next owner's begins, or to the end."""
        rows, end = self.rows(owner), self.layout.counts[child] + 1
        start = rows[rid][column]
        stop = rows[rid + 1][column] if rid + 1 in rows else end
        if not 0 < stop <= end:
            stop = end
        return range(start, stop) if 0 < start < end else range(0)


class Builder:
    """Builds a map step by step; each step reads what those before it found."""

    def __init__(self, source: bytes, source_layout: Layout, target: bytes, target_layout: Layout):
        self.source, self.target = _Side(source, source_layout), _Side(target, target_layout)
        self.strings: dict[int, int] = {}
        self.found: dict[int, dict[int, int]] = {}  # by table, rows that have a target
        self.stats: dict[str, dict[str, int]] = {}

    def seeded(self, table: int) -> bool:
        return bool(self.source.layout.counts[table] and self.target.layout.counts[table])

    def build(self) -> tuple[CliMap, Map]:
        """The reduced map, and the map of addresses."""
        result = CliMap()
        for name in ("strings", "user_strings"):
            a, b = self.source.heap(name), self.target.heap(name)
            both = all(name in s.layout.streams for s in (self.source, self.target))
            entries = heap_map(a, b, bool(a or b)) if both else []
            setattr(result, name, entries)
            self.stats[name] = {"source": len(a), "target": len(b), "mapped": sum(s != 0 for s, _ in entries)}
        self.strings = dict(result.strings)
        self.found = {t: {0: 0} for t in range(TABLES) if self.seeded(t)}
        for table, how in STEPS:
            if table in self.found:
                self.stats[f"{table:02x}"] = self._by_list(table, *how) if isinstance(how[0], int) else self._by_key(table, how)
        result.blob, addresses = self._columns()
        for table, rows in self.found.items():
            vector = rift.unset_vector(self.source.layout.counts[table] + 1)
            for s, t in rows.items():
                rift.set_entry(vector, s, t)
            result.tables[table] = rift.reduced(vector, drop_unset=True)
        for name in HEAP_SPACES:
            setattr(result, name, rift.reduced(getattr(result, name), drop_unset=False))
        return result, addresses

    # --- By key -----------------------------------------------------------------------------------------

    def _key(self, table: int, columns: tuple[str, ...], target: bool) -> Callable[[int, dict[str, int]], tuple | None]:
        """A row's key in the target's numbers; None if a part has no counterpart."""
        string = (lambda o: o) if target else self.strings.get
        own = self.found[table]
        row_of = (lambda t, r: r) if target else (lambda t, r: self.found.get(t, {}).get(r))
        enclosing = (self.target if target else self.source).enclosing() if table == TYPE_DEF else {}

        def named(name: int | None, second: int | None) -> tuple | None:
            return None if name is None or second is None else (name, second)

        def namespace(row: dict[str, int]) -> int | None:
            offset = string(row["Namespace"])
            return None if offset is None else offset | NAMESPACE

        def type_key(rid: int, row: dict[str, int]) -> tuple | None:
            owner = enclosing.get(rid) if table == TYPE_DEF else row["ResolutionScope"] >> 2 if row["ResolutionScope"] & 3 == 3 else None
            if owner is None:
                second = namespace(row)
            else:
                second = owner if target else own.get(owner)
            return named(string(row["Name"]), second)

        def value(column: Column, raw: int) -> int | None:
            if column.kind == "strings":
                return string(raw)
            if column.kind == "table":
                return row_of(column.of, raw) if raw else 0
            if column.kind == "coded" and not target:
                of, rid = coded_parts(column.of, raw)
                if rid == 0 or of in (None, SENTINEL):
                    return raw
                bits = CODED[column.of][0]
                mapped = row_of(of, rid)
                return None if mapped is None else mapped << bits | raw & ((1 << bits) - 1)
            return raw

        def key(rid: int, row: dict[str, int]) -> tuple | None:
            parts = tuple(value(c, row[c.name]) for name in columns for c in SCHEMA[table][1] if c.name == name)
            return None if None in parts else parts

        return type_key if table in (TYPE_DEF, TYPE_REF) else key

    def _by_key(self, table: int, columns: tuple[str, ...]) -> dict[str, int]:
        """The k-th source row of a key to the k-th target row of it."""
        waiting: dict[tuple, deque[int]] = defaultdict(deque)
        key, lost, missing = self._key(table, columns, target=True), 0, 0
        for rid, row in self.target.rows(table).items():
            if (k := key(rid, row)) is None:
                lost += 1
            else:
                waiting[k].append(rid)
        key, mapped = self._key(table, columns, target=False), 0
        for rid, row in self.source.rows(table).items():
            k = key(rid, row)
            missing += k is None
            if k is not None and waiting.get(k):
                self.found[table][rid] = waiting[k].popleft()
                mapped += 1
        return {"source": len(self.source.rows(table)), "target": len(self.target.rows(table)), "mapped": mapped, "missing_source": missing, "missing_target": lost}

    # --- By list ----------------------------------------------------------------------------------------

    def _by_list(self, table: int, owner: int, column: str, name: str) -> dict[str, int]:
        """Within each pair of owners, each child in order to the first unused one of its name."""
        stats = {"owners": 0, "mapped": 0, "skipped_owners": 0, "missing_strings": 0}
        if owner not in self.found:
            return stats
        names = {rid: row[name] for rid, row in self.target.rows(table).items()}
        own = self.found[table]
        for rid in self.source.rows(owner):
            other = self.found[owner].get(rid)
            a = self.source.span(owner, column, rid, table)
            b = self.target.span(owner, column, other, table) if other in self.target.rows(owner) else range(0)
            if not a or not b:
                stats["skipped_owners"] += 1
                continue
            stats["owners"] += 1
            for child in a:
                if own.get(child) is not None:
                    break
                wanted = self.strings.get(self.source.rows(table)[child][name])
                if wanted is None:
                    stats["missing_strings"] += 1
                    continue
                match = next((r for r in b if names[r] == wanted), None)
                if match is not None:
                    own[child] = match
                    names[match] = 0
                    stats["mapped"] += 1
        return stats

    # --- Columns ----------------------------------------------------------------------------------------

    def _columns(self) -> tuple[Map, Map]:
        """Blob offsets and addresses of rows that have a target, where neither is zero."""
        blobs, addresses = [(0, 0)], []
        for table in sorted(self.found):
            columns = [c for c in SCHEMA.get(table, ("", ()))[1] if c.kind in ("blob", "rva")]
            if not columns:
                continue
            others = self.target.rows(table)
            for rid, row in self.source.rows(table).items():
                other = others.get(self.found[table].get(rid, 0))
                for c in columns if other else ():
                    s, t = row[c.name], other[c.name]
                    if s and t and c.kind == "blob":
                        blobs.append((s, t))
                    elif s and t:
                        addresses.append((self.source.layout.rva + s, self.target.layout.rva + t))
        order = lambda e: e[0]
        return sorted(blobs, key=order), sorted(addresses, key=order)
