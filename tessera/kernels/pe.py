"""Executable images: headers, sections, data directories, and where addresses lie in the file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.kernels.errors import malformed

# Fixed values of the format.
I386, IA64, AMD64, ARM, ARM64 = 0x014C, 0x0200, 0x8664, 0x01C4, 0xAA64
EXPORT, IMPORT, RESOURCE, EXCEPTION, SECURITY, RELOCATION, DEBUG, CLR = 0, 1, 2, 3, 4, 5, 6, 14
DIRECTORIES = (
    "export", "import", "resource", "exception", "security", "base_relocation", "debug", "architecture",
    "global_ptr", "tls", "load_config", "bound_import", "iat", "delay_import", "clr_runtime", "reserved",
)
EXECUTABLE, READ_WRITE = 0x20000000, 0xC0000000
PE32, PE32_PLUS = 0x10B, 0x20B
CLASSIC = {I386: 0x2, IA64: 0x4, AMD64: 0x8}
CLI4 = {I386: 0x10, AMD64: 0x20, ARM: 0x40, ARM64: 0x80}


def u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def u64(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 8], "little")


def s32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little", signed=True)


def put(data: bytearray, at: int, value: int, n: int = 4) -> None:
    """Write an unsigned integer, cut to its width, if there is room."""
    if 0 <= at and at + n <= len(data):
        data[at : at + n] = (value & ((1 << 8 * n) - 1)).to_bytes(n, "little")


@dataclass
class Section:
    name: str
    va: int
    vsize: int
    raw: int
    raw_size: int
    flags: int

    def holds(self, rva: int) -> bool:
        return self.va <= rva < self.va + max(self.vsize, self.raw_size)

    def holds_offset(self, offset: int) -> bool:
        return self.raw <= offset < self.raw + self.raw_size

    def code(self, size: int) -> tuple[int, int]:
        """The file range of its code, as far as the image goes."""
        return self.raw, min(size, self.raw + min(self.vsize, self.raw_size))

    @property
    def executable(self) -> bool:
        return bool(self.flags & EXECUTABLE)


@dataclass
class Image:
    machine: int
    timestamp: int
    plus: bool
    base: int
    size: int
    checksum: int
    sections: list[Section] = field(default_factory=list)
    directories: list[tuple[int, int]] = field(default_factory=list)
    at: dict[str, int] = field(default_factory=dict)  # file offsets of header fields

    @property
    def pointer(self) -> int:
        return 8 if self.plus else 4

    def directory(self, kind: int) -> tuple[int, int]:
        """RVA and size; zeros if there is none."""
        return self.directories[kind] if kind < len(self.directories) else (0, 0)

    def section(self, rva: int) -> Section | None:
        return next((s for s in self.sections if s.holds(rva)), None)

    def offset(self, rva: int) -> int | None:
        """Where an address is in the file: by the first section that holds it, if that has any bytes."""
        s = self.section(rva)
        return s.raw + rva - s.va if s and s.raw_size else None

    def rva(self, offset: int) -> int | None:
        s = next((s for s in self.sections if s.holds_offset(offset)), None)
        return s.va + offset - s.raw if s else None

    def first_rva(self) -> int:
        return min((s.va for s in self.sections if max(s.vsize, s.raw_size)), default=0)

    @property
    def managed(self) -> bool:
        return self.directory(CLR)[0] != 0


def parse(data: bytes) -> Image:
    """Raises unless there are DOS, PE and optional headers; sections and directories as far as they are there."""
    if len(data) < 0x40 or data[:2] != b"MZ":
        raise malformed("invalid PE: no DOS header")
    pe = u32(data, 0x3C)
    if pe + 24 > len(data) or data[pe : pe + 4] != b"PE\0\0":
        raise malformed("invalid PE: no signature")
    optional, kind = pe + 24, u16(data, pe + 24)
    if kind not in (PE32, PE32_PLUS) or optional + 68 > len(data):
        raise malformed("PE: no optional header")
    plus = kind == PE32_PLUS
    at = {"timestamp": pe + 8, "base": optional + (24 if plus else 28), "checksum": optional + 64, "sections": optional + u16(data, pe + 20)}
    found = Image(u16(data, pe + 4), u32(data, pe + 8), plus, (u64 if plus else u32)(data, at["base"]), u32(data, optional + 56), u32(data, optional + 64), at=at)
    counted = optional + (108 if plus else 92)
    n = min(u32(data, counted), len(DIRECTORIES)) if counted + 4 <= at["sections"] else 0
    for k in range(n):
        place = counted + 4 + 8 * k
        fits = place + 8 <= min(len(data), at["sections"])
        found.directories.append((u32(data, place), u32(data, place + 4)) if fits else (0, 0))
    found.directories += [(0, 0)] * (len(DIRECTORIES) - n)
    for k in range(u16(data, pe + 6)):
        place = at["sections"] + 40 * k
        if place + 40 > len(data):
            break
        name = bytes(data[place : place + 8]).split(b"\0")[0].decode("utf-8", "replace")
        vsize, va, raw_size, raw = (u32(data, place + o) for o in (8, 12, 16, 20))
        found.sections.append(Section(name, va, vsize, raw, raw_size, u32(data, place + 36)))
    return found


def try_parse(data: bytes) -> Image | None:
    try:
        return parse(data)
    except ValueError:
        return None


def parse_lenient(data: bytes) -> Image | None:
    """What can be told of a damaged or cut image: fields that are not there are zero; None only without both signatures."""
    found = try_parse(data)
    if found or len(data) < 0x40 or data[:2] != b"MZ":
        return found
    pe = u32(data, 0x3C)
    if data[pe : pe + 4] != b"PE\0\0":
        return None
    optional = pe + 24
    plus = u16(data, optional) == PE32_PLUS
    base = (u64 if plus else u32)(data, optional + (24 if plus else 28))
    return Image(u16(data, pe + 4), u32(data, pe + 8), plus, base, u32(data, optional + 56), u32(data, optional + 64), directories=[(0, 0)] * len(DIRECTORIES))


def _name(data: bytes, at: int | None) -> str:
    return data[at : data.find(b"\0", at)].decode("latin-1") if at is not None and 0 <= at < len(data) else ""


def imports(data: bytes, image: Image) -> Iterator[tuple[str, str | None, int | None, int]]:
    """(library, name, ordinal, address of the thunk) of every imported function."""
    at, n = image.offset(image.directory(IMPORT)[0]), image.pointer
    while at is not None and at + 20 <= len(data) and any(data[at : at + 20]):
        lookup, name, table = u32(data, at), u32(data, at + 12), u32(data, at + 16)
        place, k = image.offset(lookup or table), 0
        while place is not None and place + n <= len(data) and (value := int.from_bytes(data[place : place + n], "little")):
            if value >> (8 * n - 1):
                yield _name(data, image.offset(name)), None, value & 0xFFFF, table + k
            else:
                where = image.offset(value & 0x7FFFFFFF)
                yield _name(data, image.offset(name)), _name(data, None if where is None else where + 2), None, table + k
            place, k = place + n, k + n
        at += 20


def exports(data: bytes, image: Image) -> Iterator[tuple[int, str | None, int]]:
    """(ordinal, name, address) of every exported function."""
    at = image.offset(image.directory(EXPORT)[0]) if image.directory(EXPORT)[0] else None
    if at is None or at + 40 > len(data):
        return
    base, functions, names = (u32(data, at + o) for o in (16, 20, 24))
    table, pointers, ordinals = (image.offset(u32(data, at + o)) for o in (28, 32, 36))
    named = {}
    if pointers is not None and ordinals is not None:
        for k in range(min(names, max(0, len(data) - pointers) // 4)):
            named.setdefault(u16(data, ordinals + 2 * k), _name(data, image.offset(u32(data, pointers + 4 * k))))
    if table is not None:
        for k in range(min(functions, max(0, len(data) - table) // 4)):
            if rva := u32(data, table + 4 * k):
                yield base + k, named.get(k), rva


def resources(data: bytes, image: Image, depth: int = 3) -> Iterator[tuple[str, int, int]]:
    """(path, address, size) of every resource; the path is of names and numbers. A tree deeper than three levels is cut off."""
    start = image.offset(image.directory(RESOURCE)[0]) if image.directory(RESOURCE)[0] else None

    def entries(at: int, path: tuple[str, ...]) -> Iterator[tuple[str, int, int]]:
        for k in range(u16(data, at + 12) + u16(data, at + 14)):
            place = at + 16 + 8 * k
            if place + 8 > len(data):
                return
            name, to = u32(data, place), u32(data, place + 4)
            if name >> 31:
                text = start + (name & 0x7FFFFFFF)
                label = data[text + 2 : text + 2 + 2 * u16(data, text)].decode("utf-16-le", "replace")
            else:
                label = str(name)
            to_place = start + (to & 0x7FFFFFFF)
            if to >> 31 and len(path) < depth:
                yield from entries(to_place, (*path, label))
            elif not to >> 31 and to_place + 16 <= len(data):
                yield "/".join((*path, label)), u32(data, to_place), u32(data, to_place + 4)

    if start is not None:
        yield from entries(start, ())


def zero_checksum(data: bytearray) -> None:
    if image := try_parse(data):
        put(data, image.at["checksum"], 0)


def timestamp(data: bytes) -> int:
    image = try_parse(data)
    return image.timestamp if image else 0


def timestamp_places(data: bytes) -> list[int]:
    """Where an image may repeat its timestamp: header, export directory, debug entries, and within debug data."""
    image = try_parse(data)
    if not image:
        return []
    found = [image.at["timestamp"]]
    rva, _ = image.directory(EXPORT)
    if rva and (place := image.offset(rva)) is not None:
        found.append(place + 4)
    rva, size = image.directory(DEBUG)
    if not rva or size < 28 or (place := image.offset(rva)) is None:
        return found
    entries = range(place, place + size // 28 * 28, 28)
    found += [e + 4 for e in entries]
    stamp = bytes(data[found[0] : found[0] + 4])
    for e in entries:
        if e + 28 > len(data):
            break
        n, raw = u32(data, e + 16), u32(data, e + 24)
        if not n or not raw or raw + n > len(data):
            continue
        at = bytes(data).find(stamp, raw, raw + n)
        while at >= 0:
            found.append(at)
            at = bytes(data).find(stamp, at + 4, raw + n)
    return found


def replace_timestamps(data: bytearray, old: int, new: int) -> None:
    for at in timestamp_places(data):
        if at + 4 <= len(data) and u32(data, at) == old:
            put(data, at, new)


def normalised(data: bytes) -> bytes:
    """Without its timestamps and checksum, as signatures are taken; other bytes as they are."""
    out = bytearray(data)
    if stamp := timestamp(out):
        replace_timestamps(out, stamp, 0)
        zero_checksum(out)
    return bytes(out)


def section_map(data: bytes) -> list[tuple[int, int]]:
    """From addresses to file offsets, by section; the first of equal addresses holds."""
    image = try_parse(data)
    found = {0: 0}
    for s in sorted(image.sections if image else [], key=lambda s: s.va):
        if s.va and s.raw:
            found.setdefault(s.va, s.raw)
    return sorted(found.items())


def offsets_to_rvas(image: Image) -> list[tuple[int, int]]:
    return sorted([(0, 0), *((s.raw, s.va) for s in image.sections if s.va and s.raw)], key=lambda e: e[0])


def is_native_i386(data: bytes) -> bool:
    """An i386 image that isn't only intermediate code."""
    image = try_parse(data)
    if not image or image.machine != I386 or image.plus:
        return False
    rva, _ = image.directory(CLR)
    if rva:
        for s in image.sections:
            if s.va <= rva < s.va + s.vsize:
                place = s.raw + rva - s.va + 16
                if place + 4 <= len(data):
                    return not u32(data, place) & 1
    return True


def undo_calls(data: bytearray) -> None:
    """Absolute call targets back to relative ones over a whole native i386 image, but for its last ten bytes."""
    if not is_native_i386(data):
        return
    at, size = 0, len(data)
    while 0 <= (at := data.find(b"\xe8", at, max(0, size - 10))):
        value = s32(data, at + 1)
        if -at <= value < size:
            put(data, at + 1, value - at if value >= 0 else value + size)
        at += 5
