"""Rewriting a reference image as it would look at the target's addresses, so that more of it can be copied.

Transforms run in a fixed order over one buffer. Each marks the bytes that it owns, which keeps later ones that look
for instructions from touching them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from tessera.kernels import pe, x64
from tessera.kernels.bits import signed
from tessera.kernels.pe import Image, put, s32, u16, u32, u64
from tessera.kernels.rift import Map, offset_or_zero

# Flags of a delta's header.
UNDO_CALLS, NON_CODE, IMPORTS, EXPORTS, RESOURCES, RELOCATIONS = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
JUMPS_X86, CALLS_X86, CODE_X64, PDATA_X64, UNBIND, CLI_CODE, CLI_METADATA = 0x80, 0x100, 0x200, 0x400, 0x2000, 0x4000, 0x8000
DESCRIPTORS, DESCRIPTOR, HIGH = 4096, 20, 1 << 31


class Rewriter:
    """A buffer, its image, the map of addresses, and the marks."""

    def __init__(self, data: bytearray, image: Image, addresses: Map, base: int):
        self.data, self.image, self.addresses, self.base = data, image, addresses, base
        self.marks = bytearray(len(data))

    def moved(self, rva: int) -> int:
        return rva + offset_or_zero(self.addresses, rva)

    def mark(self, at: int, n: int) -> None:
        for k in range(at, min(at + n, len(self.marks))):
            self.marks[k] |= 1

    def marked(self, at: int, n: int = 1) -> bool:
        return any(m & 1 for m in self.marks[at : at + n])

    def field(self, at: int) -> None:
        """Move an address that is a field; zero is no address."""
        if value := u32(self.data, at):
            put(self.data, at, self.moved(value))
        self.mark(at, 4)

    def pointer(self, at: int, n: int) -> None:
        """Move an address that counts from the image's base, to the target's."""
        value = s32(self.data, at) if n == 4 else signed(u64(self.data, at))
        put(self.data, at, self.base + self.moved(signed(value - self.image.base)), n)
        self.mark(at, n)

    def place(self, rva: int) -> int | None:
        return self.image.offset(rva) if 0 <= rva < 1 << 32 else None

    def directory(self, kind: int) -> tuple[int, int, int] | None:
        """RVA, size and place of a data directory."""
        rva, size = self.image.directory(kind)
        place = self.image.offset(rva) if rva else None
        return None if place is None else (rva, size, place)

    # --- Imports ----------------------------------------------------------------------------------------

    def descriptors(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Place, lookup table, timestamp, name and address table of each import descriptor."""
        found = self.directory(pe.IMPORT)
        for k in range(DESCRIPTORS if found else 0):
            at = found[2] + DESCRIPTOR * k
            if at + DESCRIPTOR > len(self.data):
                return
            lookup, stamp, _, name, table = (u32(self.data, at + o) for o in range(0, DESCRIPTOR, 4))
            if not (lookup or name or table):
                return
            yield at, lookup, stamp, name, table

    def thunks(self, rva: int) -> Iterator[tuple[int, int]]:
        """Place and value of each entry of a table, up to a zero."""
        at, n = self.place(rva) if rva else None, self.image.pointer
        while at is not None and at + n <= len(self.data):
            value = int.from_bytes(self.data[at : at + n], "little")
            if not value:
                return
            yield at, value
            at += n

    def unbind(self) -> None:
        """Imports as before binding: no timestamp, and the lookup table over the address table."""
        n = self.image.pointer
        for at, lookup, stamp, _, table in list(self.descriptors()):
            if not stamp:
                continue
            put(self.data, at + 4, 0, 8)
            source, to = self.place(lookup), self.place(table)
            if source is None or to is None:
                continue
            while source + n <= len(self.data) and to + n <= len(self.data) and any(self.data[source : source + n]):
                self.data[to : to + n] = self.data[source : source + n]
                source, to = source + n, to + n
        for k, s in enumerate(self.image.sections):
            if s.name == ".idata":
                put(self.data, self.image.at["sections"] + 40 * k + 36, s.flags | pe.READ_WRITE)

    def imports(self) -> None:
        n = self.image.pointer
        for at, lookup, stamp, _, table in self.descriptors():
            for rva, bound in ((lookup, False), (table, stamp != 0)):
                for place, value in self.thunks(rva):
                    if bound:
                        put(self.data, place, self.base + self.moved(signed(value - self.image.base)), n)
                    elif not value >> (8 * n - 1):  # not by ordinal
                        self.field(place)
                    self.mark(place, n)
            for o in (12, 0, 16):
                self.field(at + o)

    # --- Other directories ------------------------------------------------------------------------------

    def exports(self) -> None:
        found = self.directory(pe.EXPORT)
        if not found or found[2] + 40 > len(self.data):
            return
        at = found[2]
        for count, array in ((20, 28), (24, 32)):
            rva, n = u32(self.data, at + array), u32(self.data, at + count)
            place = self.place(rva) if rva else None
            if place is not None:
                for k in range(min(n, max(0, len(self.data) - place) // 4)):
                    self.field(place + 4 * k)
        for o in (12, 28, 32, 36):
            self.field(at + o)

    def resources(self) -> None:
        """The tree's offsets count from the directory, so they move by how addresses in it move apart."""
        found = self.directory(pe.RESOURCE)
        if not found:
            return
        rva, size, top = found
        end, home = min(top + size, len(self.data)), self.moved(rva)
        moved = lambda offset: (self.moved(rva + offset) - home) & 0xFFFFFFFF

        def high(at: int, value: int) -> None:
            put(self.data, at, HIGH | moved(value & ~HIGH) & ~HIGH)
            self.mark(at, 4)

        waiting, seen = [top], set()
        while waiting:
            folder = waiting.pop()
            if folder in seen or folder < top or folder + 16 > end:
                continue
            seen.add(folder)
            n = min(u16(self.data, folder + 12) + u16(self.data, folder + 14), (end - folder - 16) // 8)
            for at in range(folder + 16, folder + 16 + 8 * n, 8):
                name, child = u32(self.data, at), u32(self.data, at + 4)
                place = top + (child & ~HIGH)
                if child & HIGH:
                    if at < place and place + 16 <= end:
                        waiting.append(place)
                    high(at + 4, child)
                elif place + 16 <= end:
                    put(self.data, place, moved(u32(self.data, place)))
                    self.mark(place, 4)
                if name & HIGH:
                    high(at, name)

    def non_code(self) -> None:
        """All bytes but those of executable sections are owned."""
        for k in range(len(self.marks)):
            self.marks[k] |= 1
        for s in self.image.sections:
            if s.executable:
                start, end = s.code(len(self.data))
                for k in range(start, end):
                    self.marks[k] &= ~1

    # --- Relocations ------------------------------------------------------------------------------------

    def relocation_entries(self) -> Iterator[tuple[int, int, int]]:
        """Address, type and trailing word of each entry of the blocks; type 0 ends a block."""
        found = self.directory(pe.RELOCATION)
        if not found:
            return
        at, end = found[2], min(found[2] + found[1], len(self.data))
        while at + 8 <= end:
            page, size = u32(self.data, at), u32(self.data, at + 4)
            if size < 8 or at + size > end:
                return
            words = iter([u16(self.data, o) for o in range(at + 8, at + 8 + (size - 8) // 2 * 2, 2)])
            for word in words:
                if not word >> 12:
                    break
                yield page + (word & 0xFFF), word >> 12, next(words, 0) if word >> 12 == 4 and self.place(page + (word & 0xFFF)) is not None else 0
            at += size

    def relocations(self) -> None:
        """Move what entries point to, and the entries; they are written again in blocks by page."""
        found = self.directory(pe.RELOCATION)
        if not found:
            return
        entries = []
        for rva, kind, extra in list(self.relocation_entries()):
            place = self.place(rva)
            if place is not None:
                if kind == 3:
                    self.pointer(place, 4)
                elif kind == 10:
                    self.pointer(place, 8)
                elif kind in (1, 2, 4):
                    self.mark(place, 2)
                else:
                    kind = 0
            entries.append((self.moved(rva) & 0xFFFFFFFF, kind, extra))
        entries.sort(key=lambda e: e[0])
        rva, size, top = found
        section = self.image.section(rva)
        room = max(size, section.raw_size - (rva - section.va) if section else 0) & ~1
        self._write_blocks(entries, top, min(top + room, len(self.data)))

    def _write_blocks(self, entries: list[tuple[int, int, int]], at: int, end: int) -> None:
        for page, block in groupby(entries, lambda e: e[0] & ~0xFFF):
            block = list(block)
            while block and at + 8 <= end:
                header, at = at, at + 8
                words = 0
                while block and at + 2 <= end:
                    rva, kind, extra = block.pop(0)
                    put(self.data, at, kind << 12 | rva & 0xFFF, 2)
                    at, words = at + 2, words + 1
                    if kind == 4 and at + 2 <= end:
                        put(self.data, at, extra, 2)
                        at, words = at + 2, words + 1
                if words % 2 and at + 2 <= end:
                    put(self.data, at, 0, 2)
                    at += 2
                put(self.data, header, page)
                put(self.data, header + 4, at - header)

    # --- Code -------------------------------------------------------------------------------------------

    def code(self) -> Iterator[tuple[pe.Section, int, int]]:
        for s in self.image.sections:
            if s.executable:
                start, end = s.code(len(self.data))
                if end >= 5:
                    yield s, start, end

    def _new_displacement(self, section: pe.Section, at: int, displacement: int) -> int | None:
        """For a branch of five bytes; None if it goes nowhere or where bytes are owned."""
        after = section.va + at - section.raw + 5
        target = (after + displacement) & 0xFFFFFFFF
        first = self.image.first_rva()
        if not 0 < target < self.image.size or (target >= first and self.image.section(target) is None):
            return None
        place = target if target < first else self.place(target)
        if self.marked(target if place is None else place):
            return None
        return s32((self.moved(target) - self.moved(after) & 0xFFFFFFFF).to_bytes(4, "little"), 0)

    def calls_x86(self) -> None:
        for s, at, end in self.code():
            while 0 <= (at := self.data.find(b"\xe8", at, max(0, end - 4))):
                new = None if self.marked(at, 5) else self._new_displacement(s, at, s32(self.data, at + 1))
                if new is None:
                    at += 1
                else:
                    put(self.data, at + 1, new)
                    at += 5

    def jumps_x86(self) -> None:
        """Near jumps, which become short where the new distance fits and the opcode isn't owned."""
        data = self.data
        for s, at, end in self.code():
            while at + 5 <= end:
                conditional = data[at] == 0x0F and data[at + 1] & 0xF0 == 0x80
                if not conditional and data[at] != 0xE9:
                    at += 1
                    continue
                last = at + conditional  # of the opcode
                near = last + 5 <= len(data) and not self.marked(last, 5)
                old = s32(data, last + 1) if near else 0
                new = self._new_displacement(s, last, old) if near and not -0x80 <= old < 0x80 else None
                if new is None:
                    at += 1
                    continue
                if -0x80 <= new < 0x80 and not (conditional and self.marked(at)):
                    data[at], data[at + 1] = (0x70 | data[last] & 15 if conditional else 0xEB), new & 255
                else:
                    put(data, last + 1, new)
                at = last + 5

    def functions(self) -> Iterator[int]:
        """Places of the records of functions."""
        found = self.directory(pe.EXCEPTION)
        if found and self.addresses:
            size = min(found[1], max(0, len(self.data) - found[2]))
            yield from range(found[2], found[2] + size // 12 * 12, 12)

    def code_x64(self) -> None:
        """Displacements relative to the next instruction, function by function."""
        for record in self.functions():
            rva, end = u32(self.data, record), u32(self.data, record + 4)
            at = self.place(rva) if rva else None
            while at is not None and rva < end and at < len(self.data):
                n, relative = x64.decode(self.data[at : at + min(end - rva, x64.LONGEST)])
                if not n:
                    break
                if relative is not None:
                    following = rva + n
                    put(self.data, at + relative, self.moved(following + s32(self.data, at + relative)) - self.moved(following))
                rva, at = rva + n, at + n

    def pdata_x64(self) -> None:
        """Function records, and the first slot after the codes of their unwind information."""
        found = self.directory(pe.EXCEPTION)
        for record in self.functions():
            unwind = u32(self.data, record + 8)
            place = unwind if 0 < unwind < self.image.first_rva() else self.place(unwind) if unwind else None
            if place is not None and not found[2] <= place < found[2] + found[1] and place + 4 <= len(self.data) and self.data[place] & 0x38:
                slot = place + 4 + (self.data[place + 2] + 1 >> 1) * 4
                if slot + 4 <= len(self.data) and (value := u32(self.data, slot)):
                    put(self.data, slot, self.moved(value))
            for at in (record, record + 4, record + 8):
                if value := u32(self.data, at):
                    put(self.data, at, self.moved(value))


#: Flag, machine it is for (None: any) and method, in the order in which they run.
ORDER = (
    (NON_CODE, pe.I386, Rewriter.non_code),
    (IMPORTS, None, Rewriter.imports),
    (EXPORTS, None, Rewriter.exports),
    (RESOURCES, None, Rewriter.resources),
    (RELOCATIONS, None, Rewriter.relocations),
    (JUMPS_X86, pe.I386, Rewriter.jumps_x86),
    (CALLS_X86, pe.I386, Rewriter.calls_x86),
    (CODE_X64, pe.AMD64, Rewriter.code_x64),
    (PDATA_X64, pe.AMD64, Rewriter.pdata_x64),
)


def transformed(data: bytearray, image: Image, addresses: Map, flags: int, base: int, stamp: int) -> None:
    """Rewrite data in place: imports unbound, the target's timestamp, the transforms asked for, the target's base."""
    rewriter = Rewriter(data, image, addresses, base)
    if flags & UNBIND:
        rewriter.unbind()
    put(data, image.at["timestamp"], stamp)
    for flag, machine, run in ORDER:
        if flags & flag and machine in (None, image.machine):
            run(rewriter)
    put(data, image.at["base"], base, image.pointer)
