"""Piecewise-constant offset maps, written as sorted lists of (source, target): from a source on, positions move by target - source.

Three rules for positions before the first source are in use, each by its own caller: the last entry's offset
(offset_wrapping), zero (offset_or_zero), and that of a head entry at position 0 (OffsetTable).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from tessera.kernels.bits import BitReader, BitWriter, signed
from tessera.kernels.errors import malformed
from tessera.kernels.huffman import Huffman, for_frequencies

Map = list[tuple[int, int]]
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
UNSET = HIGHEST
HALF, SYMBOLS = 126, 252


# --- Signed integers by Huffman codes -----------------------------------------------------------------------


class IntFormat:
    """Half of the symbols are for integers from 0 on, half for those below, as their bitwise complement."""

    def __init__(self, code: Huffman):
        self.code = code

    @classmethod
    def default(cls) -> IntFormat:
        return cls(Huffman([7] * 4 + [8] * (SYMBOLS - 4)))

    @classmethod
    def read(cls, reader: BitReader) -> IntFormat:
        given, below, default_count = reader.bits(8), reader.bits(8), reader.bits(8)
        if max(given, below) > HALF or default_count > SYMBOLS - given - below:
            raise malformed("integer format out of range")
        lengths = [0] * SYMBOLS
        for start, n in ((0, given), (HALF, below)):
            lengths[start : start + n] = [reader.bits(4) + 1 for _ in range(n)]
        default = reader.bits(4) + 1

        def fill(first: int, stop: int, left: int, more) -> None:
            length = default
            for i in range(first, stop):
                if left == 0:
                    length, left = max(0, length - 1), max(0, more(i))
                lengths[i] = length
                left = max(0, left - 1)

        fill(given, HALF, default_count, lambda i: SYMBOLS - given - below - i)
        fill(HALF + below, SYMBOLS, max(0, default_count - (HALF - given)), lambda i: SYMBOLS - i)
        return cls(Huffman(lengths))

    @staticmethod
    def _split(value: int) -> tuple[int, int, int]:
        """Symbol, extra bits, their number."""
        size, start = (value, 0) if value >= 0 else (~value, HALF)
        if size <= 3:
            return start + size, 0, 0
        half = size.bit_length() - 2
        return start + 2 * half + (size >> half), size & ((1 << half) - 1), half

    @classmethod
    def for_values(cls, values: list[int]) -> IntFormat:
        counts = [1] * SYMBOLS
        for v in values:
            counts[cls._split(v)[0]] += 1
        return cls(for_frequencies(counts))

    def write(self, writer: BitWriter) -> None:
        for n in (HALF, HALF, 0):
            writer.bits(n, 8)
        for length in self.code.lengths:
            writer.bits(max(length, 1) - 1, 4)
        writer.bits(0, 4)

    def read_number(self, reader: BitReader) -> int:
        symbol = self.code.read(reader)
        size = symbol % HALF
        if size > 3:
            half = size // 2 - 1
            size = (2 + (size & 1)) << half | reader.bits(half)
        return signed(~size if symbol >= HALF else size)

    def write_number(self, writer: BitWriter, value: int) -> None:
        symbol, extra, n = self._split(value)
        self.code.write(writer, symbol)
        writer.bits(extra, n)


# --- Stored form --------------------------------------------------------------------------------------------


def read_entries(reader: BitReader, sources: IntFormat, offsets: IntFormat) -> Map:
    n = reader.varint()
    if not 0 <= n <= reader.remaining():
        raise malformed("map entry count exceeds available input")
    source = offset = 0
    found = []
    for _ in range(n):
        source = signed(source + sources.read_number(reader))
        offset = signed(offset + offsets.read_number(reader))
        found.append((source, signed(source + offset)))
    return sorted(found, key=lambda e: e[0])


def read_map(reader: BitReader) -> Map:
    if not reader.bits(1):
        return []
    return read_entries(reader, IntFormat.read(reader), IntFormat.read(reader))


def _changes(entries: Map) -> Iterator[tuple[int, int]]:
    source = offset = 0
    for s, t in entries:
        yield signed(s - source), signed(t - s - offset)
        source, offset = s, t - s


def write_entries(writer: BitWriter, entries: Map, sources: IntFormat, offsets: IntFormat) -> None:
    writer.varint(len(entries))
    for s, o in _changes(entries):
        sources.write_number(writer, s)
        offsets.write_number(writer, o)


def formats_for(maps: list[Map]) -> tuple[IntFormat, IntFormat]:
    changes = [c for entries in maps for c in _changes(entries)]
    return IntFormat.for_values([s for s, _ in changes]), IntFormat.for_values([o for _, o in changes])


def write_map(writer: BitWriter, entries: Map) -> None:
    writer.bits(bool(entries), 1)
    if entries:
        sources, offsets = formats_for([entries])
        sources.write(writer)
        offsets.write(writer)
        write_entries(writer, entries, sources, offsets)


# --- Lookups ------------------------------------------------------------------------------------------------


def _at_or_before(entries: Map, position: int) -> int:
    """Index of the entry that holds at a position, -1 before the first; of equal sources the last."""
    return bisect_right(entries, position, key=lambda e: e[0]) - 1


def offset_wrapping(entries: Map, position: int) -> int:
    """Offset at a position; before the first source, the last entry's."""
    if not entries:
        return 0
    s, t = entries[_at_or_before(entries, position)]
    return signed(t - s)


def offset_or_zero(entries: Map, position: int) -> int:
    """Offset at a position; before the first source, none."""
    k = _at_or_before(entries, position)
    return signed(entries[k][1] - entries[k][0]) if k >= 0 else 0


def exact_target(entries: Map, position: int) -> int | None:
    k = bisect_left(entries, position, key=lambda e: e[0])
    return entries[k][1] if k < len(entries) and entries[k][0] == position else None


class OffsetTable:
    """Offsets by position, led by an entry at 0 with the last offset. Negative sources may make it unsorted; it stays so."""

    def __init__(self, entries: Map):
        last = signed(entries[-1][1] - entries[-1][0]) if entries else 0
        self.positions = [0, *(s for s, _ in entries)]
        self.offsets = [last, *(signed(t - s) for s, t in entries)]

    def segment(self, position: int) -> tuple[int, int]:
        """Offset at a position, and where the next entry begins."""
        k = max(0, bisect_right(self.positions, position) - 1)
        return self.offsets[k], self.positions[k + 1] if k + 1 < len(self.positions) else HIGHEST

    def offset(self, position: int) -> int:
        return self.segment(position)[0]


# --- Algebra ------------------------------------------------------------------------------------------------


def _pieces(entries: Map) -> Iterator[tuple[int, int, int]]:
    """(first, last, offset) of the pieces that cover all positions; of equal sources the last holds."""
    if entries[0][0] > LOWEST:
        yield LOWEST, entries[0][0] - 1, signed(entries[-1][1] - entries[-1][0])
    for (s, t), following in zip(entries, [*entries[1:], (HIGHEST + 1, 0)], strict=True):
        if following[0] != s:
            yield s, following[0] - 1, signed(t - s)


def compose(first: Map, then: Map) -> Map:
    """The map that moves by `first`, then by `then`. An empty map moves nothing."""
    if not first or not then:
        return list(first or then)
    pieces = list(_pieces(then))
    begins = [b for b, _, _ in pieces]
    found = []
    for begin, end, offset in _pieces(first):
        at = begin
        while at <= end:
            image = signed(at + offset)
            _, last, further = pieces[bisect_right(begins, image) - 1]
            found.append((at, signed(image + further)))
            at += last - image + 1
    return sorted(found, key=lambda e: e[0])


def inverse(entries: Map) -> Map:
    """From targets back to sources. Where several pieces have the same image the first in order has it.

    The order goes up from position 0, round from the highest position to the lowest, to the source of the piece
    that position 0 is in.
    """
    if not entries:
        return []
    if all(s == entries[0][0] for s, _ in entries):
        return [(0, signed(entries[0][1] - entries[0][0]))]
    n = len(entries)
    above = bisect_right(entries, 0, key=lambda e: e[0])
    home = (above - 1) % n
    covered: list[tuple[int, int]] = []  # apart from each other, sorted, ends excluded
    found = []

    def cover(begin: int, end: int, offset: int) -> None:
        low = bisect_left(covered, begin, key=lambda c: c[1])
        high = bisect_right(covered, end, key=lambda c: c[0])
        gap = begin
        for b, e in covered[low:high]:
            if gap < b:
                found.append((gap, signed(gap - offset)))
            gap = e
        if gap < end:
            found.append((gap, signed(gap - offset)))
        if low < high:
            begin, end = min(begin, covered[low][0]), max(end, covered[high - 1][1])
        covered[low:high] = [(begin, end)]

    at, turn = 0, home
    for k in range(n):
        following = (home + 1 + k) % n
        offset = signed(entries[turn][1] - entries[turn][0])
        span = (entries[following][0] - at) & ((1 << 64) - 1)
        while span:
            begin = signed(at + offset)
            step = min(span, HIGHEST + 1 - begin)
            cover(begin, begin + step, offset)
            at, span = signed(at + step), span - step
        turn = following
    found.sort(key=lambda e: e[0])
    return list({s: (s, t) for s, t in found if LOWEST not in (s, t)}.values())


def total(a: Map, b: Map) -> Map:
    """Both offsets added, at the breaks of either; breaks that change nothing go."""
    if not a or not b:
        return list(a or b)
    found: Map = []
    for s in sorted({s for s, _ in a} | {s for s, _ in b}):
        offset = signed(offset_wrapping(a, s) + offset_wrapping(b, s))
        if not found or signed(found[-1][1] - found[-1][0]) != offset:
            found.append((s, signed(s + offset)))
    return found


def merged(a: Map, b: Map) -> Map:
    """Entries of both; those of equal source stay in order, a's first."""
    return sorted([*a, *b], key=lambda e: e[0])


def moved(entries: Map, by: int) -> Map:
    """Sources moved, targets kept, in order again."""
    return sorted(((signed(s + by), t) for s, t in entries), key=lambda e: e[0])


def vote(targets: list[int]) -> int:
    """The target that is left when different ones cancel out, in order; a majority always is."""
    kept, lead = targets[0], 1
    for t in targets[1:]:
        if t == kept:
            lead += 1
        elif lead:
            lead -= 1
        else:
            kept, lead = t, 1
    return kept


def reduced(entries: Map, drop_unset: bool) -> Map:
    """One entry a source, by vote, and none that repeats the offset before it; the map that moves nothing is empty."""
    found: Map = []
    at = 0
    while at < len(entries):
        source, target = entries[at]
        if drop_unset and target == UNSET:
            at += 1
            continue
        end = at + 1
        while end < len(entries) and entries[end][0] == source:
            end += 1
        target = vote([t for _, t in entries[at:end]])
        if not found or signed(found[-1][1] - found[-1][0]) != signed(target - source):
            found.append((source, target))
        at = end
    if len(found) == 1:
        source, target = found[0]
        return [] if source == target else [(0, signed(target - source))]
    if found and signed(found[0][1] - found[0][0]) == signed(found[-1][1] - found[-1][0]):
        del found[0]
    return found


def unset_vector(n: int) -> Map:
    return [(i, UNSET) for i in range(n)]


def set_entry(vector: Map, source: int, target: int) -> None:
    if 0 <= source < len(vector) and vector[source][0] == source:
        vector[source] = source, target
