"""The delta codec: literals and copies over the reference followed by the output, with offsets relative to a map.

Positions count through the reference, then the output. A copy's distance is coded by class: relative to the map's
offset (three ranges), exactly the map's offset ("along the map"), one of the last three distances, or absolute.
"""

from __future__ import annotations

from collections.abc import Iterator

from tessera.kernels import rift
from tessera.kernels.bits import BitReader, BitWriter
from tessera.kernels.errors import malformed
from tessera.kernels.huffman import Huffman, for_frequencies, of_lengths

# Fixed values of the format.
MAIN, LENGTHS, ALIGNED, PRETREE = 600, 256, 16, 39
ALONG_MAP, RECENT, ABSOLUTE = 3, 4, 7  # offset slots; below 3: relative
RELATIVE = ((14, -0x2000, 0x2000), (16, -0xA000, 0xA000), (18, -0x2A000, 0x2A000))  # bits, least, end
FAR = ((2, 36), (3, 40), (4, 48))  # bits and base of the escapes of slot 7
MAX_SEGMENTS = 1024


class Tables:
    def __init__(self, lengths: list[int]):
        self.main = of_lengths(tuple(lengths[:MAIN]))
        self.lengths = of_lengths(tuple(lengths[MAIN : MAIN + LENGTHS]))
        self.aligned = of_lengths(tuple(lengths[MAIN + LENGTHS :]))


def _even_lengths(n: int) -> list[int]:
    """Code lengths of n symbols of equal weight: the first ones are a bit shorter."""
    bits = (n - 1).bit_length()
    short = (1 << bits) - n
    return [bits - 1] * short + [bits] * (n - short)


EVEN = _even_lengths(MAIN) + _even_lengths(LENGTHS) + _even_lengths(ALIGNED)


# --- Decoding -----------------------------------------------------------------------------------------------


def _read_lengths(reader: BitReader, pretree: Huffman, before: list[int]) -> list[int]:
    """Code lengths of a segment, coded against those of the one before."""
    found: list[int] = []
    while len(found) < len(before):
        symbol, at = pretree.read(reader), len(found)
        if symbol <= 16:
            found.append(symbol)
        elif symbol < 23:
            found.append(before[at] + (symbol - 16 if symbol < 20 else 19 - symbol) & 0xFF)
        else:
            repeats_before, slot = divmod(symbol - 23, 8)
            n = slot + 1 if slot < 3 else 1 << (slot - 1) | reader.bits(slot - 1)
            if at + n > len(before):
                raise malformed("run of code lengths past their end")
            if not repeats_before and not at:
                raise malformed("run of code lengths at their start")
            found += before[at : at + n] if repeats_before else [found[-1]] * n
    if max(found) > 16:
        raise malformed("code length exceeds maximum")
    return found


def read_segments(reader: BitReader) -> tuple[list[int], list[Tables]]:
    """Where segments begin, and their tables."""
    n = reader.varint()
    if not 0 < n <= MAX_SEGMENTS:
        raise malformed("invalid segment count")
    begins, at = [], 0
    for _ in range(n):
        at += reader.varint()
        begins.append(at)
    pretree = Huffman([reader.bits(4) for _ in range(PRETREE)])
    lengths, tables = [0] * len(EVEN), []
    for _ in range(n):
        lengths = _read_lengths(reader, pretree, lengths)
        tables.append(Tables(lengths))
    return begins, tables


def _read_distance(slot: int, tables: Tables, reader: BitReader) -> int:
    """The number that an absolute slot codes."""
    k = slot - ABSOLUTE
    if k == 0:
        for bits, base in FAR[:2]:
            if not reader.bits(1):
                k = base + reader.bits(bits)
                break
        else:
            k = FAR[2][1] + reader.bits(FAR[2][0])
    if k > 63:
        raise malformed("offset slot too large")
    if k < 4:
        return k
    half, number = k // 2 - 1, 2 + (k & 1)
    if half < 4:
        return number << half | reader.bits(half)
    number = number << (half - 4) | reader.bits(half - 4)
    return number << 4 | tables.aligned.read(reader)


def _read_length(slot: int, tables: Tables, reader: BitReader) -> int:
    if slot:
        return slot + 1
    symbol = tables.lengths.read(reader)
    return (symbol or reader.big_number()) + 8


def _read_relative(slot: int, reader: BitReader) -> int:
    """Values outside the range of the slot before, those below it first."""
    bits, least, end = RELATIVE[slot]
    raw = reader.bits(bits)
    if not slot:
        return raw + least
    _, inner_least, inner_end = RELATIVE[slot - 1]
    below = inner_least - least
    return raw + least if raw < below else raw - below + inner_end


class Output:
    """The output so far, after the reference; with provenance, where each byte was copied from (-1: a literal)."""

    def __init__(self, reference: bytes, provenance: bool):
        self.reference, self.out = reference, bytearray()
        self.origin: list[int] | None = [] if provenance else None

    def literal(self, byte: int) -> None:
        self.out.append(byte)
        if self.origin is not None:
            self.origin.append(-1)

    def copy(self, start: int, n: int) -> None:
        """n bytes from a position that counts through reference and output."""
        out, origin, known = self.out, self.origin, len(self.reference)
        if start < 0:
            raise malformed("copy from before the reference")
        if start < known:
            k = min(n, known - start)
            out += self.reference[start : start + k]
            if origin is not None:
                origin.extend(range(start, start + k))
            start, n = start + k, n - k
        start -= known
        while n:
            k = min(n, len(out) - start)
            if k <= 0:
                raise malformed("copy from past the output")
            out += out[start : start + k]
            if origin is not None:
                origin.extend(origin[start : start + k])
            start, n = start + k, n - k


def decompress(reference: bytes, data: bytes, size: int, caller_map: rift.Map | None = None, provenance: bool = False) -> Output:
    """The target of a size; caller_map joins the map that the data carry."""
    result = Output(reference, provenance)
    if not data:
        if size:
            raise malformed("no data for a target that is not empty")
        return result
    try:
        _decompress(result, data, size, caller_map)
    except ValueError as error:
        error.partial = bytes(result.out)  # what was decoded before the fault
        raise
    return result


def _decompress(result: Output, data: bytes, size: int, caller_map: rift.Map | None) -> None:
    reader = BitReader(data)
    known = len(result.reference)
    entries = rift.merged(rift.merged(rift.read_map(reader), caller_map or []), [(known, 0)])
    table = rift.OffsetTable(entries)
    if reader.bits(1):
        begins, segments = [0], [Tables(EVEN)]
    else:
        begins, segments = read_segments(reader)
    current, recent, at, end = 0, [0, 0, 0], known, known + size
    while at < end:
        if not reader.remaining():
            raise malformed("data end before the target")
        while current + 1 < len(segments) and at >= begins[current + 1]:
            current += 1
        tables = segments[current]
        symbol = tables.main.read(reader)
        if symbol < 256:
            result.literal(symbol)
            at += 1
            continue
        slot, length_slot = divmod(symbol - 256, 8)
        if slot < ALONG_MAP:
            distance = _read_relative(slot, reader) - table.offset(at)
        elif slot == ALONG_MAP:
            distance = -table.offset(at)
        elif slot < ABSOLUTE:
            distance = recent[slot - RECENT]
        else:
            distance = _read_distance(slot, tables, reader)
        n = min(_read_length(length_slot, tables, reader), end - at)
        remember(recent, distance)
        if slot != ALONG_MAP:
            result.copy(at - distance, n)
            at += n
            continue
        while n:  # the map may move on within a copy
            offset, following = table.segment(at)
            k = min(n, max(1, following - at))
            result.copy(at + offset, k)
            at, n = at + k, n - k


def remember(recent: list[int], distance: int) -> None:
    """The latest distance to the front, unless it is there; the third goes unless the second repeats it."""
    if recent[0] != distance:
        recent[:] = [distance, recent[0], recent[2] if recent[1] == distance else recent[1]]


# --- Encoding -----------------------------------------------------------------------------------------------

GRAM, CHAIN, LONG, BOUNDARY, SPLIT, MOST_PARTS = 4, 12, 96, 512 << 10, 256 << 10, 8


def _distance_slot(distance: int) -> tuple[int, int, int, int | None]:
    """Slot, extra bits, their number, and the low nibble for the aligned table."""
    if distance < 4:
        return ABSOLUTE + distance, 0, 0, None
    half = distance.bit_length() - 2
    slot = ABSOLUTE + 2 * (half + 1) + (distance >> half & 1)
    if half < 4:
        return slot, distance & ((1 << half) - 1), half, None
    return slot, distance >> 4 & ((1 << (half - 4)) - 1), half - 4, distance & 15


def _classify(distance: int, offset: int, recent: list[int]) -> tuple[int, int, int, int | None] | None:
    """The cheapest slot for a distance, with its extra bits; None if no slot reaches it."""
    if distance == -offset:
        return ALONG_MAP, 0, 0, None
    if distance in recent:
        return RECENT + recent.index(distance), 0, 0, None
    found = []
    relative = distance + offset
    for slot, (bits, least, end) in enumerate(RELATIVE):
        if least <= relative < end:
            raw = relative - least
            if slot:
                _, inner_least, inner_end = RELATIVE[slot - 1]
                raw = raw if relative < inner_least else relative - inner_end + inner_least - least
            found.append((slot, raw, bits, None))
            break
    if distance > 0 and (own := _distance_slot(distance))[0] < (MAIN - 256) // 8:
        found.append(own)
    return min(found, key=lambda c: c[2] + 3 * (c[3] is not None), default=None)


def _match_length(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a on equal those from b on."""
    n, step = 0, 32
    while n < most:
        step = min(step, most - n)
        if data[a + n : a + n + step] == data[b + n : b + n + step]:
            n += step
            step *= 4
        elif step == 1:
            break
        else:
            step = max(1, step // 8)
            while n < most and data[a + n : a + n + step] == data[b + n : b + n + step] and step > 1:
                n += step
            while n < most and data[a + n] == data[b + n]:
                n += 1
            break
    return min(n, most)


Step = tuple[int, tuple[int, int, int, "int | None"] | None]  # length and offset class; or byte and None


class _Finder:
    def __init__(self, reference: bytes, target: bytes, table: rift.OffsetTable):
        self.data, self.known, self.table = reference + target, len(reference), table
        self.places: dict[bytes, list[int]] = {}
        stride = 1 if len(reference) <= 1 << 18 else 2
        self.add_all(0, max(0, len(reference) - GRAM + 1), stride)

    def add(self, at: int) -> None:
        key = self.data[at : at + GRAM]
        if len(key) == GRAM:
            held = self.places.get(key)
            if held is None:
                self.places[key] = [at]
            else:
                held.append(at)
                if len(held) > 2 * CHAIN:
                    del held[:CHAIN]

    def add_all(self, start: int, stop: int, step: int) -> None:
        """add() for a range of places."""
        data, places = self.data, self.places
        for at in range(start, min(stop, len(data) - GRAM + 1), step):
            key = data[at : at + GRAM]
            if key in places:
                held = places[key]
                held.append(at)
                if len(held) > 2 * CHAIN:
                    del held[:CHAIN]
            else:
                places[key] = [at]

    def best(self, at: int, recent: list[int]) -> tuple[int, int, int, tuple] | None:
        """(value, length, distance, class) of the best copy at a position."""
        data, most = self.data, len(self.data) - at
        if most < 2:
            return None
        offset, following = self.table.segment(at)
        found, need = None, data[at : at + 2]  # a copy without these first bytes is worth no more than the one found
        candidates = [at + offset, *(at - d for d in recent)]
        if held := self.places.get(data[at : at + GRAM]):
            candidates += held[: -CHAIN - 1 : -1]
        tried = set()
        for place in candidates:
            if not 0 <= place < at or data[place : place + len(need)] != need or place in tried:
                continue
            tried.add(place)
            kind = _classify(at - place, offset, recent)
            if kind is None:
                continue
            n = _match_length(data, place, at, most)
            if kind[0] == ALONG_MAP:
                n = min(n, max(1, following - at))
            cost = kind[2] + (4 if kind[3] is not None else 0)
            value = 8 * n - cost - 9
            if n >= 2 and value > 0 and (found is None or value > found[0]):
                found = value, n, at - place, kind
                if n >= 2048 or (value + 9) // 8 >= most:
                    break
                need = data[at : at + max(2, (value + 9) // 8 + 1)]
        return found


def _parse(reference: bytes, target: bytes, table: rift.OffsetTable) -> Iterator[tuple[int, Step]]:
    """Steps with the position of each, greedy but for one byte of looking ahead."""
    finder, at, recent = _Finder(reference, target, table), len(reference), [0, 0, 0]
    end, ahead = len(reference) + len(target), None
    while at < end:
        found = ahead or finder.best(at, recent)
        ahead = None
        if found and found[1] < LONG and at + 1 < end:
            finder.add(at)
            following = finder.best(at + 1, recent)
            if following and following[0] > found[0] + 8:
                yield at, (finder.data[at], None)
                at, ahead = at + 1, following
                continue
        if not found:
            finder.add(at)
            yield at, (finder.data[at], None)
            at += 1
            continue
        _, n, distance, kind = found
        remember(recent, distance)
        yield at, (n, kind)
        finder.add_all(at, at + n, 1 if n < LONG else 7)
        at += n


def _symbols(step: Step) -> tuple[int, int | None, int | None]:
    """Main symbol, length symbol and aligned symbol of a step."""
    n, kind = step
    if kind is None:
        return n, None, None
    slot = n - 1 if 2 <= n <= 8 else 0
    long = None if slot else (n - 8 if 8 < n <= 8 + 255 else 0)
    return 256 + 8 * kind[0] + slot, long, kind[3]


def _write_step(writer: BitWriter, tables: tuple[Huffman, Huffman, Huffman], step: Step) -> None:
    main, long, aligned = _symbols(step)
    tables[0].write(writer, main)
    if step[1] is None:
        return
    writer.bits(step[1][1], step[1][2])
    if aligned is not None:
        tables[2].write(writer, aligned)
    if long is not None:
        tables[1].write(writer, long)
        if not long:
            writer.big_number(step[0] - 8)


def _run_symbol(n: int) -> tuple[int, int, int]:
    """Slot, extra bits and their number for a run of 4 to 127."""
    width = n.bit_length() - 1
    return width + 1, n - (1 << width), width


def _lengths_symbols(lengths: list[int], before: list[int]) -> list[tuple[int, int, int]]:
    """Pretree symbols, with extra bits and their number. A run never takes in the last length."""
    found, at, last = [], 0, len(lengths) - 1

    def run(matches) -> int:
        n = 0
        while at + n < last and n < 127 and matches(at + n):
            n += 1
        return n if n >= 4 else 0

    while at < len(lengths):
        if n := run(lambda i: lengths[i] == before[i]):
            slot, extra, bits = _run_symbol(n)
            found.append((31 + slot, extra, bits))
        elif at and (n := run(lambda i: lengths[i] == lengths[at - 1])):
            slot, extra, bits = _run_symbol(n)
            found.append((23 + slot, extra, bits))
        else:
            change, n = lengths[at] - before[at], 1
            if 1 <= change <= 3:
                found.append((16 + change, 0, 0))
            elif -3 <= change <= -1:
                found.append((19 - change, 0, 0))
            else:
                found.append((lengths[at], 0, 0))
        at += n
    return found


def _write_segments(writer: BitWriter, begins: list[int], tables: list[tuple[Huffman, Huffman, Huffman]]) -> None:
    writer.varint(len(begins))
    for at, before in zip(begins, [0, *begins], strict=False):
        writer.varint(at - before)
    coded, before = [], [0] * len(EVEN)
    for own in tables:
        lengths = [n for code in own for n in code.lengths]
        coded += _lengths_symbols(lengths, before)
        before = lengths
    counts = [0] * PRETREE
    for symbol, _, _ in coded:
        counts[symbol] += 1
    pretree = for_frequencies(counts)
    for n in pretree.lengths:
        writer.bits(n, 4)
    for symbol, extra, bits in coded:
        pretree.write(writer, symbol)
        writer.bits(extra, bits)


def _codes(steps: list[Step]) -> tuple[Huffman, Huffman, Huffman]:
    counts = [0] * MAIN, [0] * LENGTHS, [0] * ALIGNED
    for step in steps:
        for own, symbol in zip(counts, _symbols(step), strict=True):
            if symbol is not None:
                own[symbol] += 1
    return tuple(for_frequencies(own) for own in counts)


def compress(reference: bytes, target: bytes, caller_map: rift.Map | None = None) -> bytes:
    """Data from which decompress() makes the target, given the same caller_map; the shorter of the two framings."""
    known = len(reference)
    table = rift.OffsetTable(rift.merged(caller_map or [], [(known, 0)]))
    parts = min(MOST_PARTS, -(-len(target) // SPLIT)) if len(target) > BOUNDARY else 1
    begins = [known + k * SPLIT for k in range(parts)]
    steps: list[list[Step]] = [[] for _ in begins]
    part = 0
    for at, step in _parse(reference, target, table):
        while part + 1 < parts and at >= begins[part + 1]:
            part += 1
        steps[part].append(step)
    written = []
    for simple in (True, False):
        writer = BitWriter()
        writer.bits(0, 1)  # no map of its own
        writer.bits(simple, 1)
        if simple:
            even = Tables(EVEN)
            codes = [(even.main, even.lengths, even.aligned)] * parts
        else:
            codes = [_codes(own) for own in steps]
            _write_segments(writer, begins, codes)
        for own, tables in zip(steps, codes, strict=True):
            for step in own:
                _write_step(writer, tables, step)
        written.append(writer.finish())
    return min(written, key=len)
