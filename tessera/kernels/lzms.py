"""LZMS: literals, copies and delta copies. A range coder runs forward through the data, adaptive codes run backward.

A delta copy repeats differences: each byte is the one `span` before it, plus how the byte at the offset differs from
the one `span` before that.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np

from tessera.kernels.errors import malformed

MOST = 64 << 20
LONGEST_CODE = 15
# Fixed values of the format: runs of (slots, extra bits) for offsets and for lengths, which start at 1.
OFFSET_RUNS = (
    (8, 0), (9, 2), (7, 3), (10, 4), (15, 5), (15, 6), (20, 7), (20, 8), (30, 9), (33, 10), (40, 11), (42, 12),
    (45, 13), (60, 14), (73, 15), (80, 16), (85, 17), (95, 18), (105, 19), (6, 20), (1, 30),
)
LENGTH_RUNS = ((26, 0), (4, 1), (6, 2), (4, 3), (5, 4), (2, 5), (1, 6), (1, 7), (1, 8), (1, 9), (1, 10), (1, 16), (1, 30))
STATES = {"main": 16, "match": 32, "lz": 64, "delta": 64, "lz_rep0": 64, "lz_rep1": 64, "delta_rep0": 64, "delta_rep1": 64}


def _slots(runs: tuple[tuple[int, int], ...]) -> tuple[list[int], list[int]]:
    bases, extra, at = [], [], 1
    for n, bits in runs:
        for _ in range(n):
            bases.append(at)
            extra.append(bits)
            at += 1 << bits
    return bases, extra


OFFSETS, OFFSET_EXTRA = _slots(OFFSET_RUNS)
LENGTHS, LENGTH_EXTRA = _slots(LENGTH_RUNS)


def offset_slots(size: int) -> int:
    """Slots in use for outputs of a size."""
    return 0 if size < 2 else max(1, sum(b < size for b in OFFSETS))


# --- Bits ---------------------------------------------------------------------------------------------------


class BackwardReader:
    """16-bit words from the end of the data on, highest bits first; zeros past the start."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, len(data), 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            word = 0
            if self.at >= 2:
                self.at -= 2
                word = self.data[self.at] | self.data[self.at + 1] << 8
            self.held = self.held << 16 | word
            self.n += 16
        return self.held >> (self.n - n) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        value = self.peek(n)
        self.n -= n
        self.held &= (1 << self.n) - 1
        return value


class BackwardWriter:
    def __init__(self):
        self.words, self.held, self.n = [], 0, 0

    def bits(self, value: int, n: int) -> None:
        self.held, self.n = self.held << n | value, self.n + n
        while self.n >= 16:
            self.n -= 16
            self.words.append(self.held >> self.n)
            self.held &= (1 << self.n) - 1

    def finish(self) -> bytes:
        last = [self.held << (16 - self.n)] if self.n else []
        return b"".join(w.to_bytes(2, "little") for w in reversed(self.words + last))


# --- Adaptive codes -----------------------------------------------------------------------------------------


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of an optimal code; counts are halved until none is over the longest. Of equal counts symbols come first."""
    if len(counts) < 2:
        return [1] * len(counts)
    leaves = sorted((c, s) for s, c in enumerate(counts))
    while True:
        weights, parent = [c for c, _ in leaves], [0] * (2 * len(leaves) - 1)
        leaf, inner, n = 0, len(leaves), len(leaves)

        for node in range(n, 2 * n - 1):
            weight = 0
            for _ in range(2):
                if leaf < n and (inner >= node or weights[leaf] <= weights[inner]):
                    child, leaf = leaf, leaf + 1
                else:
                    child, inner = inner, inner + 1
                parent[child] = node
                weight += weights[child]
            weights.append(weight)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= LONGEST_CODE:
            found = [0] * n
            for (_, symbol), d in zip(leaves, depth, strict=False):
                found[symbol] = d
            return found
        leaves = sorted(((c + 1) >> 1, s) for c, s in leaves)


class AdaptiveCode:
    """A code made anew from its symbols' counts every so many symbols; then the counts are halved."""

    def __init__(self, symbols: int, every: int):
        self.counts, self.every, self.left = [1] * symbols, every, every
        self._build()

    def _build(self) -> None:
        self.lengths = code_lengths(self.counts)
        order = sorted((n, s) for s, n in enumerate(self.lengths))
        self.codes, code, before = [0] * len(order), 0, 0
        self.starts, self.order = [], [s for _, s in order]
        for n, symbol in order:
            code <<= n - before
            before = n
            self.codes[symbol] = code
            self.starts.append(code << (LONGEST_CODE - n))
            code += 1

    def _count(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self._build()
            self.counts = [(c >> 1) + 1 for c in self.counts]
            self.left = self.every

    def read(self, source: BackwardReader) -> int:
        k = bisect_right(self.starts, source.peek(LONGEST_CODE)) - 1
        if k < 0:
            raise malformed("LZMS: a code without symbols")
        symbol = self.order[k]
        source.bits(self.lengths[symbol])
        self._count(symbol)
        return symbol

    def write(self, out: BackwardWriter, symbol: int) -> None:
        out.bits(self.codes[symbol], self.lengths[symbol])
        self._count(symbol)


# --- Range coder --------------------------------------------------------------------------------------------


class Bit:
    """A binary decision: for each of its recent outcomes, how many of the last 64 there were zero."""

    def __init__(self, states: int):
        self.mask, self.state = states - 1, 0
        self.zeros, self.recent = [48] * states, [0x55555555] * states

    def probability(self) -> int:
        return min(63, max(1, self.zeros[self.state]))

    def update(self, bit: int) -> None:
        s = self.state
        self.zeros[s] += (self.recent[s] >> 63) - bit
        self.recent[s] = (self.recent[s] << 1 | bit) & 0xFFFFFFFFFFFFFFFF
        self.state = (s << 1 | bit) & self.mask

    def cost(self, bit: int) -> int:
        """Cost of an outcome in 64ths of a bit."""
        zeros = min(64, self.zeros[self.state])
        return bit_costs()[64 - zeros if bit else zeros]


@lru_cache(maxsize=1)
def bit_costs() -> list[int]:
    return [math.floor(-math.log2(min(63, max(1, i)) / 64) * 64 + 0.5) for i in range(65)]


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 4, 0xFFFFFFFF
        self.code = int.from_bytes(data[:2], "little") << 16 | int.from_bytes(data[2:4], "little")

    def bit(self, decision: Bit) -> int:
        if self.range < 0x10000:
            self.range <<= 16
            word = self.data[self.at : self.at + 2]
            self.code = (self.code << 16 | (int.from_bytes(word, "little") if len(word) == 2 else 0)) & 0xFFFFFFFF
            self.at += 2
        bound = (self.range >> 6) * decision.probability()
        bit = int(self.code >= bound)
        if bit:
            self.range, self.code = self.range - bound, self.code - bound
        else:
            self.range = bound
        decision.update(bit)
        return bit


class RangeEncoder:
    """The code is one growing number: words are taken off its top, and a carry goes into those before."""

    def __init__(self):
        self.words, self.low, self.range = [], 0, 0xFFFFFFFF

    def _shift(self) -> None:
        if self.low >> 32:
            k = len(self.words) - 1
            while self.words[k] == 0xFFFF:
                self.words[k] = 0
                k -= 1
            self.words[k] += 1
            self.low &= 0xFFFFFFFF
        self.words.append(self.low >> 16)
        self.low = (self.low & 0xFFFF) << 16

    def bit(self, decision: Bit, bit: int) -> None:
        if self.range < 0x10000:
            self._shift()
            self.range <<= 16
        bound = (self.range >> 6) * decision.probability()
        if bit:
            self.low, self.range = self.low + bound, self.range - bound
        else:
            self.range = bound
        decision.update(bit)

    def finish(self) -> bytes:
        for _ in range(3):
            self._shift()
        return b"".join(w.to_bytes(2, "little") for w in self.words)


# --- x86 filter ---------------------------------------------------------------------------------------------

WINDOW, REACH = 65535, 1023


def _x86_operand(data: bytearray, at: int) -> tuple[int, int] | None:
    """Bytes before the operand of a translated instruction at a place, and how near the last use must be."""
    first = data[at]
    if first == 0xE8:
        return 1, REACH >> 1
    second, third = data[at + 1], data[at + 2]
    if first in (0x48, 0x4C):
        loads = second == 0x8D or (second == 0x8B and first == 0x48 and third & 0xF0 == 0)
        return (3, REACH) if loads and third & 7 == 5 else None
    if first == 0xFF and second == 0x15:
        return 2, REACH
    return (3, REACH) if (first, second, third) == (0xF0, 0x83, 0x05) else None


def x86_filter(data: bytearray, undo: bool) -> None:
    """Turn operands relative to their instruction into absolute ones, or back, near instructions that share targets."""
    if len(data) <= 17:
        return
    last, uses, at = -REACH - 1, {}, 1
    while at < len(data) - 16:
        if data[at] == 0xE9:
            at += 5
            continue
        kind = _x86_operand(data, at)
        if kind is None:
            at += 1
            continue
        place = at + kind[0]
        near = at - last <= kind[1]
        operand = int.from_bytes(data[place : place + 4], "little")
        changed = (operand + (-at if undo else at)) & 0xFFFFFFFF if near else operand
        plain = changed if undo else operand
        data[place : place + 4] = changed.to_bytes(4, "little")
        target, end = (at + plain) & 0xFFFF, place + 3
        if end - uses.get(target, -WINDOW - 1) <= WINDOW:
            last = end
        uses[target] = end
        at = end + 1


# --- Codec --------------------------------------------------------------------------------------------------


class _Coder:
    """The codes and decisions that both directions share."""

    def __init__(self, size: int):
        slots = offset_slots(size)
        self.literal, self.length = AdaptiveCode(256, 1024), AdaptiveCode(len(LENGTHS), 512)
        self.offset, self.delta_offset = AdaptiveCode(slots, 1024), AdaptiveCode(slots, 1024)
        self.power = AdaptiveCode(8, 512)
        self.bit = {name: Bit(n) for name, n in STATES.items()}
        self.recent: list[int] = [1, 2, 3, 4]
        self.recent_delta: list[tuple[int, int]] = [(1, 0), (2, 0), (3, 0), (4, 0)]
        self.last = ""

    def queue(self, kind: str) -> tuple[list, int]:
        """Recent offsets of a kind, and the first that a repeat can name: not the one just used by the same kind."""
        return (self.recent if kind == "lz" else self.recent_delta), int(self.last == kind)


def decompress(data: bytes, size: int) -> bytes:
    if not data or not size:
        return b""
    if size > MOST:
        raise malformed("LZMS: output size exceeds 64 MiB chunk limit")
    if len(data) < 4 or len(data) % 2:
        raise malformed("LZMS: need >= 4 even bytes")
    state, ranges, source, out = _Coder(size), RangeDecoder(data), BackwardReader(data), bytearray()
    bit = state.bit

    def number(code: AdaptiveCode, bases: list[int], extra: list[int]) -> int:
        slot = code.read(source)
        return bases[slot] + source.bits(extra[slot])

    def repeat(kind: str):
        queue, skip = state.queue(kind)
        k = 0 if not ranges.bit(bit[f"{kind}_rep0"]) else 1 + ranges.bit(bit[f"{kind}_rep1"])
        value = queue.pop(min(3, k + skip))
        queue.insert(0, value)
        return value

    def fresh(kind: str, value):
        queue, _ = state.queue(kind)
        queue.insert(0, value)
        queue.pop()
        return value

    while len(out) < size:
        if not ranges.bit(bit["main"]):
            out.append(state.literal.read(source))
            state.last = ""
        elif not ranges.bit(bit["match"]):
            if ranges.bit(bit["lz"]):
                offset = repeat("lz")
            else:
                offset = fresh("lz", number(state.offset, OFFSETS, OFFSET_EXTRA))
            n = min(number(state.length, LENGTHS, LENGTH_EXTRA), size - len(out))
            if offset > len(out):
                raise malformed("LZMS: LZ offset past start")
            start = len(out) - offset
            while n:
                piece = out[start : start + n]
                out += piece
                start, n = start + len(piece), n - len(piece)
            state.last = "lz"
        else:
            if ranges.bit(bit["delta"]):
                units, power = repeat("delta")
            else:
                power = state.power.read(source)
                units, power = fresh("delta", (number(state.delta_offset, OFFSETS, OFFSET_EXTRA), power))
            n = min(number(state.length, LENGTHS, LENGTH_EXTRA), size - len(out))
            span, offset = 1 << power, units << power
            if offset + span > len(out):
                raise malformed("LZMS: delta offset/span past start")
            for at in range(len(out), len(out) + n):
                out.append((out[at - offset] + out[at - span] - out[at - offset - span]) & 255)
            state.last = "delta"
    x86_filter(out, undo=True)
    return bytes(out)


CHAIN, DELTA_WAYS, LEAST_COPY = 16, 4, 3


def _common(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a on equal those from b on, of at most so many; a is before b."""
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if data[a + n : a + n + step] == data[b + n : b + n + step]:
            n, step = n + step, 4 * step
        elif step <= 16:
            while data[a + n] == data[b + n]:
                n += 1
            return n
        else:
            step //= 4
    return n


class _Search:
    """Places of grams, and of differences for delta copies."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        own = np.frombuffer(data, np.uint8)
        #: For each power, each byte less the one a span before it.
        self.steps = [(own - np.concatenate([np.zeros(min(1 << p, len(own)), np.uint8), own[: -(1 << p)]])).tobytes() for p in range(8)]
        self.differences: list[dict[tuple[int, bytes], list[int]]] = [{} for _ in range(8)]

    def copy(self, at: int, recent: list[int]) -> tuple[int, int]:
        """(length, offset) of the longest copy."""
        data, most, n, offset = self.data, len(self.data) - at, 0, 0
        key = data[at : at + 4]
        held = self.places.setdefault(key, []) if len(key) == 4 else []
        for place in [at - o for o in recent if o <= at] + held[: -CHAIN - 1 : -1]:
            if n < most and data[place + n] == data[at + n] and (m := _common(data, place, at, most)) > n:
                n, offset = m, at - place
        held.append(at)
        return n, offset

    def delta(self, at: int) -> tuple[int, int, int]:
        """(length, units, power) of the longest delta copy."""
        data, best = self.data, (0, 0, 0)
        most = len(data) - at
        if most < 3:
            return best
        for power in range(8):
            span = 1 << power
            if span > at:
                break
            steps = self.steps[power]
            held = self.differences[power].setdefault((at % span, steps[at : at + 3]), [])
            for place in held[: -DELTA_WAYS - 1 : -1]:
                n = _common(steps, place, at, most)
                if n > best[0]:
                    best = n, (at - place) >> power, power
            held.append(at)
        return best


def _slot(bases: list[int], value: int) -> int:
    return bisect_right(bases, value) - 1


def compress(data: bytes) -> bytes:
    """Data from which decompress() makes these bytes; of even length."""
    if not data:
        return b""
    filtered = bytearray(data)
    x86_filter(filtered, undo=False)
    raw = bytes(filtered)
    state, ranges, out, search = _Coder(len(raw)), RangeEncoder(), BackwardWriter(), _Search(raw)
    bit, at = state.bit, 0

    def number(code: AdaptiveCode, bases: list[int], extra: list[int], value: int) -> None:
        slot = _slot(bases, value)
        code.write(out, slot)
        out.bits(value - bases[slot], extra[slot])

    def price(code: AdaptiveCode, bases: list[int], extra: list[int], value: int) -> int:
        slot = _slot(bases, value)
        return 64 * (code.lengths[slot] + extra[slot])

    def rank(kind: str, value) -> int | None:
        """Which repeat names a value: the first three after those that it can't name."""
        queue, skip = state.queue(kind)
        named = [queue[min(3, k + skip)] for k in range(3)]
        return named.index(value) if value in named else None

    def send_offset(kind: str, value, fresh) -> None:
        queue, skip = state.queue(kind)
        k = rank(kind, value)
        ranges.bit(bit[kind], int(k is not None))
        if k is None:
            fresh()
            queue.pop()
        else:
            ranges.bit(bit[f"{kind}_rep0"], int(k > 0))
            if k:
                ranges.bit(bit[f"{kind}_rep1"], k - 1)
            queue.pop(min(3, k + skip))
        queue.insert(0, value)

    while at < len(raw):
        n, offset = search.copy(at, state.recent)
        chosen = None
        if n >= LEAST_COPY:
            cost = bit["main"].cost(1) + bit["match"].cost(0) + price(state.length, LENGTHS, LENGTH_EXTRA, n)
            cost += bit["lz"].cost(0) + price(state.offset, OFFSETS, OFFSET_EXTRA, offset) if rank("lz", offset) is None else bit["lz"].cost(1) + 64
            chosen = "lz", n, cost
        else:
            m, units, power = search.delta(at)
            if m >= LEAST_COPY:
                cost = bit["main"].cost(1) + bit["match"].cost(1) + bit["delta"].cost(0) + 64 * state.power.lengths[power]
                cost += price(state.delta_offset, OFFSETS, OFFSET_EXTRA, units) + price(state.length, LENGTHS, LENGTH_EXTRA, m)
                chosen = "delta", m, cost
        if chosen and chosen[1] <= 64 and chosen[2] >= sum(bit["main"].cost(0) + 64 * state.literal.lengths[b] for b in raw[at : at + chosen[1]]):
            chosen = None
        if not chosen:
            ranges.bit(bit["main"], 0)
            state.literal.write(out, raw[at])
            at, state.last = at + 1, ""
            continue
        kind, n, _ = chosen
        ranges.bit(bit["main"], 1)
        ranges.bit(bit["match"], int(kind == "delta"))
        if kind == "lz":
            send_offset("lz", offset, lambda o=offset: number(state.offset, OFFSETS, OFFSET_EXTRA, o))
        else:

            def fresh(units=units, power=power) -> None:
                state.power.write(out, power)
                number(state.delta_offset, OFFSETS, OFFSET_EXTRA, units)

            send_offset("delta", (units, power), fresh)
        number(state.length, LENGTHS, LENGTH_EXTRA, n)
        at, state.last = at + n, kind
    found = ranges.finish() + out.finish()
    return found + bytes(len(found) % 2)
