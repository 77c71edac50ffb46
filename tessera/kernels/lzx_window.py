"""The LZX of cabinet files: blocks with their own trees over a sliding window, bits in 16-bit words, highest first."""

from __future__ import annotations

from bisect import bisect_right

from tessera.kernels.errors import malformed, truncated

# Fixed values of the format.
FRAME, LEAST, PRIMARY, LENGTHS, PRETREE, ALIGNED = 1 << 15, 2, 7, 249, 20, 8
VERBATIM, WITH_ALIGNED, STORED = 1, 2, 3


def position_slots(window: int) -> tuple[list[int], list[int]]:
    """Base position and extra bits of each slot, up to the window's size."""
    bases, extra, at, k = [], [], 0, 0
    while at < window:
        bits = 0 if k < 4 else min(17, k // 2 - 1)
        bases.append(at)
        extra.append(bits)
        at, k = at + (1 << bits), k + 1
    return bases, extra


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            word = int.from_bytes(self.data[self.at : self.at + 2], "little")
            if self.at >= len(self.data) + 4:
                raise truncated("LZX")
            self.at += 2
            self.held, self.n = self.held << 16 | word, self.n + 16
        return self.held >> (self.n - n) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.n -= n
        self.held &= (1 << self.n) - 1
        return value

    def align(self) -> None:
        """To the next whole word; a whole one is passed over if none is begun."""
        self.bits(self.n % 16 or 16)
        self.at -= self.n // 8
        self.held = self.n = 0

    def frame_end(self) -> None:
        self.bits(self.n % 16)


class _Tree:
    """Canonical codes, shorter ones and lower symbols first."""

    def __init__(self, lengths: list[int]):
        order = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.order, self.starts, code, before = order, [], 0, 0
        for n, _ in order:
            code <<= n - before
            before = n
            self.starts.append(code << (16 - n))
            code += 1

    def read(self, source: _Bits) -> int:
        k = bisect_right(self.starts, source.peek(16)) - 1
        if k < 0:
            raise malformed("LZX: a tree without codes")
        n, symbol = self.order[k]
        source.bits(n)
        return symbol


def _read_lengths(source: _Bits, lengths: list[int], first: int, end: int) -> None:
    """Update lengths in place, coded against what they were."""
    pretree = _Tree([source.bits(4) for _ in range(PRETREE)])
    at = first
    while at < end:
        symbol = pretree.read(source)
        if symbol < 17:
            lengths[at] = (lengths[at] - symbol) % 17
            at += 1
            continue
        if symbol == 17:
            n, value = 4 + source.bits(4), 0
        elif symbol == 18:
            n, value = 20 + source.bits(5), 0
        else:
            n = 4 + source.bits(1)
            value = (lengths[at] - pretree.read(source)) % 17
        if at + n > end:
            raise malformed("LZX: run of lengths past their end")
        lengths[at : at + n] = [value] * n
        at += n


def decompress(data: bytes, size: int, window: int) -> bytes:
    """Plain bytes, after undoing the translation of calls if the stream says there was one."""
    source, out = _Bits(data), bytearray()
    bases, extra = position_slots(window)
    main, length = [0] * (256 + 8 * len(bases)), [0] * LENGTHS
    translated = (source.bits(16) << 16 | source.bits(16)) if source.bits(1) else 0
    recent, left, kind = [1, 1, 1], 0, 0
    trees: tuple[_Tree, _Tree, _Tree | None] | None = None
    frame = 0
    while len(out) < size:
        if not left:
            if kind == STORED and len(out) and stored % 2:
                source.at += 1
            kind = source.bits(3)
            left = source.bits(16) << 8 | source.bits(8)
            if kind == STORED:
                stored = left
                source.align()
                recent = [int.from_bytes(source.data[source.at + 4 * k : source.at + 4 * k + 4], "little") for k in range(3)]
                source.at += 12
            elif kind in (VERBATIM, WITH_ALIGNED):
                aligned = _Tree([source.bits(3) for _ in range(ALIGNED)]) if kind == WITH_ALIGNED else None
                _read_lengths(source, main, 0, 256)
                _read_lengths(source, main, 256, len(main))
                _read_lengths(source, length, 0, LENGTHS)
                trees = _Tree(main), _Tree(length), aligned
            else:
                raise malformed("LZX: bad block type")
        end = min(size, len(out) + left, frame + FRAME)
        before = len(out)
        if kind == STORED:
            piece = source.data[source.at : source.at + end - before]
            if len(piece) < end - before:
                raise truncated("LZX")
            out += piece
            source.at += len(piece)
        else:
            while len(out) < end:
                symbol = trees[0].read(source)
                if symbol < 256:
                    out.append(symbol)
                    continue
                slot, n = divmod(symbol - 256, 8)
                if n == PRIMARY:
                    n += trees[1].read(source)
                if slot < 3:
                    offset = recent[slot]
                    recent[slot], recent[0] = recent[0], offset
                else:
                    bits = extra[slot]
                    if trees[2] and bits >= 3:
                        low = source.bits(bits - 3) << 3
                        low |= trees[2].read(source)
                    else:
                        low = source.bits(bits)
                    offset = bases[slot] + low - 2
                    recent = [offset, *recent[:2]]
                if not 0 < offset <= min(len(out), window):
                    raise malformed("LZX: match offset out of range")
                for _ in range(n + LEAST):
                    out.append(out[-offset])
        left -= len(out) - before
        if len(out) >= frame + FRAME:
            frame += FRAME
            if kind != STORED:
                source.frame_end()
    del out[size:]
    if translated:
        _undo_calls(out, translated)
    return bytes(out)


def _undo_calls(out: bytearray, size: int) -> None:
    for frame in range(0, min(len(out), FRAME * FRAME), FRAME):
        at, end = frame, min(frame + FRAME, len(out)) - 10
        while at < end:
            if out[at] != 0xE8:
                at += 1
                continue
            value = int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
            if -at <= value < size:
                out[at + 1 : at + 5] = (value - at if value >= 0 else value + size).to_bytes(4, "little", signed=True)
            at += 5
