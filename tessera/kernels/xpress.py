"""XPRESS with Huffman codes: blocks of 64 KiB, each with its own 512 code lengths, bits in 16-bit words, highest first."""

from __future__ import annotations

from bisect import bisect_right

from tessera.kernels.errors import malformed, truncated

BLOCK, SYMBOLS, LEAST = 1 << 16, 512, 3


class _Codes:
    """Canonical codes, shorter ones and lower symbols first."""

    def __init__(self, packed: bytes):
        lengths = [n for b in packed for n in (b & 15, b >> 4)]
        self.symbols = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.starts, code, before = [], 0, 0
        for n, _ in self.symbols:
            code <<= n - before
            before = n
            if code >> n:
                raise malformed("xpress: code too long")
            self.starts.append(code << (15 - n))
            code += 1

    def find(self, ahead: int) -> tuple[int, int]:
        """Length and symbol of the code that 15 bits begin with."""
        k = bisect_right(self.starts, ahead) - 1
        if k < 0:
            raise malformed("xpress: bad code")
        return self.symbols[k]


class _Words:
    """Two words are held at first; another is read as soon as sixteen bits are left and one more is asked for."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.held = self.take(2) << 16
        self.held |= self.take(2)
        self.n = 32

    def take(self, n: int) -> int:
        if self.at + n > len(self.data):
            raise truncated("xpress")
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "little")

    def peek(self, n: int) -> int:
        """Bits without reading a word: zeros where there are none."""
        return self.held >> (self.n - n) if self.n >= n else self.held << (n - self.n)

    def skip(self, n: int) -> None:
        for _ in range(n):
            if self.n == 16:
                width = min(2, len(self.data) - self.at)
                if not width:
                    raise truncated("xpress")
                self.held, self.n = self.held << 8 * width | self.take(width), self.n + 8 * width
            self.n -= 1
            self.held &= (1 << self.n) - 1

    def ahead(self, n: int) -> int:
        """The next bits, of which not all need be there."""
        if self.n >= n + 1 or self.n > 16:
            return self.peek(n) & ((1 << n) - 1)
        word = self.data[self.at : self.at + 2]
        held, have = self.held << 8 * len(word) | int.from_bytes(word, "little"), self.n + 8 * len(word)
        return (held >> (have - n) if have >= n else held << (n - have)) & ((1 << n) - 1)


def decompress(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at + SYMBOLS // 2 > len(data):
            raise truncated("xpress")
        codes = _Codes(data[at : at + SYMBOLS // 2])
        words = _Words(data, at + SYMBOLS // 2)
        end = min(size, len(out) + BLOCK)
        while len(out) < end:
            n, symbol = codes.find(words.ahead(15))
            words.skip(n)
            if symbol < 256:
                out.append(symbol)
                continue
            bits, length = symbol >> 4 & 15, symbol & 15
            if length == 15:
                length += words.take(1)
                if length == 255 + 15:
                    length = words.take(2) or words.take(4)
            length += LEAST
            distance = 1 << bits
            if bits:
                low = words.ahead(bits)
                words.skip(bits)
                distance |= low
            if distance > len(out):
                raise malformed("xpress: match offset out of range")
            for _ in range(length):
                out.append(out[-distance])
        at = words.at
    return bytes(out)
