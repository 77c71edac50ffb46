"""Canonical Huffman codes of up to 16 bits, read from the highest bit of a code on, in streams of lowest bits first."""

from __future__ import annotations

import heapq
from collections import Counter
from functools import lru_cache

from tessera.kernels.bits import BitReader, BitWriter
from tessera.kernels.errors import malformed

LONGEST = 16


def _reversed(code: int, length: int) -> int:
    return int(f"{code:0{length}b}"[::-1], 2)


class Huffman:
    """Codes of symbols by their lengths; 0: no code. Longer codes come before shorter ones, from zero on."""

    def __init__(self, lengths: list[int] | tuple[int, ...]):
        self.lengths = list(lengths)
        self.width = max(self.lengths, default=0)
        if self.width > LONGEST:
            raise malformed("code length exceeds maximum")
        counts, code, following = Counter(self.lengths), 0, {}
        for length in range(self.width, 0, -1):
            following[length] = code
            code = (code + counts[length]) >> 1
        self.codes = [0] * len(self.lengths)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.width if self.width else 0)
        for symbol, length in enumerate(self.lengths):
            if length:
                code = self.codes[symbol] = _reversed(following[length] & ((1 << length) - 1), length)
                following[length] += 1
                step = 1 << length
                self.table[code::step] = [(symbol, length)] * len(range(code, len(self.table), step))

    def read(self, reader: BitReader) -> int:
        if not self.table:
            raise malformed("empty Huffman table")
        found = self.table[reader.peek(self.width)]
        if found is None:
            raise malformed("bits that are no code")
        reader.skip(found[1])
        return found[0]

    def write(self, writer: BitWriter, symbol: int) -> None:
        writer.bits(self.codes[symbol], self.lengths[symbol])


@lru_cache(maxsize=64)
def of_lengths(lengths: tuple[int, ...]) -> Huffman:
    return Huffman(lengths)


def _tree_depths(weights: list[tuple[int, int]]) -> dict[int, int]:
    """Depth of each symbol in an optimal tree. weights: (weight, symbol)."""
    heap = [(w, i, (s,)) for i, (w, s) in enumerate(weights)]
    heapq.heapify(heap)
    depth = dict.fromkeys((s for _, s in weights), 0)
    order = len(heap)
    while len(heap) > 1:
        (w1, _, a), (w2, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (w1 + w2, order, a + b))
        order += 1
    return depth


def _bounded_depths(weights: list[tuple[int, int]], most: int) -> dict[int, int]:
    """Depths of an optimal code of at most `most` bits, by package-merge: always complete."""
    leaves = sorted((w, (s,)) for w, s in weights)
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most):
        merged = sorted(leaves + packages, key=lambda p: p[0])
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2], strict=False)]
    return Counter(s for _, symbols in packages[: len(leaves) - 1] for s in symbols)


def for_frequencies(frequencies: list[int], most: int = 15) -> Huffman:
    """A complete code for the symbols of non-zero frequency; a lone symbol is given a partner that never occurs."""
    weights = [(f, s) for s, f in enumerate(frequencies) if f]
    lengths = [0] * len(frequencies)
    if len(weights) == 1:
        lengths[weights[0][1]] = 1
        if len(lengths) > 1:
            lengths[0 if weights[0][1] else 1] = 1
    elif weights:
        depths = _tree_depths(weights)
        if max(depths.values()) > most:
            depths = _bounded_depths(weights, most)
        for symbol, depth in depths.items():
            lengths[symbol] = depth
    return Huffman(lengths)
