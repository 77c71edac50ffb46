"""Bit streams that begin with three bits giving the number of unused bits at their end. Lowest bits come first."""

from __future__ import annotations

from tessera.kernels.errors import DeltaError, malformed, truncated

MASK64 = (1 << 64) - 1


def signed(x: int) -> int:
    """The 64-bit two's complement reading of x's lowest 64 bits."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


class BitReader:
    def __init__(self, data: bytes):
        if not data:
            raise truncated("empty bit stream")
        self.size = len(data) * 8
        self.end = self.size - (data[0] & 7)
        if self.end < 3:
            raise truncated("bit stream shorter than its padding")
        self.data = bytes(data) + bytes(9)
        self.at = 3

    def remaining(self) -> int:
        return max(0, self.end - self.at)

    def peek(self, n: int) -> int:
        """Up to 64 bits; zeros past the end."""
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise truncated("bit stream exhausted")

    def bits(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    def _zeros(self, most: int) -> int:
        """Zero bits before the next one, which is read too."""
        ahead = self.peek(most + 1)
        if not ahead:
            raise DeltaError("invalid varint")
        zeros = (ahead & -ahead).bit_length() - 1
        self.skip(zeros + 1)
        return zeros

    def varint(self) -> int:
        """A signed 64-bit integer: zeros and a one give its nibbles, less one."""
        return signed(self.bits(4 * self._zeros(15) + 4))

    def big_number(self) -> int:
        """An unsigned integer of at least 256."""
        width = self._zeros(23) + 8
        return 1 << width | self.bits(width)

    def buffer(self) -> bytes:
        """A length, then that many bytes from the next whole byte on."""
        n = self.varint()
        if n < 0:
            raise malformed("negative buffer size")
        start = -(-self.at // 8)
        if (start + n) * 8 > self.size:
            raise malformed("buffer size exceeds available data")
        self.at = (start + n) * 8
        return self.data[start : start + n]


class BitWriter:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 3

    def bits(self, value: int, n: int) -> None:
        self.held |= (value & ((1 << n) - 1)) << self.n
        self.n += n
        if self.n >= 512:
            whole = self.n >> 3
            self.out += (self.held & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.held >>= 8 * whole
            self.n -= 8 * whole

    def varint(self, value: int) -> None:
        value &= MASK64
        nibbles = max(1, -(-value.bit_length() // 4))
        self.bits(1 << (nibbles - 1), nibbles)
        self.bits(value, 4 * nibbles)

    def big_number(self, value: int) -> None:
        width = value.bit_length() - 1
        self.bits(1 << (width - 8), width - 7)
        self.bits(value, width)

    def _flush(self) -> int:
        """Bring the stream to a whole byte; the number of bits that took."""
        padding = -self.n % 8
        self.out += self.held.to_bytes((self.n + 7) // 8, "little")
        self.held = self.n = 0
        return padding

    def buffer(self, data: bytes) -> None:
        self.varint(len(data))
        self._flush()
        self.out += data

    def finish(self) -> bytes:
        padding = self._flush()
        self.out[0] = self.out[0] & ~7 | padding
        return bytes(self.out)
