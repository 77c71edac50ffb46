"""Framings of compressed chunks: the compression API's container, and WIM resources with or without a solid header."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from tessera.kernels import lzms, xpress
from tessera.kernels.errors import malformed, truncated

# Fixed values of the formats.
MAGIC, HEADER, XPRESS_HUFF, LZMS = 0xC0E5510A, 24, 4, 5
MOST_CHUNK = 64 << 20
SOLID_HEADER, SOLID_LZMS = 16, 3


def _u(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def expand(chunk: bytes, size: int, codec: Callable[[bytes, int], bytes] = lzms.decompress) -> bytes:
    """A chunk's plain bytes: as they are if there are as many."""
    if len(chunk) > size:
        raise malformed("chunk larger than its plaintext")
    return chunk if len(chunk) == size else codec(chunk, size)


def shrink(chunk: bytes) -> bytes:
    packed = lzms.compress(chunk)
    return packed if len(packed) < len(chunk) else chunk


def _chunks(data: bytes, size: int) -> list[bytes]:
    return [data[at : at + size] for at in range(0, len(data), size)]


# --- Compression API ----------------------------------------------------------------------------------------


@dataclass
class ContainerHeader:
    size: int
    algorithm: int
    total: int
    chunk: int
    flags: int

    @classmethod
    def read(cls, data: bytes, algorithm: int) -> ContainerHeader:
        if len(data) < HEADER:
            raise malformed("container too short")
        if _u(data, 0, 4) != MAGIC:
            raise malformed("bad container magic")
        found = cls(_u(data, 4, 2), data[7], _u(data, 8, 8), _u(data, 16, 4), _u(data, 20, 4))
        if not HEADER <= found.size <= len(data):
            raise malformed("bad header size")
        if algorithm == LZMS and header_check(data[: found.size]) != data[6]:
            raise malformed("bad header CRC")
        if found.algorithm != algorithm:
            raise malformed("container of another algorithm")
        if found.total and not 0 < found.chunk <= MOST_CHUNK:
            raise malformed("bad chunk size")
        if found.total and algorithm == LZMS and found.flags & 1:
            raise malformed("unsupported chunk-record mode")
        return found


def header_check(header: bytes) -> int:
    """The lowest byte of the CRC of all but the check itself."""
    return zlib.crc32(header[7:], zlib.crc32(header[:6])) & 255


def container_chunks(data: bytes, algorithm: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, offset, stored bytes, plain bytes) of each chunk."""
    header = ContainerHeader.read(data, algorithm)
    at, done, number = header.size, 0, 0
    while done < header.total:
        if at + 4 > len(data):
            raise truncated("container")
        n, at = _u(data, at, 4), at + 4
        if not n:
            raise malformed("zero-length chunk")
        if at + n > len(data):
            raise truncated("container")
        plain = min(header.chunk, header.total - done)
        yield number, at, n, plain
        at, done, number = at + n, done + plain, number + 1


def read_container(data: bytes, algorithm: int = LZMS) -> bytes:
    codec = {LZMS: lzms.decompress, XPRESS_HUFF: xpress.decompress}[algorithm]
    return b"".join(expand(data[at : at + n], plain, codec) for _, at, n, plain in container_chunks(data, algorithm))


def write_container(data: bytes, chunk: int = MOST_CHUNK) -> bytes:
    size = min(len(data), chunk)
    fields = ((MAGIC, 4), (HEADER, 2), (0, 1), (LZMS, 1), (len(data), 8), (size, 4), (0, 4))
    header = bytearray(b"".join(v.to_bytes(n, "little") for v, n in fields))
    header[6] = header_check(header)
    out = [bytes(header)]
    for plain in _chunks(data, size) if size else ():
        stored = shrink(plain)
        out += [len(stored).to_bytes(4, "little"), stored]
    return b"".join(out)


# --- WIM ----------------------------------------------------------------------------------------------------


def read_wim(resource: bytes, chunk: int, size: int) -> bytes:
    """A resource led by a table of where its chunks but the first begin."""
    if not size:
        return b""
    if not chunk:
        raise malformed("WIM chunk size is zero")
    n, width = -(-size // chunk), 8 if len(resource) >= 1 << 32 else 4
    start = (n - 1) * width
    if start > len(resource):
        raise malformed("WIM chunk table doesn't fit")
    begins = [0, *(_u(resource, k * width, width) for k in range(n - 1)), len(resource) - start]
    if any(b > e for b, e in zip(begins, begins[1:], strict=False)):
        raise malformed("bad WIM chunk offset")
    sizes = [chunk] * (n - 1) + [size - (n - 1) * chunk]
    return b"".join(expand(resource[start + b : start + e], k) for b, e, k in zip(begins, begins[1:], sizes, strict=False))


def write_wim(data: bytes, chunk: int) -> bytes:
    if not chunk:
        raise malformed("WIM chunk size is zero")
    stored = [shrink(c) for c in _chunks(data, chunk)]
    begins = list(accumulate(map(len, stored)))[:-1]
    width = 8 if 4 * len(begins) + sum(map(len, stored)) >= 1 << 32 else 4
    return b"".join([*(b.to_bytes(width, "little") for b in begins), *stored])


@dataclass
class SolidLayout:
    """Where the chunks of a solid resource are."""

    size: int
    chunk: int
    stored: list[int]
    start: int

    @staticmethod
    def prefix(header: bytes) -> int:
        """How many bytes parse() needs, from the first 16."""
        if len(header) < SOLID_HEADER:
            raise truncated("solid resource")
        size, chunk = _u(header, 0, 8), _u(header, 8, 4)
        if _u(header, 12, 4) != SOLID_LZMS:
            raise malformed("solid resource is not LZMS")
        if size and not chunk:
            raise malformed("solid chunk size is zero")
        return SOLID_HEADER + 4 * (-(-size // chunk) if size else 0)

    @classmethod
    def parse(cls, data: bytes) -> SolidLayout:
        start = cls.prefix(data)
        if len(data) < start:
            raise truncated("solid chunk table")
        return cls(_u(data, 0, 8), _u(data, 8, 4), [_u(data, at, 4) for at in range(SOLID_HEADER, start, 4)], start)

    def plain(self, number: int) -> int:
        return min(self.chunk, self.size - number * self.chunk)

    def offsets(self) -> list[int]:
        return [self.start + n for n in accumulate(self.stored, initial=0)][:-1]

    def chunks_for(self, offset: int, n: int) -> range:
        """Numbers of the chunks that a range of plain bytes lies in."""
        if offset < 0 or offset + n > self.size:
            raise malformed("solid range out of bounds")
        if n <= 0:
            raise malformed("empty solid range")
        return range(offset // self.chunk, (offset + n - 1) // self.chunk + 1)


def read_solid(resource: bytes) -> bytes:
    layout = SolidLayout.parse(resource)
    return read_solid_range(resource, 0, layout.size) if layout.size else b""


def read_solid_range(resource: bytes, offset: int, n: int) -> bytes:
    """Plain bytes of a range; only the chunks that it lies in are decoded."""
    layout = SolidLayout.parse(resource)
    numbers, offsets = layout.chunks_for(offset, n), layout.offsets()
    plain = []
    for k in numbers:
        if offsets[k] + layout.stored[k] > len(resource):
            raise truncated("solid chunk")
        plain.append(expand(resource[offsets[k] : offsets[k] + layout.stored[k]], layout.plain(k)))
    skip = offset - numbers[0] * layout.chunk
    return b"".join(plain)[skip : skip + n]


def write_solid(data: bytes, chunk: int) -> bytes:
    if not chunk:
        raise malformed("solid chunk size is zero")
    stored = [shrink(c) for c in _chunks(data, chunk)]
    header = [len(data).to_bytes(8, "little"), chunk.to_bytes(4, "little"), SOLID_LZMS.to_bytes(4, "little")]
    return b"".join([*header, *(len(s).to_bytes(4, "little") for s in stored), *stored])
