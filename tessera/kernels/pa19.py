"""The older delta format: a fixed header of 32-bit fields, then LZX data. The old file's bytes are checked by size only."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.kernels import lzx_window
from tessera.kernels.errors import DeltaError, malformed, truncated
from tessera.kernels.hashes import crc_register

MAGIC = b"PA19"
CALLS, WINDOW, INTERLEAVED = 2, 4, 8  # flags
WINDOWS = (0x8000, 0x10000, 0x20000)


@dataclass
class Header:
    flags: int
    old_size: int
    old_crc: int
    new_size: int
    new_crc: int
    window: int
    interleave: int

    def data_start(self) -> int:
        """Where the LZX data begin; the interleave table counts from where its own field would be without a window."""
        start = 24 + (4 if self.flags & WINDOW else 0)
        return start + (4 + 12 * self.interleave if self.flags & INTERLEAVED else 0)


def parse(data: bytes) -> Header:
    if data[:4] != MAGIC:
        raise malformed("PA19: bad magic")
    if len(data) < 28:
        raise truncated("PA19")
    field = lambda at: int.from_bytes(data[at : at + 4], "little")
    flags, window, interleave = field(4), 0x20000, 0
    if flags & WINDOW:
        if len(data) < 32:
            raise truncated("PA19")
        if field(24) > 31:
            raise malformed("PA19: invalid LZX window exponent")
        window = 1 << field(24)
    if flags & INTERLEAVED:
        if len(data) < 36:
            raise truncated("PA19")
        interleave = field(28)  # here with or without a window field
    return Header(flags, field(8), field(12), field(16), field(20), window, interleave)


def apply(old: bytes, data: bytes) -> bytes:
    header = parse(data)
    if len(old) != header.old_size:
        raise DeltaError("PA19 old file size mismatch", f"expected {header.old_size}, got {len(old)}")
    if header.data_start() > len(data):
        raise truncated("PA19")
    packed = data[header.data_start() :]
    if not packed and header.new_size:
        raise malformed("PA19: empty LZX data for non-zero target")
    if packed and header.window not in WINDOWS:
        raise malformed("PA19: unsupported LZX window size")
    out = bytearray(lzx_window.decompress(packed, header.new_size, header.window) if packed else b"")
    if header.flags & CALLS:
        undo_calls(out)
    if crc_register(out) != header.new_crc:
        raise malformed("PA19: CRC mismatch")
    return bytes(out)


def undo_calls(out: bytearray) -> None:
    """Absolute call targets back to relative ones, in the first 32 KiB."""
    at, end = 0, min(len(out), 1 << 15)
    while at + 5 <= end:
        if out[at] == 0xE8:
            value = int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
            relative = value - at if 0 <= value < len(out) else value + len(out) if -value <= at else None
            if relative is not None:
                out[at + 1 : at + 5] = (relative & 0xFFFFFFFF).to_bytes(4, "little")
                at += 5
                continue
        at += 1
