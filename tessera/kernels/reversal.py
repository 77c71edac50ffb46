"""Reversal data: sections that copy from the target, bring deleted bytes back, or set single bytes, until the stream ends."""

from __future__ import annotations

from tessera.kernels import rift
from tessera.kernels.bits import BitReader
from tessera.kernels.containers import XPRESS_HUFF, read_container
from tessera.kernels.errors import malformed

MAGIC = int.from_bytes(b"PRSM", "little")
COPY, DELETED, BYTES = 0, 1, 2


def sections(data: bytes) -> list[tuple[int, bytes]]:
    """Kind and bytes of each section."""
    reader = BitReader(data)
    if reader.bits(32) != MAGIC:
        raise malformed("reverse delta: missing PRSM magic")
    reader.bits(32)  # a count that nothing depends on
    found = []
    while reader.remaining():
        section = reader.buffer()
        found.append((BitReader(section).bits(32), section))
    return found


def apply(target: bytes, data: bytes, size: int) -> bytes:
    """The source of a size."""
    out = bytearray(size)
    for kind, section in sections(data):
        reader = BitReader(section)
        reader.bits(64)  # the kind, and a field that is not used
        if kind == COPY:
            lengths = rift.IntFormat.default()
            for to, start in rift.read_map(reader):
                _copy(out, to, target, start, lengths.read_number(reader))
        elif kind == DELETED:
            packed = reader.bits(32)
            entries = rift.read_map(reader)
            blob = reader.buffer()
            _bring_back(out, entries, read_container(blob, XPRESS_HUFF) if packed else blob)
        elif kind == BYTES:
            for at, value in reversed(rift.read_map(reader)):
                if 0 <= at < size:
                    out[at] = value & 255
        else:
            raise malformed("reverse delta: invalid payload type")
    return bytes(out)


def _copy(out: bytearray, to: int, target: bytes, start: int, n: int) -> None:
    """What lies in both buffers of a copy; none if it begins before either."""
    n = min(n, len(out) - max(0, to), len(target) - max(0, start))
    if n > 0 and to >= 0 and start >= 0:
        out[to : to + n] = target[start : start + n]


def _bring_back(out: bytearray, entries: rift.Map, blob: bytes) -> None:
    """Entries are (where, how many); their bytes follow each other in blob."""
    at = 0
    for to, n in entries:
        if n < 0:
            raise malformed("reverse delta: negative delete length")
        if at + n > len(blob):
            raise malformed("reverse delta: delete blob overrun")
        if to < 0 or to + n > len(out):
            raise malformed("reverse delta: delete dest out of range")
        out[to : to + n] = blob[at : at + n]
        at += n
