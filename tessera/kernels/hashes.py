"""Signatures by algorithm number."""

from __future__ import annotations

import hashlib
import zlib

from tessera.kernels.errors import DeltaError, malformed

# Algorithm numbers.
NONE, MD5, SHA1, SHA256 = 0, 0x8003, 0x8004, 0x800C
_NAMES = {MD5: "md5", SHA1: "sha1", SHA256: "sha256"}


def signature(data: bytes, algorithm: int) -> bytes:
    if algorithm not in _NAMES:
        raise malformed("unsupported hash algorithm")
    return hashlib.new(_NAMES[algorithm], data, usedforsecurity=False).digest()


def verify(data: bytes, algorithm: int, expected: bytes) -> None:
    """Nothing to verify without an algorithm or a hash."""
    if algorithm and expected and signature(data, algorithm) != expected:
        raise DeltaError("hash mismatch", f"expected {expected.hex()}")


def crc_register(data: bytes) -> int:
    """CRC-32 without its final complement, as stored in PA19 headers."""
    return zlib.crc32(data) ^ 0xFFFFFFFF
