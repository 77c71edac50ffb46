"""The four bytes that wrap a compressed manifest."""

from __future__ import annotations

from tessera.kernels.errors import DeltaError, truncated

MAGIC = b"DCM\x01"


def is_wrapped(data: bytes) -> bool:
    return data[:4] == MAGIC


def strip(data: bytes) -> bytes:
    if len(data) < len(MAGIC):
        raise truncated("DCM")
    if not is_wrapped(data):
        raise DeltaError("bad magic", data[:4].hex())
    return data[len(MAGIC) :]


def wrap(data: bytes) -> bytes:
    return MAGIC + data
