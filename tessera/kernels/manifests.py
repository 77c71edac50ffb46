"""Compressed manifests: the base that they are deltas to, found within a system library, and decoding."""

from __future__ import annotations

from tessera.kernels import dcm, delta, pe
from tessera.kernels.errors import DeltaError

# What marks the base manifest, and how it begins.
ANCHOR = b'asm.v3" manifestVersion="1.0" description="Deployment"'
PROLOG = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
BEFORE_ANCHOR, BEFORE_BASE, LONGEST = 256, 64, 1 << 20


def extract_base(library: bytes) -> bytes:
    """The base manifest in an image: its length stands after its address, nearest before it or else the least anywhere."""
    image = pe.parse(library)
    anchor = library.find(ANCHOR)
    if anchor < 0:
        raise DeltaError("base manifest", "anchor not found")
    start = library.find(PROLOG, max(0, anchor - BEFORE_ANCHOR), anchor)
    if start < 0:
        raise DeltaError("base manifest", "XML prolog not found before anchor")
    rva = image.rva(start)
    if rva is None:
        raise DeltaError("base manifest", "base offset not inside any section")
    section = next(s for s in image.sections if s.holds_offset(start))
    needle = rva.to_bytes(4, "little")

    def length(at: int) -> int | None:
        n = pe.u32(library, at + 4) if at + 8 <= len(library) else 0
        fits = len(PROLOG) <= n <= LONGEST and start + n <= len(library) and section.holds_offset(start + n - 1)
        return n if fits else None

    near = library.rfind(needle, max(0, start - BEFORE_BASE), start)
    if near >= 0 and (n := length(near)):
        return library[start : start + n]
    found, at = [], library.find(needle)
    while at >= 0:
        found.append(length(at))
        at = library.find(needle, at + 1)
    if not any(found):
        raise DeltaError("base manifest", "length descriptor not found")
    return library[start : start + min(n for n in found if n)]


def decompress(base: bytes, manifest: bytes) -> bytes:
    return delta.apply(base, dcm.strip(manifest) if dcm.is_wrapped(manifest) else manifest)
