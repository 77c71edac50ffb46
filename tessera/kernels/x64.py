"""Lengths of x86-64 instructions, and where their 32-bit displacements relative to the next instruction are."""

from __future__ import annotations

from functools import lru_cache

PLAIN, STOP, MODRM, ADDRESS, REL8, REL32 = range(6)
BYTE, WORD, ENTER, BY_REX, DWORD, GROUP_BYTE, GROUP_DWORD = range(1, 8)
LONGEST = 15
PREFIXES = frozenset((0x26, 0x2E, 0x36, 0x3E, 0x64, 0x65, 0x66, 0x67, 0xF0, 0xF2, 0xF3))
# What follows an opcode, by ranges (first, last); all others are PLAIN, and have no immediate.
ONE_BYTE = {
    STOP: ((0x40, 0x4F), (0x60, 0x62), (0x64, 0x67), (0x82, 0x82), (0x9A, 0x9A), (0x9E, 0x9F), (0xC4, 0xC5), (0xCE, 0xCE), (0xD4, 0xD6), (0xEA, 0xEA)),
    MODRM: ((0x63, 0x63), (0x69, 0x69), (0x6B, 0x6B), (0x80, 0x81), (0x83, 0x8F), (0xC0, 0xC1), (0xC6, 0xC7), (0xD0, 0xD3), (0xD8, 0xDF), (0xF6, 0xF7), (0xFE, 0xFF)),
    ADDRESS: ((0xA0, 0xA3),),
    REL8: ((0x70, 0x7F), (0xE0, 0xE3), (0xEB, 0xEB)),
    REL32: ((0xE8, 0xE9),),
}
TWO_BYTE = {
    STOP: ((0x0A, 0x0A), (0x0C, 0x0C), (0x19, 0x1F), (0x24, 0x27), (0x34, 0x3F), (0x78, 0x7D), (0xA6, 0xA7), (0xB8, 0xB8), (0xD0, 0xD0), (0xF0, 0xF0), (0xFF, 0xFF)),
    MODRM: (
        (0x00, 0x03), (0x0D, 0x0D), (0x0F, 0x18), (0x20, 0x23), (0x28, 0x2F), (0x40, 0x76), (0x7E, 0x7F), (0x90, 0x9F),
        (0xA3, 0xA5), (0xAB, 0xB7), (0xB9, 0xC7), (0xD1, 0xEF), (0xF1, 0xFE),
    ),
    REL32: ((0x80, 0x8F),),
}
ONE_BYTE_IMMEDIATE = {
    BYTE: ((0x6A, 0x6B), (0x80, 0x80), (0x82, 0x83), (0xA8, 0xA8), (0xB0, 0xB7), (0xC0, 0xC1), (0xC6, 0xC6), (0xCD, 0xCD), (0xE4, 0xE7)),
    WORD: ((0xC2, 0xC2), (0xCA, 0xCA)),
    ENTER: ((0xC8, 0xC8),),
    BY_REX: ((0xB8, 0xBF),),
    DWORD: ((0x68, 0x69), (0x81, 0x81), (0xA9, 0xA9), (0xC7, 0xC7)),
    GROUP_BYTE: ((0xF6, 0xF6),),
    GROUP_DWORD: ((0xF7, 0xF7),),
}
TWO_BYTE_IMMEDIATE = {BYTE: ((0x0F, 0x0F), (0x70, 0x73), (0xA4, 0xA4), (0xAC, 0xAC), (0xBA, 0xBA), (0xC2, 0xC2), (0xC4, 0xC6))}


@lru_cache(maxsize=1)
def opcode_tables() -> tuple[list[int], list[int], list[int], list[int]]:
    """What follows and the immediate, of one-byte opcodes and of those after 0F."""
    tables = []
    for kinds in (ONE_BYTE, ONE_BYTE_IMMEDIATE, TWO_BYTE, TWO_BYTE_IMMEDIATE):
        table = [0] * 256
        for kind, ranges in kinds.items():
            for first, last in ranges:
                table[first : last + 1] = [kind] * (last + 1 - first)
        tables.append(table)
    for op in range(0x40):  # arithmetic: four forms with operands, two with immediates, two that are gone
        tables[0][op] = (MODRM, MODRM, MODRM, MODRM, PLAIN, PLAIN, STOP, STOP)[op & 7]
        tables[1][op] = {4: BYTE, 5: DWORD}.get(op & 7, 0)
    return tuple(tables)


class _Stop(Exception):
    def __init__(self, at: int):
        self.at = at


def decode(code: bytes) -> tuple[int, int | None]:
    """Length, and where a displacement relative to the next instruction is. Cut short where bytes end or aren't known."""
    try:
        return _decode(code[:LONGEST])
    except _Stop as stop:
        return stop.at, None


def _decode(code: bytes) -> tuple[int, int | None]:
    at = 0

    def need(n: int) -> int:
        """Pass over n bytes, that have to be there; where they began."""
        nonlocal at
        if len(code) - at < n:
            raise _Stop(at)
        at += n
        return at - n

    while at < len(code) and code[at] in PREFIXES:
        at += 1
    narrow, short_address = 0x66 in code[:at], 0x67 in code[:at]
    need(1)
    at -= 1
    wide = False
    if code[at] & 0xF0 == 0x40:
        wide = bool(code[at] & 8)
        need(1)
        if at >= len(code) or code[at] & 0xF0 == 0x40:
            raise _Stop(at)
    kinds, immediates, kinds_0f, immediates_0f = opcode_tables()
    if code[at] == 0x0F:
        at += 1
        op = code[need(1)]
        kind, immediate = kinds_0f[op], immediates_0f[op]
    else:
        op = code[need(1)]
        kind, immediate = kinds[op], immediates[op]
    if kind == STOP:
        raise _Stop(at)
    relative, group = None, 8
    if kind == MODRM:
        operand = code[need(1)]
        mode, group, register = operand >> 6, operand >> 3 & 7, operand & 7
        if mode == 0 and register == 5:
            relative = need(4)
        elif mode != 3:
            base = code[need(1)] & 7 if register == 4 else None
            need(4 if mode == 2 or (mode == 0 and base == 5) else mode)
    elif kind == ADDRESS:
        need(4 if short_address else 8)
    elif kind == REL8:
        need(1)
    elif kind == REL32:
        relative = need(4)
    if immediate == BYTE or (immediate == GROUP_BYTE and group < 2):
        need(1)
    elif immediate in (WORD, DWORD) or (immediate == GROUP_DWORD and group < 2):
        need(2 if narrow else 4)
    elif immediate == BY_REX:
        need(8 if wide else 2 if narrow else 4)
    return at, relative
