"""Patches of (add, insert, seek) triples, each followed by its bytes to add to the source's and its bytes to insert."""

from __future__ import annotations

from tessera.kernels.errors import malformed, truncated

MOST, LEAST_MATCH = 64 << 20, 8
_SIGN = 1 << 63


def _read(data: bytes, at: int) -> int:
    """Magnitude and sign, not two's complement."""
    raw = int.from_bytes(data[at : at + 8], "little")
    return -(raw & ~_SIGN) if raw & _SIGN else raw


def _written(value: int) -> bytes:
    return (abs(value) | (_SIGN if value < 0 else 0)).to_bytes(8, "little")


def patch(source: bytes, size: int, data: bytes) -> bytes:
    """The target of a size. Source bytes out of range are zero."""
    if size > MOST:
        raise malformed("target size exceeds 64 MiB")
    out, at, old = bytearray(), 0, 0
    while len(out) < size:
        if at + 24 > len(data):
            raise truncated("patch")
        add, insert, seek = (_read(data, at + k) for k in (0, 8, 16))
        at += 24
        if not (0 <= add <= 0x7FFFFFFF and 0 <= insert <= 0x7FFFFFFF):
            raise malformed("control value too large")
        if len(out) + add + insert > size:
            raise malformed("patch exceeds target size")
        if at + add + insert > len(data):
            raise truncated("patch")
        inside = bytes(max(0, min(add, -old))) + source[max(0, old) : max(0, old + add)]
        base = inside.ljust(add, b"\0")
        out += bytes((a + b) & 255 for a, b in zip(data[at : at + add], base, strict=False))
        out += data[at + add : at + add + insert]
        at, old = at + add + insert, old + add + seek
    return bytes(out)


def suffix_array(data: bytes) -> list[int]:
    """Where suffixes begin, in their order, by doubling the length that they are ranked by."""
    order, rank, step = list(range(len(data))), list(data), 1
    while len(data) > 1:
        key = [r << 32 | (rank[i + step] + 1 if i + step < len(data) else 0) for i, r in enumerate(rank)]
        order.sort(key=key.__getitem__)
        fresh, n = [0] * len(data), 0
        for before, here in zip(order, order[1:], strict=False):
            n += key[here] != key[before]
            fresh[here] = n
        rank = fresh
        if n == len(data) - 1:
            break
        step *= 2
    return order


def _common(a: bytes, at: int, b: bytes, to: int) -> int:
    n = 0
    while at + n < len(a) and to + n < len(b) and a[at + n] == b[to + n]:
        n += 1
    return n


def longest_match(source: bytes, order: list[int], target: bytes, at: int) -> tuple[int, int]:
    """(length, place in the source) of the longest match of the target at a place."""
    low, high = 0, len(order)
    while low < high:
        middle = (low + high) // 2
        n = _common(source, order[middle], target, at)
        place = order[middle] + n
        if at + n < len(target) and (place == len(source) or source[place] < target[at + n]):
            low = middle + 1
        else:
            high = middle
    near = [order[k] for k in (low - 1, low) if 0 <= k < len(order)]
    return max(((_common(source, p, target, at), p) for p in near), default=(0, 0))


def create(source: bytes, target: bytes) -> bytes:
    """A patch: exact matches stretched as long as at least half of their bytes agree, the rest inserted."""
    order = suffix_array(source)
    pieces: list[tuple[int, int, int]] = []  # start in the target, length, start in the source
    at = 0
    while at < len(target):
        n, place = longest_match(source, order, target, at)
        if n < LEAST_MATCH:
            at += 1
            continue
        end, agreed, best, k = at + n, 0, 0, 0
        while end + k < len(target) and place + n + k < len(source) and k < 64:
            agreed += 1 if target[end + k] == source[place + n + k] else -1
            k += 1
            if agreed > 0:
                best, agreed = k, 0
        pieces.append((at, n + best, place))
        at = end + best
    out, done, old = [], 0, 0
    if not pieces or pieces[0][0]:
        pieces.insert(0, (0, 0, 0))
    for k, (start, n, place) in enumerate(pieces):
        following = pieces[k + 1] if k + 1 < len(pieces) else (len(target), 0, place + n)
        insert = target[start + n : following[0]]
        if k == 0 and place != old:  # a triple that only seeks
            out += [_written(0), _written(0), _written(place)]
        out += [_written(n), _written(len(insert)), _written(following[2] - place - n)]
        out += [bytes((a - b) & 255 for a, b in zip(target[start : start + n], source[place : place + n], strict=True)), insert]
        done = following[0]
    assert done == len(target)
    return b"".join(out)
