"""Reproducible test inputs: a small random generator, and pairs of a reference and a target by category."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.kernels import pe

MASK = (1 << 64) - 1


class SplitMix64:
    """The seeding generator of the xoshiro family."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return self.next() % n if n else 0

    def between(self, low: int, high: int) -> int:
        return low + self.below(high - low + 1)

    def bytes(self, n: int) -> bytes:
        return b"".join(self.next().to_bytes(8, "little") for _ in range(-(-n // 8)))[:n]

    def chance(self, a: int, b: int) -> bool:
        return (self.next() & 0xFFFFFFFF) % b < a


def derived_seed(seed: int, label: str) -> int:
    """A seed for a label: FNV-1a of its bytes, mixed in."""
    h = 0xCBF29CE484222325
    for b in label.encode():
        h = (h ^ b) * 0x100000001B3 & MASK
    return seed ^ h


Pair = tuple[str, bytes, bytes]


def _edited(rng: SplitMix64, data: bytes, most: int = 8) -> bytes:
    """Some inserted, deleted or overwritten stretches."""
    out = bytearray(data)
    for _ in range(rng.between(1, most)):
        at, n = rng.below(len(out) + 1), rng.between(1, 32)
        kind = rng.below(3)
        if kind == 0:
            out[at:at] = rng.bytes(n)
        elif kind == 1:
            del out[at : at + n]
        else:
            out[at : at + n] = rng.bytes(min(n, len(out) - at))
    return bytes(out)


def random_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Bytes without structure; half of the targets are edits of their reference."""
    rng = SplitMix64(derived_seed(seed, "random"))
    for i in range(count):
        reference = rng.bytes(rng.between(16, 8191))
        yield f"random.{i:04}", reference, _edited(rng, reference) if rng.chance(1, 2) else rng.bytes(rng.between(16, 8191))


def text_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Lines of words, with lines changed, dropped and added."""
    rng = SplitMix64(derived_seed(seed, "text"))
    words = ("alpha", "beta", "gamma", "delta", "the", "quick", "value", "=", "1.0")

    def line() -> bytes:
        return " ".join(words[rng.below(len(words))] for _ in range(rng.between(2, 12))).encode()

    for i in range(count):
        lines = [line() for _ in range(rng.between(8, 199))]
        changed = list(lines)
        for _ in range(rng.between(1, 10)):
            at, kind = rng.below(len(changed)), rng.below(3)
            changed[at : at + (kind != 0)] = [line()] if kind != 2 or len(changed) == 1 else []
        yield f"text.{i:04}", b"\n".join(lines), b"\n".join(changed)


def run_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Runs and repeats, with stretches inserted, deleted and overwritten."""
    rng = SplitMix64(derived_seed(seed, "fuzz_derived"))
    for i in range(count):
        size, out = rng.between(64, 16383), bytearray()
        while len(out) < size:
            out += bytes([rng.below(256)]) * rng.between(1, 64) if rng.chance(1, 2) or not out else out[rng.below(len(out)) :][: rng.between(4, 96)]
        reference = bytes(out[:size])
        yield f"fuzz_derived.{i:04}", reference, _edited(rng, reference, 16)


def replay_pairs(seed: int = 0, count: int = 0) -> Iterator[Pair]:
    """Fixed pairs: a short text, a body large enough for several segments, the same twice, and an empty target."""
    text = b"A reference with some repeated content. The lazy dog. Repeated content repeated content."
    other = b"A reference with MODIFIED repeated content. The lazy cat. Repeated content repeated content."
    body = bytes((i * 2654435761 & 0xFFFFFFFF) >> 13 & 255 for i in range(400_000))
    flipped = bytearray(body)
    for at in range(17, len(flipped), 4096):
        flipped[at] ^= 0xAA
    yield "corpus.text", text, other
    yield "corpus.body", body, bytes(flipped) + b"an appended tail that is not in the reference"
    yield "corpus.identical", text, text
    yield "corpus.empty_target", text, b""


def manifest_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Assembly manifests, with versions, file entries and digests changed."""
    rng = SplitMix64(derived_seed(seed, "manifest_pair"))

    def entry() -> str:
        return f'<file name="f{rng.below(1000)}.dll" hash="{rng.bytes(8).hex()}" size="{rng.below(1 << 20)}"/>'

    for i in range(count):
        name, build, files = f"part-{rng.below(100)}", rng.below(20_000), [entry() for _ in range(rng.between(3, 40))]
        changed = [entry() if rng.chance(1, 5) else f for f in files] + [entry() for _ in range(rng.below(3))]
        text = [
            f'<?xml version="1.0" encoding="utf-8"?><assembly><identity name="{name}" version="10.0.{b}.1"/>{"".join(rows)}</assembly>'
            for b, rows in ((build, files), (build + rng.between(1, 50), changed))
        ]
        yield f"manifest_pair.{i:04}", *(t.encode() for t in text)


def small_image(code: bytes, data: bytes, stamp: int, plus: bool = True, clr: tuple[int, int] = (0, 0)) -> bytes:
    """An executable with a section of code and one of data."""
    align = lambda n, to: -(-n // to) * to
    word = lambda n, size=4: n.to_bytes(size, "little")
    room, size = align(max(1, len(code)), 0x200), align(max(1, len(data)), 0x200)
    after = 0x1000 + align(room, 0x1000)
    optional = bytearray(240 if plus else 224)
    optional[0:2] = word(pe.PE32_PLUS if plus else pe.PE32, 2)
    if plus:
        optional[24:32] = word(0x140000000, 8)
    else:
        optional[28:32] = word(0x400000)
    optional[56:60] = word(after + align(size, 0x1000))
    at = 108 if plus else 92
    optional[at : at + 4] = word(len(pe.DIRECTORIES))
    optional[at + 4 + 8 * pe.CLR : at + 12 + 8 * pe.CLR] = word(clr[0]) + word(clr[1])
    rows = b"".join(
        name.ljust(8, b"\0") + word(length) + word(va) + word(raw_size) + word(raw) + bytes(12) + word(flags)
        for name, length, va, raw_size, raw, flags in ((b".text", len(code), 0x1000, room, 0x400, 0x60000020), (b".data", len(data), after, size, 0x400 + room, 0xC0000040))
    )
    coff = word(pe.AMD64 if plus else pe.I386, 2) + word(2, 2) + word(stamp) + bytes(8) + word(len(optional), 2) + word(0x22, 2)
    head = (b"MZ".ljust(0x3C, b"\0") + word(0x80)).ljust(0x80, b"\0") + b"PE\0\0" + coff + optional + rows
    return head.ljust(0x400, b"\0") + code.ljust(room, b"\x90") + data.ljust(size, b"\0")


def image_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Executables whose calls move as code is inserted before them; every other is of 32 bits."""
    rng = SplitMix64(derived_seed(seed, "pe_pair"))
    for i in range(count):
        places = sorted({rng.between(64, 1500) for _ in range(rng.between(4, 30))})
        inserted, at = rng.bytes(rng.between(1, 64)), rng.between(0, 63)

        def code(shift: int, places=places) -> bytes:
            out = bytearray(b"\x90" * 2048)
            for k, place in enumerate(places):
                if place + 5 <= 2000:
                    to = 16 * (k % 4) + 2000
                    out[place : place + 5] = b"\xe8" + ((to + shift - place - shift - 5) & 0xFFFFFFFF).to_bytes(4, "little")
            return bytes(out)

        data, plain = rng.bytes(rng.between(50, 700)), code(0)
        moved = plain[:at] + inserted + code(len(inserted))[at:]
        yield f"pe_pair.{i:04}", small_image(plain, data, 1 + rng.below(1 << 30), i % 2 == 0), small_image(moved, _edited(rng, data), 1 + rng.below(1 << 30), i % 2 == 0)


def managed_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Executables that say they have a managed header, whose metadata are cut off or not there: what must be told from real ones."""
    rng = SplitMix64(derived_seed(seed, "managed"))
    for i in range(count):
        header = bytes(8) + (0x1080).to_bytes(4, "little") + rng.below(400).to_bytes(4, "little") + bytes(0x38)
        body = header.ljust(0x80, b"\0") + b"BSJB" + rng.bytes(rng.between(0, 200))
        reference, target = (small_image(x, b"data", 7, False, (0x1000, 0x48)) for x in (body, _edited(rng, body)))
        yield f"managed.{i:04}", reference, target


def sweep_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Pairs of all sizes around powers of two, to be made under every mode (see operators.cases.matrix)."""
    rng = SplitMix64(derived_seed(seed, "create_mode_sweep"))
    for i in range(count):
        size = max(0, (1 << (i % 15)) + i // 15 - 1)
        reference = rng.bytes(size)
        yield f"create_mode_sweep.{i:04}", reference, _edited(rng, reference) if size else rng.bytes(i % 7)


def reverse_pairs(seed: int, count: int) -> Iterator[Pair]:
    """Texts whose deltas are to be applied and turned back."""
    for name, reference, target in text_pairs(derived_seed(seed, "reverse"), count):
        yield name.replace("text", "reverse"), reference, target


#: Categories in the order of a suite.
GENERATORS = {
    "random": random_pairs, "text": text_pairs, "fuzz_derived": run_pairs, "manifest_pair": manifest_pairs, "pe_pair": image_pairs,
    "managed": managed_pairs, "corpus_replay": replay_pairs, "create_mode_sweep": sweep_pairs, "reverse": reverse_pairs,
}
