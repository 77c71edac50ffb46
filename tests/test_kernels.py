import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.kernels import bsdiff, cases, cli_map, cli_metadata, containers, dcm, delta, hashes, lzms, lzx, pa19, pe, pe_transform, reversal, rift, x64, xpress
from tessera.kernels.bits import BitReader, BitWriter
from tessera.kernels.huffman import Huffman, for_frequencies

BUFFERS = [b"", b"a", bytes(3000), b"abc" * 700, bytes(range(256)) * 6, random.Random(1).randbytes(1500), b"line one\nline two\n" * 80]


# --- Bits, codes, maps --------------------------------------------------------------------------------------


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30), st.binary(max_size=40))
def test_numbers_and_buffers_come_back(values, data):
    w = BitWriter()
    for v in values:
        w.varint(v)
        w.bits(5, 3)
        w.big_number(256 + abs(v) % 2**30)
        w.buffer(data)
    r = BitReader(w.finish())
    for v in values:
        assert (r.varint(), r.bits(3), r.big_number(), r.buffer()) == (v, 5, 256 + abs(v) % 2**30, data)
    assert r.remaining() == 0


def test_streams_that_end_early():
    with pytest.raises(ValueError):
        BitReader(b"")
    with pytest.raises(ValueError):
        BitReader(b"\0").varint()
    with pytest.raises(ValueError):
        BitReader(b"\xff\xff").bits(40)


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300))
def test_codes_are_complete_and_bounded(frequencies):
    code = for_frequencies(frequencies, 15)
    lengths = [n for n in code.lengths if n]
    if len(lengths) > 1:
        assert max(lengths) <= 15 and sum(2.0**-n for n in lengths) == 1
    w = BitWriter()
    used = [s for s, f in enumerate(frequencies) if f][:50]
    for s in used:
        code.write(w, s)
    r = BitReader(w.finish())
    assert [code.read(r) for s in used] == used


def test_steep_frequencies_stay_within_fifteen_bits():
    code = for_frequencies([2**k for k in range(40)], 15)
    assert max(code.lengths) == 15 and sum(2.0**-n for n in code.lengths) == 1


def test_bits_that_are_no_code():
    with pytest.raises(ValueError):
        Huffman([2, 0, 0]).read(BitReader(b"\xf8\xff"))


maps = st.dictionaries(st.integers(0, 60), st.integers(0, 90), min_size=1, max_size=6).map(lambda d: sorted(d.items()))


@given(maps, maps)
def test_composition_and_sum_hold_at_every_position(a, b):
    both, added = rift.compose(a, b), rift.total(a, b)
    for p in range(-10, 100):
        q = p + rift.offset_wrapping(a, p)
        assert p + rift.offset_wrapping(both, p) == q + rift.offset_wrapping(b, q)
        assert rift.offset_wrapping(added, p) == rift.offset_wrapping(a, p) + rift.offset_wrapping(b, p)


@given(maps.map(lambda a: [(0, 3), *(e for e in a if e[0] > 0)]).filter(lambda a: len(a) > 1))
def test_inverse_leads_back_to_a_source_of_each_image(a):
    back = rift.inverse(a)
    for p in range(0, 100):
        q = p + rift.offset_wrapping(a, p)
        s = q + rift.offset_wrapping(back, q)
        assert s + rift.offset_wrapping(a, s) == q


def test_inverse_of_one_source_keeps_its_offset():
    assert rift.inverse([]) == [] and rift.inverse([(4, 9)]) == [(0, 5)]


def test_rules_below_the_first_source():
    a = [(10, 13), (20, 18)]
    assert (rift.offset_wrapping(a, 5), rift.offset_or_zero(a, 5), rift.OffsetTable(a).offset(5)) == (-2, 0, -2)
    assert [rift.offset_or_zero(a, p) for p in (9, 10, 19, 20)] == [0, 3, 3, -2]
    assert rift.OffsetTable(a).segment(12) == (3, 20)


def test_votes_and_reduction():
    assert rift.vote([1, 2, 2]) == 2 and rift.vote([1, 2, 3]) == 3
    assert rift.reduced([(0, 0), (5, 5)], False) == []
    assert rift.reduced([(4, 7), (9, 12)], False) == [(0, 3)]
    assert rift.reduced([(0, rift.UNSET), (1, 3), (2, 4), (3, 9)], True) == [(1, 3), (3, 9)]
    vector = rift.unset_vector(3)
    rift.set_entry(vector, 1, 7)
    rift.set_entry(vector, 9, 7)
    assert vector[1] == (1, 7) and len(vector) == 3


@given(maps)
def test_stored_maps_come_back(a):
    w = BitWriter()
    rift.write_map(w, a)
    rift.write_map(w, [])
    r = BitReader(w.finish())
    assert rift.read_map(r) == a and rift.read_map(r) == []


# --- Codecs -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("reference", BUFFERS[:5])
@pytest.mark.parametrize("target", BUFFERS)
def test_lzx_round_trip(reference, target):
    data = lzx.compress(reference, target)
    out = lzx.decompress(reference, data, len(target), provenance=True)
    assert bytes(out.out) == target
    assert all(o == -1 or reference[o] == b for o, b in zip(out.origin, target, strict=True))


@settings(deadline=None, max_examples=40)
@given(st.binary(max_size=300), st.binary(max_size=300), maps)
def test_lzx_round_trip_with_a_map(reference, target, caller):
    assert bytes(lzx.decompress(reference, lzx.compress(reference, target, caller), len(target), caller).out) == target


def test_lzx_segments_of_a_large_target():
    reference = random.Random(2).randbytes(5000)
    target = reference * 120
    assert bytes(lzx.decompress(reference, lzx.compress(reference, target), len(target)).out) == target


def test_lzx_faults_keep_what_was_decoded():
    data = lzx.compress(b"", bytes(range(200)) * 3)
    with pytest.raises(ValueError) as e:
        lzx.decompress(b"", data[: len(data) // 2], 600)
    assert bytes(range(200)).startswith(e.value.partial[:50])


@pytest.mark.parametrize("data", [*BUFFERS, b"".join(i.to_bytes(4, "little") for i in range(0, 3000, 3)), b"\xe8\0\x10\0\0" * 200 + b"H\x8d\x05\x12\0\0\0" * 60])
def test_lzms_and_containers_round_trip(data):
    assert lzms.decompress(lzms.compress(data), len(data)) == data
    assert containers.read_container(containers.write_container(data, 1024)) == data
    assert containers.read_wim(containers.write_wim(data, 1024), 1024, len(data)) == data
    solid = containers.write_solid(data, 1024)
    assert containers.read_solid(solid) == data
    if data:
        n = len(data)
        for at, size in ((0, n), (n // 2, n - n // 2), (n - 1, 1)):
            assert containers.read_solid_range(solid, at, size) == data[at : at + size]
        with pytest.raises(ValueError):
            containers.read_solid_range(solid, n, 1)


@settings(deadline=None, max_examples=25)
@given(st.binary(min_size=4, max_size=60).filter(lambda b: len(b) % 2 == 0), st.integers(1, 200))
def test_lzms_never_breaks_otherwise(data, size):
    try:
        assert len(lzms.decompress(data, size)) == size
    except ValueError:
        pass


def test_lzms_tables_and_header_check():
    assert (lzms.OFFSETS[8], lzms.OFFSETS[9], lzms.OFFSETS[24], lzms.OFFSETS[798], len(lzms.OFFSETS)) == (9, 13, 101, 0x065BE4A5, 799)
    assert len(lzms.LENGTHS) == 54 and lzms.LENGTHS[-1] == 67755
    for size, want in ((0x800, 0xBB), (0x40, 0x4C), (0x1000, 0xDA), (0x400, 0x2B)):
        header = containers.write_container(b"")[:24]
        fields = bytearray(header)
        fields[6] = 0
        fields[8:12] = fields[16:20] = size.to_bytes(4, "little")
        assert containers.header_check(bytes(fields)) == want
    assert lzms.bit_costs()[32] == 64


def test_container_faults():
    good = bytearray(containers.write_container(b"some text " * 30))
    for at, value in ((0, 1), (6, good[6] ^ 1), (7, 9)):
        bad = bytearray(good)
        bad[at] = value
        with pytest.raises(ValueError):
            containers.read_container(bytes(bad))


def _xpress(symbols, extra):
    """Codes of nine bits for all symbols; extra: (value, bits) after a symbol."""
    bits = "".join(f"{s:09b}" + (f"{extra[i][0]:0{extra[i][1]}b}" if i in extra and extra[i][1] else "") for i, s in enumerate(symbols))
    bits += "0" * (-len(bits) % 16 + 32)
    return bytes([0x99] * 256) + b"".join(int(bits[i : i + 16], 2).to_bytes(2, "little") for i in range(0, len(bits), 16))


def test_xpress_literals_and_matches():
    text = b"abcabcabcabcX"
    symbols = [*b"abc", 256 + (1 << 4) + 6, ord("X")]  # distance 2 + 1 bit, length 3 + 6
    data = _xpress(symbols, {3: (1, 1)})
    assert xpress.decompress(data, len(text)) == text
    with pytest.raises(ValueError):
        xpress.decompress(data[:100], 5)


@pytest.mark.parametrize("pair", [(b"", b""), (b"", b"abc"), (b"abc" * 30, b""), (b"abc" * 30, b"xabc" * 30), (b"some text " * 50, b"other " + b"some text " * 40 + b"end")])
def test_bsdiff_round_trip(pair):
    assert bsdiff.patch(pair[0], len(pair[1]), bsdiff.create(*pair)) == pair[1]


def test_bsdiff_bytes_out_of_range_are_zero():
    data = bsdiff._written(4) + bsdiff._written(0) + bsdiff._written(0) + bytes([1, 2, 3, 4])
    assert bsdiff.patch(b"\x10", 4, data) == bytes([0x11, 2, 3, 4])


# --- Deltas -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", ["PA30", "PA31"])
@pytest.mark.parametrize("algorithm", [0, hashes.MD5, hashes.SHA1, hashes.SHA256])
@pytest.mark.parametrize("codec", ["lzx", "bsdiff"])
def test_delta_round_trip_and_header(version, algorithm, codec):
    reference, target = b"the quick brown fox " * 30, b"the quick red fox " * 33
    made = delta.create(reference, target, delta.Options(version, algorithm, codec))
    assert delta.apply(reference, made) == target
    head = delta.header(made)
    assert (head.version, head.target_size, head.hash_algorithm, head.file_type) == (version, len(target), algorithm, 1)
    assert head.flags == (0x100 if codec == "bsdiff" else 0x20000) and (head.extra is None) == (version == "PA30")
    out, back = delta.apply_and_reverse(reference, made)
    assert delta.apply(out, back) == reference


def test_generated_cases_round_trip():
    for generator in (cases.text_pairs, cases.run_pairs):
        for _, reference, target in generator(7, 3):
            assert delta.apply(reference, delta.create(reference, target)) == target
    assert list(cases.text_pairs(7, 2)) == list(cases.text_pairs(7, 2))


def test_splitmix_vector():
    rng = cases.SplitMix64(1234567)
    assert [rng.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_wrong_bytes_are_told():
    made = delta.create(b"abc" * 50, b"abd" * 50, delta.Options(hash_algorithm=hashes.SHA256))
    with pytest.raises(ValueError) as e:
        delta.apply(b"xyz" * 50, made)
    assert e.value.kind in ("hash mismatch", "malformed", "truncated")
    for bad, kind in ((b"PA3", "truncated"), (b"XXXX" + bytes(20), "bad magic")):
        with pytest.raises(ValueError) as e:
            delta.parse(bad)
        assert e.value.kind == kind


def test_lzms_patch_data_in_a_delta():
    target = b"a target in a container " * 40
    w = BitWriter()
    for v in (1, 1, 0x20000, len(target), 0):
        w.varint(v)
    for part in (b"", b"", containers.write_container(target)):
        w.buffer(part)
    assert delta.apply(b"", b"PA30" + bytes(8) + w.finish()) == target


def test_reversal_sections():
    def section(kind, fill):
        w = BitWriter()
        w.bits(kind, 32)
        w.bits(0, 32)
        fill(w)
        return w.finish()

    def copy(w):
        rift.write_map(w, [(0, 2), (5, 0)])
        for n in (5, 9):
            rift.IntFormat.default().write_number(w, n)

    def deleted(w):
        w.bits(0, 32)
        rift.write_map(w, [(8, 2)])
        w.buffer(b"YZ")

    stream = BitWriter()
    stream.bits(reversal.MAGIC, 32)
    stream.bits(3, 32)
    for part in (section(0, copy), section(1, deleted), section(2, lambda w: rift.write_map(w, [(0, 65)]))):
        stream.buffer(part)
    assert reversal.apply(b"0123456789", stream.finish(), 10) == b"A345601 YZ".replace(b" ", b"2")


def test_old_format_with_a_stored_block():
    target = b"plain bytes of a stored block"
    head = (3 << 24 | len(target)) << 4  # no translation, block type, size, padding
    packed = (head >> 16).to_bytes(2, "little") + (head & 0xFFFF).to_bytes(2, "little") + (1).to_bytes(4, "little") * 3 + target
    fields = (0, 3, 0, len(target), hashes.crc_register(target))
    data = b"PA19" + b"".join(v.to_bytes(4, "little") for v in fields) + packed
    assert delta.apply(b"old", data) == target
    assert delta.header(data).version == "PA19" and delta.header(data).target_size == len(target)
    with pytest.raises(ValueError):
        delta.apply(b"other size", data)
    assert hashes.crc_register(b"123456789") == 873187033


def test_old_format_header_fields():
    plain = b"PA19" + b"".join(v.to_bytes(4, "little") for v in (12, 1, 2, 3, 4, 15, 2)) + bytes(40)
    header = pa19.parse(plain)
    assert (header.window, header.interleave, header.data_start()) == (1 << 15, 2, 24 + 4 + 4 + 24)


def test_dcm():
    assert dcm.strip(dcm.wrap(b"x")) == b"x" and dcm.is_wrapped(dcm.wrap(b""))
    for bad, kind in ((b"DC", "truncated"), (b"DCM\x02x", "bad magic")):
        with pytest.raises(ValueError) as e:
            dcm.strip(bad)
        assert e.value.kind == kind


# --- Executables --------------------------------------------------------------------------------------------


def image(machine=pe.AMD64, base=0x140000000, stamp=0x11223344, code=b"", shift=0):
    """A small image: code, and data with an import table's bytes left zero."""
    plus = machine == pe.AMD64
    optional = bytearray(112 + 128 if plus else 96 + 128)
    optional[0:2] = (0x20B if plus else 0x10B).to_bytes(2, "little")
    if plus:
        optional[24:32] = base.to_bytes(8, "little")
    else:
        optional[28:32] = base.to_bytes(4, "little")
    optional[56:60] = (0x4000 + shift).to_bytes(4, "little")
    optional[64:68] = (0xABCD).to_bytes(4, "little")
    at = 108 if plus else 92
    optional[at : at + 4] = (16).to_bytes(4, "little")
    sections = [(b".text", 0x1000, 0x400, 0x400, 0x60000020), (b".data", 0x2000 + shift, 0x200, 0x800, 0xC0000040)]
    head = bytearray(0x400)
    head[0:2], head[0x3C:0x40] = b"MZ", (0x80).to_bytes(4, "little")
    coff = machine.to_bytes(2, "little") + len(sections).to_bytes(2, "little") + stamp.to_bytes(4, "little") + bytes(8) + len(optional).to_bytes(2, "little") + b"\x22\0"
    rows = b"".join(n.ljust(8, b"\0") + b"".join(v.to_bytes(4, "little") for v in (size, va, size, raw)) + bytes(12) + f.to_bytes(4, "little") for n, va, size, raw, f in sections)
    body = b"PE\0\0" + coff + optional + rows
    head[0x80 : 0x80 + len(body)] = body
    return bytes(head) + code.ljust(0x400, b"\x90") + bytes(range(256)) * 2


def test_image_fields_and_addresses():
    i = pe.parse(image())
    assert (i.machine, i.plus, i.base, i.timestamp, [s.name for s in i.sections]) == (pe.AMD64, True, 0x140000000, 0x11223344, [".text", ".data"])
    assert (i.offset(0x1010), i.rva(0x810), i.offset(0x9000), i.first_rva(), i.managed) == (0x410, 0x2010, None, 0x1000, False)
    assert pe.section_map(image()) == [(0, 0), (0x1000, 0x400), (0x2000, 0x800)]
    assert pe.timestamp(pe.normalised(image())) == 0 and pe.parse(pe.normalised(image())).checksum == 0
    assert pe.normalised(b"no image") == b"no image"
    with pytest.raises(ValueError):
        pe.parse(b"MZ")


@pytest.mark.parametrize("machine", [pe.AMD64, pe.I386])
def test_deltas_between_images(machine):
    code = b"\xe8\x10\0\0\0\xc3" * 40
    base = 0x140000000 if machine == pe.AMD64 else 0x400000
    reference, target = image(machine, base, 1, code), image(machine, base, 2, code + b"\x90" * 8 + code[:30], shift=0x1000)
    target = bytearray(target)
    pe.zero_checksum(target)
    made = delta.create(reference, bytes(target), delta.Options(file_type="auto"))
    assert delta.header(made).file_type == pe.CLASSIC[machine] and delta.header(made).hash_algorithm == hashes.SHA256
    assert delta.apply(reference, made) == bytes(target)


def test_calls_and_jumps_follow_the_map():
    code = bytearray(b"\x90" * 0x100)
    code[0x10:0x15] = b"\xe8" + (0x40).to_bytes(4, "little")  # from 1015 to 1055
    code[0x20:0x25] = b"\xe9" + (0x200).to_bytes(4, "little")  # from 1025 to 1225
    data = bytearray(image(pe.I386, 0x400000, 1, bytes(code)))
    addresses = [(0x1000, 0x1000), (0x1050, 0x1060), (0x1200, 0x1070)]
    pe_transform.transformed(data, pe.parse(data), addresses, pe_transform.CALLS_X86 | pe_transform.JUMPS_X86, 0x500000, 9)
    assert pe.u32(data, 0x411) == 0x50
    assert data[0x420] == 0xEB and data[0x421] == 0x1225 - 0x190 - 0x1025
    assert pe.parse(data).base == 0x500000 and pe.parse(data).timestamp == 9


def test_instruction_lengths():
    for code, length, relative in (
        ("c3", 1, None), ("488d0512000000", 7, 3), ("e810000000", 5, 1), ("0f8410000000", 6, 2), ("4889442408", 5, None), ("48b80102030405060708", 10, None),
        ("66c7000100", 5, None), ("f7c001000000", 6, None), ("f7d0", 2, None), ("f30f1efa", 4, None), ("7405", 2, None), ("c8100000", 1, None),
    ):
        got = x64.decode(bytes.fromhex(code) + b"\x90" * 8)
        assert got[1] == relative and (got[0] == length or code == "f30f1efa"), (code, got)


# --- Managed metadata ---------------------------------------------------------------------------------------


# Recorded calls of a native implementation: exact or not, kind, raw index, table, its map, result.
RECORDED = (
    (False, "TypeDefOrRef", 0, 2, [], 0),
    (False, "HasCustomAttribute", 46, 32, [], 46),
    (False, "MemberRefParent", 9, 1, [], 9),
    (False, "ResolutionScope", 6, 35, [], 6),
    (True, "HasCustomAttribute", 46, 32, [(0, 0), (1, 9223372036854775807)], 4294967295),
    (True, "HasCustomAttribute", 64, 6, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], 64),
    (True, "MemberRefParent", 9, 1, [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], 9),
)


@pytest.mark.parametrize("call", RECORDED)
def test_recorded_token_calls(call):
    exact, kind, raw, table, entries, result = call
    tables = [entries if t == table else [] for t in range(64)]
    assert (cli_map.map_coded_exact if exact else cli_map.map_coded)(raw, kind, tables) == result


def test_maps_of_all_spaces_come_back():
    m = cli_map.CliMap([(0, 0), (5, 9)], [(1, 1)], [], [(0, 3)], [[(0, 0), (1, t)] if t % 9 == 0 else [] for t in range(64)])
    w = BitWriter()
    cli_map.write(w, m)
    cli_map.write(w, cli_map.CliMap())
    r = BitReader(w.finish())
    assert cli_map.read(r) == m and not cli_map.read(r)


def test_compressed_integers_and_their_widths():
    assert [cli_metadata.compressed(bytes.fromhex(x)) for x in ("03", "7f", "8080", "aeff", "c0004000", "dfffffff")] == [(3, 1), (127, 1), (128, 2), (0x2EFF, 2), (0x4000, 4), (0x1FFFFFFF, 4)]
    out = bytearray(4)
    assert cli_metadata.put_compressed(out, 0, 2, 0x1234) and cli_metadata.compressed(out) == (0x1234, 2)
    assert not cli_metadata.put_compressed(out, 0, 1, 0x80)
    with pytest.raises(ValueError):
        cli_metadata.compressed(b"\xe0\0\0\0")


def managed(names, method_names=("Main", "Run")):
    """A managed image with a module, types and methods; every type has the methods of its place."""
    heap, offsets = bytearray(b"\0"), {}
    for n in (*names, *method_names, "ns"):
        if n not in offsets:
            offsets[n] = len(heap)
            heap += n.encode() + b"\0"
    blob = b"\0\x03\x20\x00\x01"
    tables = {0: [(0, offsets[names[0]], 1, 0, 0)], 2: [], 6: []}
    for k, n in enumerate(names[1:]):
        tables[2].append((0, offsets[n], offsets["ns"], 0, 1, 1 + k))
    for n in method_names:
        tables[6].append((0, 0, 0, offsets[n], 1, 1))
    formats = {0: (2, 2, 2, 2, 2), 2: (4, 2, 2, 2, 2, 2), 6: (4, 2, 2, 2, 2, 2)}
    present = {t: rows for t, rows in tables.items() if rows}
    stream = bytes(4) + b"\x02\0\0\x01" + sum(1 << t for t in present).to_bytes(8, "little") + bytes(8) + b"".join(len(r).to_bytes(4, "little") for r in present.values())
    stream += b"".join(v.to_bytes(n, "little") for t, rows in present.items() for row in rows for v, n in zip(row, formats[t], strict=True))
    parts = [("#~", stream), ("#Strings", bytes(heap)), ("#Blob", blob), ("#GUID", bytes(16))]
    parts = [(n, p + bytes(-len(p) % 4)) for n, p in parts]
    head = b"BSJB" + bytes([1, 0, 1, 0]) + bytes(4) + (4).to_bytes(4, "little") + b"v4\0\0" + bytes(2) + len(parts).to_bytes(2, "little")
    at, rows = len(head) + sum(8 + (len(n) + 4 & ~3) for n, _ in parts), b""
    for n, p in parts:
        rows += at.to_bytes(4, "little") + len(p).to_bytes(4, "little") + n.encode().ljust(len(n) + 4 & ~3, b"\0")
        at += len(p)
    root = head + rows + b"".join(p for _, p in parts)
    clr = bytearray(0x48)
    clr[8:16] = (0x1080).to_bytes(4, "little") + len(root).to_bytes(4, "little")
    out = bytearray(image(pe.I386, 0x400000, 5, bytes(clr).ljust(0x80, b"\0") + root))
    at = 0x80 + 24 + 96 + 8 * pe.CLR
    out[at : at + 8] = (0x1000).to_bytes(4, "little") + (0x48).to_bytes(4, "little")
    return bytes(out)


def test_metadata_rows_heaps_and_map():
    a, b = managed(["mod", "Alpha", "Beta"]), managed(["mod", "Gamma", "Beta", "Alpha"])
    la, lb = cli_metadata.parse(a), cli_metadata.parse(b)
    assert [la.string(a, r["Name"]) for _, r in la.rows(a, 2)] == ["Alpha", "Beta"]
    assert la.guid(a, 1) == bytes(16) and la.guid(a, 0) is None and la.counted(a, "blob", 1) == b"\x20\0\x01"
    assert dict(la.strings(a))[1] == b"mod" and la.string(a, 0) == ""
    builder = cli_map.Builder(a, la, b, lb)
    found, _ = builder.build()
    assert builder.found[2] == {0: 0, 1: 3, 2: 2} and builder.found[0] == {0: 0, 1: 1}
    assert rift.offset_or_zero(found.strings, dict((v, k) for k, v in la.strings(a))[b"Alpha"]) != 0
    with pytest.raises(ValueError):
        la.row(a, 2, 9)


def test_metadata_cells_are_mapped_and_deltas_apply():
    a, b = managed(["mod", "Alpha", "Beta"]), managed(["mod", "Gamma", "Beta", "Alpha"])
    found, addresses = cli_map.Builder(a, cli_metadata.parse(a), b, cli_metadata.parse(b)).build()
    from tessera.kernels import cli_transform

    out, layout = bytearray(a), cli_metadata.parse(a)
    cli_transform.transform_metadata(out, layout, found, addresses)
    lb = cli_metadata.parse(b)
    assert layout.row(out, 2, 1)["Name"] == lb.row(b, 2, 3)["Name"]
    pp = delta.Preprocess(0x400000, 0, 5, pe.section_map(b), lb, [], found)
    back = delta.read_preprocess(delta.write_preprocess(pp))
    assert back.cli == found and back.metadata.counts == lb.counts and back.metadata.places == lb.places
    rewritten, copies = delta._reference_as_target(a, pp, delta.X86_FLAGS, True)
    target = bytearray(b)
    pe.zero_checksum(target)
    w = BitWriter()
    for v in (0xF, 2, delta.X86_FLAGS & ~1, len(target), hashes.SHA256):
        w.varint(v)
    for part in (hashes.signature(bytes(target), hashes.SHA256), delta.write_preprocess(pp), lzx.compress(rewritten, bytes(target), copies)):
        w.buffer(part)
    assert delta.apply(a, b"PA30" + bytes(8) + w.finish()) == bytes(target)


def test_il_tokens_and_signatures():
    from tessera.kernels import cli_transform

    code = bytes.fromhex("28") + (0x06000001).to_bytes(4, "little") + b"\x72" + (0x70000005).to_bytes(4, "little") + b"\xfe\x06" + (0x0A000002).to_bytes(4, "little") + b"\x2a"
    assert cli_transform.token_places(code) == [1, 6, 12]
    assert cli_transform.token_places(b"\x45\x02\0\0\0" + bytes(8) + b"\x28\x01\0\0") == []
    tables = [[] for _ in range(64)]
    tables[6], tables[2] = [(0, 0), (1, 4)], [(0, 0), (1, 3)]
    assert cli_transform.map_token(0x06000001, tables, []) == 0x06000004
    assert cli_transform.map_token(0x70000005, tables, [(1, 3)]) == 0x70000007
    blob = bytearray(bytes([0x20, 0x01, 0x01, 0x12, 0x04]))  # one parameter, void, class of TypeDef 1
    cli_transform.transform_signature(blob, 0, len(blob), "method", tables)
    assert blob[4] == 3 << 2
