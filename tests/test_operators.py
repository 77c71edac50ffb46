import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.kernels import functions, register
from tessera.kernels import cases, containers, delta, pa19, rift
from tessera.operators import bytes_ops, chunks, images, jobs, matching, ordered, report, rifts
from tessera.operators.cases import matrix, suite
from tessera.sources.chunked import SolidSource
from tessera.sources.files import binary_files, read_jobs, read_results
from tests.conftest import same_rows
from tests.test_kernels import image, managed


def _maps(seed, n, keys=6):
    rng = random.Random(seed)
    return {k: sorted((s, rng.randrange(0, 400)) for s in rng.sample(range(0, 300), n)) for k in range(keys)}


def _frame(spark, maps):
    return spark.createDataFrame([(k, s, t) for k, m in maps.items() for s, t in m], "k int, source long, target long")


@pytest.mark.parametrize("rule", ["zero", "wrapping", "head"])
@pytest.mark.parametrize("width", [7, 1 << 16])
def test_lookups_as_the_kernel_has_them(spark, rule, width):
    maps = _maps(1, 9)
    probes = [(k, p) for k in range(7) for p in (*range(0, 320, 11), maps.get(k, [(3, 0)])[0][0])]
    found = rifts.lookup(spark.createDataFrame(probes, "k int, p long"), _frame(spark, maps), ["k"], "p", rule, width)
    f = {"zero": rift.offset_or_zero, "wrapping": rift.offset_wrapping, "head": lambda m, p: rift.OffsetTable(m).offset(p)}[rule]
    same_rows([tuple(r) for r in found.select("k", "p", "offset").collect()], [(k, p, f(maps.get(k, []), p)) for k, p in probes])


def test_sum_composition_collapse_and_reduction_as_the_kernels_have_them(spark):
    a, b = _maps(2, 6), _maps(3, 5)
    b.pop(0)
    fa, fb = _frame(spark, a), _frame(spark, b)
    got = [tuple(r) for r in rifts.total(fa, fb, ["k"]).collect()]
    same_rows(got, [(k, s, t) for k in a for s, t in rift.total(a[k], b.get(k, []))])
    got = [tuple(r) for r in rifts.compose(fa, fb, ["k"]).filter("k > 0").collect()]
    same_rows(got, [(k, s, t) for k in b for s, t in rift.compose(a[k], b[k]) if a[k][0][0] <= s < 1 << 62])
    votes = [(1, s, i, t) for i, (s, t) in enumerate([(1, 5), (1, 5), (1, 7), (2, 6), (3, 9), (3, None)])]
    got = rifts.reduced(spark.createDataFrame(votes, "k int, source long, ord int, target long"), ["k"], True).collect()
    same_rows([tuple(r)[1:] for r in got], rift.reduced([(s, rift.UNSET if t is None else t) for _, s, _, t in votes], True))
    got = rifts.inverse(fa.withColumn("ord", F.col("source")), ["k"]).collect()
    same_rows([tuple(r) for r in got], [(k, s, t) for k in a for s, t in rift.inverse(a[k])])


def test_vectors_and_updates(spark):
    vector = rifts.unset_vector(spark.createDataFrame([(1, 3), (2, 0)], "k int, n int"), ["k"], "n")
    done = rifts.set_entries(vector, spark.createDataFrame([(1, 2, 9), (1, 8, 9)], "k int, source long, target long"), ["k"])
    same_rows([tuple(r) for r in done.collect()], [(1, 0, None), (1, 1, None), (1, 2, 9)])


def test_as_of_and_numbering_with_nulls_and_ties(spark):
    probes = spark.createDataFrame([(None, 5), (1, 5), (1, None), (1, 2)], "k int, p long")
    breaks = spark.createDataFrame([(None, 4, 7), (1, 5, 1), (1, 5, 2), (1, None, 3)], "k int, s long, v long")
    same_rows([tuple(r) for r in ordered.as_of(probes, breaks, ["k"], "p", "s", "v", 3).collect()], [(None, 5, 7), (1, 5, 2), (1, None, None), (1, 2, None)])
    rows = spark.createDataFrame([(1, p) for p in (3, 9, 4, 30)] + [(None, 2)], "k int, p long")
    same_rows([tuple(r) for r in ordered.numbered(rows, ["k"], "p", width=4).collect()], [(1, 3, 1), (1, 4, 2), (1, 9, 3), (1, 30, 4), (None, 2, 1)])


def test_neighbours_across_buckets(spark):
    rows = spark.createDataFrame([(1, p, p * 10 if p != 9 else None) for p in (3, 9, 4, 30)] + [(None, 2, 5)], "k int, p long, v long")
    after = [tuple(r) for r in ordered.neighbour(rows, ["k"], "p", "v", "x", width=4).collect()]
    same_rows(after, [(1, 3, 30, 40), (1, 4, 40, None), (1, 9, None, 300), (1, 30, 300, None), (None, 2, 5, None)])
    before = [tuple(r) for r in ordered.neighbour(rows, ["k"], "p", "v", "x", False, 4).collect()]
    same_rows(before, [(1, 3, 30, None), (1, 4, 40, 30), (1, 9, None, 40), (1, 30, 300, None), (None, 2, 5, None)])


def test_matching(spark):
    source = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("a", 9)], "n string, r long")
    target = spark.createDataFrame([("b", 10), ("a", 11), ("a", 12), (None, 13)], "n string, r long")
    same_rows([tuple(r) for r in matching.fifo(source, target, ["n"], "r").collect()], [(1, 11), (2, 12), (3, 10)])
    same_rows([tuple(r) for r in matching.first_of_value(source, target, "n", "r").collect()], [(1, 11), (2, 11), (9, 11), (3, 10)])
    probes = spark.createDataFrame([(5,), (25,), (99,)], "p long")
    ranges = spark.createDataFrame([(0, 0, 30), (1, 20, 40)], "ord int, low long, high long")
    few = [(r.p, r.range and r.range.ord) for r in matching.containing(probes, ranges, "p", "low", "high", "ord").collect()]
    before, matching.BROADCAST_ROWS = matching.BROADCAST_ROWS, 0
    many = [(r.p, r.range and r.range.ord) for r in matching.containing(probes, ranges, "p", "low", "high", "ord").collect()]
    matching.BROADCAST_ROWS = before
    assert sorted(few, key=str) == sorted(many, key=str) == sorted([(5, 0), (25, 0), (99, None)], key=str)


def test_bytes_expressions(spark):
    old = b"PA19" + b"".join(v.to_bytes(4, "little") for v in (12, 1, 2, 3, 4, 15, 2)) + bytes(40)
    df = spark.createDataFrame([(old,), (b"DCM\x01PA30",), (b"<?xml <assembly",), (b"",)], "b binary")
    b = F.col("b")
    rows = df.select(bytes_ops.version(b), bytes_ops.is_dcm(b), bytes_ops.looks_like_manifest(b), bytes_ops.fill_offset(b), bytes_ops.crc_register(b)).collect()
    assert [r[0] for r in rows] == ["PA19", None, None, None] and [r[1] for r in rows] == [False, True, False, False] and rows[2][2] and rows[0][3] == 5
    header = pa19.parse(old)
    fields = bytes_ops.pa19_fields(b)
    got = df.limit(1).select(*(c.alias(n) for n, c in fields.items())).first().asDict()
    assert got == vars(header) | {"data_start": header.data_start()}
    assert spark.range(1).select(bytes_ops.crc_register(F.lit(b"123456789"))).first()[0] == 873187033


def test_jobs_and_sql_functions(spark):
    register(spark)
    rows = [(1, b"abc" * 40, b"abd" * 45), (2, b"", b""), (3, b"x", None)]
    made = jobs.create(spark.createDataFrame(rows, "id int, reference binary, target binary"), "PA31", "md5")
    both = jobs.apply_reverse(made.filter("delta is not null"))
    assert {r.id: bytes(r.result) for r in both.collect()} == {1: rows[0][2], 2: b""}
    assert [(r.id, r.version, r.target_size) for r in jobs.info(made.filter("id = 1").select("id", "delta")).collect()] == [(1, "PA31", 135)]
    tried = jobs.try_apply(spark.createDataFrame([(1, b"", b"nonsense bytes")], "id int, reference binary, delta binary")).first()
    assert tried.result is None and tried.error == "bad magic"
    made.createOrReplaceTempView("made")
    assert spark.sql("SELECT md5(delta_apply(reference, delta)) = md5(target) FROM made WHERE id = 1").first()[0]
    assert bytes(spark.sql("SELECT delta_signature(CAST('abc' AS BINARY), 32771)").first()[0]).hex() == "900150983cd24fb0d6963f7d28e17f72"


def test_report(spark):
    rows = [("PASS", None, None, None), ("FAIL", "0123456789abcdef", 7, None), ("EXC", None, None, 'call: "GetLastError=13"'), ("EXC", None, None, "Object reference not set"), ("EXC", None, None, "x" * 99), (None, None, None, None)]
    df = spark.createDataFrame([(i, "d", "dir", "cat", *r) for i, r in enumerate(rows)], "id int, dll string, direction string, category string, status string, got_sha string, got_len long, message string")
    found = report.classified(df)
    assert [(r.verdict, r.detail) for r in found.orderBy("id").collect()] == [
        ("pass", None), ("fail", "got 0123456789ab (7B)"), ("error", "GetLastError=13"), ("error", "null-output (empty target)"), ("error", "x" * 60), ("skipped", None),
    ]
    assert [tuple(r) for r in report.scores(found, ["dll", "direction"]).collect()] == [("d", "dir", 1, 5)]
    assert {r.signature: (r.failures, r.examples) for r in report.buckets(found, "id", "id").collect()}["dir|d|cat|ERROR GetLastError=13"] == (1, ["2"])


def test_shrinking_finds_a_short_failure(spark):
    data = spark.createDataFrame([(1, bytes(range(100)))], "k int, data binary")
    got = report.minimised(data, "k", "data", lambda c: c.filter(F.position(F.lit(b"\x05"), F.col("candidate")) > 0)).first()
    assert 5 in bytes(got.data) and len(got.data) < 20


def test_chunks_and_the_solid_source(spark, tmp_path):
    data = bytes(range(256)) * 40
    rows = spark.createDataFrame([(1, bytearray(containers.write_solid(data, 1000)))], "id long, resource binary")
    packed = chunks.solid_chunks(rows, "id", "resource")
    assert packed.count() == 11 and packed.agg(F.sum("plain")).first()[0] == len(data)
    path = tmp_path / "a.solid"
    path.write_bytes(containers.write_solid(data, 1000))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(SolidSource)
    read = spark.read.format("solid").option("path", str(path)).load()
    assert b"".join(bytes(r.plain) for r in read.orderBy("offset").collect()) == data
    part = read.filter("offset >= 3000 and offset < 5000")
    assert [r.number for r in part.orderBy("number").collect()] == [3, 4]


def test_image_tables(spark):
    df = spark.createDataFrame([(1, bytearray(image())), (2, bytearray(managed(["mod", "Alpha"]))), (3, bytearray(b"none"))], "image_id long, content binary")
    assert {(r.image_id, r.name) for r in images.sections(df).collect()} == {(1, ".text"), (1, ".data"), (2, ".text"), (2, ".data")}
    assert {r.image_id: r.managed for r in images.headers(df).collect()} == {1: False, 2: True}
    assert {(r.table_name, r.rid) for r in images.cells(df).collect()} >= {("TypeDef", 1), ("Module", 1), ("MethodDef", 2)}
    assert b"Alpha" in {bytes(r.value) for r in images.heap_values(df).collect()}
    assert images.relocations(df).count() == images.tokens(df).count() == images.bodies(df).count() == images.functions(df).count() == 0
    pairs = spark.createDataFrame([(1, bytearray(managed(["mod", "Alpha"])), bytearray(managed(["mod", "Beta", "Alpha"])))], "pair_id long, source binary, target binary")
    assert ("02", 1, 2) in {(r.space, r.source, r.target) for r in images.metadata_maps(pairs).collect()}


def test_suites_round_trip(spark):
    inputs = suite(spark, 11, 2, ("text", "fuzz_derived"))
    assert inputs.count() == 4 and matrix(inputs).count() == 20
    done = jobs.apply(jobs.create(inputs))
    assert done.filter("result <> target").count() == 0
    assert [(n, len(r), len(t)) for n, r, t in cases.text_pairs(11, 1)][0][0] == "text.0000"


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"xyz")
    assert [bytes(r.content) for r in binary_files(spark, str(tmp_path), "*.bin").collect()] == [b"xyz"]
    job = '{"schema_version": 1, "domain": "d", "seed": 18446744073709551615, "cases": [{"id": "a", "category": "c", "directions": ["ours_to_ours"]}]}'
    (tmp_path / "job.json").write_text("﻿" + job, encoding="utf-8")
    got = read_jobs(spark, str(tmp_path / "job.json")).first()
    assert (got.id, got.reference_sha256, int(got.seed)) == ("a", "", 2**64 - 1)
    result = '{"dll": "x", "domain": "d", "seed": 1, "results": [{"id": "a", "ours_to_native": {"status": "PASS", "got_sha": "00", "got_len": 1, "gold": "", "gold_len": 0, "message": ""}}]}'
    (tmp_path / "r.json").write_text(result)
    found = read_results(spark, str(tmp_path / "r.json"))
    assert found.count() == 5 and found.filter("status is not null").first().direction == "ours_to_native"


def test_streamed_jobs(spark, tmp_path):
    from tessera.streaming.jobs import applied, job_stream

    target = b"stream target " * 9
    rows = [("a", bytearray(b"ref"), bytearray(delta.create(b"ref", target))), ("b", bytearray(b""), bytearray(b"bad bytes here"))]
    spark.createDataFrame(rows, "id string, reference binary, delta binary").write.parquet(str(tmp_path / "in"))
    out = applied(job_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r.id: (r.result and bytes(r.result), r.error) for r in spark.table("streamed").collect()}
    assert got == {"a": (target, None), "b": (None, "bad magic")}




def test_ranges_by_cells_and_by_trying(spark, monkeypatch):
    """Wide, narrow, nested, empty and negative ranges: cells give what trying every range gives."""
    import random

    from tessera.operators import matching
    from tessera.operators.ordered import in_ranges

    rng = random.Random(5)
    spans = [(k, low, low + rng.choice([0, 1, 7, 1000, 10**12])) for k in range(300) for low in [rng.randrange(-5000, 5000)]]
    places = [(k, rng.randrange(-6000, 8000)) for k in range(500)] + [(500, None)]
    probes = spark.createDataFrame(places, "id long, at long")
    ranges = spark.createDataFrame(spans, "ord long, low long, high long")
    wanted = {(i, min((o for o, a, b in spans if x is not None and a <= x < b), default=None)) for i, x in places}
    assert {(r.id, r.range and r.range.ord) for r in matching.containing(probes, ranges, "at", "low", "high", "ord").collect()} == wanted
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 1000)
    assert {(r.id, r.range and r.range.ord) for r in matching.containing(probes, ranges, "at", "low", "high", "ord").collect()} == wanted
    pairs = in_ranges(probes.filter("at is not null"), ranges, [], "at", "low", "high").collect()
    assert sorted((r.id, r._r_ord) for r in pairs) == sorted((i, o) for i, x in places if x is not None for o, a, b in spans if a <= x < b)


def test_shared_grams_by_parts(spark, monkeypatch):
    from tessera.operators import matching

    docs = [(1, "abcdefgh abcdefgh"), (2, None), (3, "xxxxx"), (4, "zabcdé😀fgh")]
    items = [(10, "abcdefg"), (11, ""), (12, "é😀fgh"), (13, "xxxxxxxx")]
    grams = lambda t, n=4: {t[i : i + n] for i in range(len(t) - n + 1)}
    wanted = sorted((d, i, len(g)) for d, t in docs for i, u in items if (g := grams(t or "") & grams(u)))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in matching.shared_grams(left, right, 4).collect()) == wanted
    monkeypatch.setattr(matching, "GRAM_HASHES", 3)
    assert sorted(tuple(r) for r in matching.shared_grams(left, right, 4).collect()) == wanted


def test_image_operators_agree_with_the_kernels(spark):
    """Relocation blocks, coded indexes, and reduction by vote: expressions against the kernels, with unset entries."""
    import random

    from pyspark.sql import functions as F

    from tessera.kernels import cli_metadata, pe_transform, rift
    from tessera.operators import images, rifts

    rng = random.Random(2)
    entries = sorted((rng.randrange(20_000), 10) for _ in range(301))
    rewriter = pe_transform.Rewriter.__new__(pe_transform.Rewriter)
    rewriter.data = bytearray(4096)
    rewriter._write_blocks([(r, k, 0) for r, k in entries], 0, 4096)
    at, blocks = 0, []
    while size := int.from_bytes(rewriter.data[at + 4 : at + 8], "little"):
        words = [int.from_bytes(rewriter.data[at + o : at + o + 2], "little") for o in range(8, size, 2)]
        blocks.append((int.from_bytes(rewriter.data[at : at + 4], "little") // 4096, size, sum(words)))
        at += size
    found = images.relocation_pages(spark.createDataFrame(entries, "rva long, kind long"), []).collect()
    assert sorted((r.page, r.size, r.words) for r in found) == blocks
    raw = spark.range(200)
    tag, table, rid = images.coded_index(F.col("id"), "MemberRefParent")
    for r in raw.select("id", table.alias("t"), rid.alias("r")).collect():
        if r.t is not None:
            assert cli_metadata.coded_parts("MemberRefParent", r.id) == (r.t, r.r)
    rows = [(m, rng.randrange(6), k, rng.choice([None, 3, 3, 4, 9])) for m in range(40) for k in range(rng.randrange(1, 25))]
    table = spark.createDataFrame(rows, "m long, source long, ord long, target long")
    for drop in (True, False):
        wanted = []
        for m in range(40):
            own = [(s, rift.UNSET if t is None else t) for _, s, _, t in sorted(r for r in [(q[0], q[1], q[2], q[3]) for q in rows] if r[0] == m)]
            wanted += [(m, s, t) for s, t in rift.reduced(own, drop)]
        assert sorted(tuple(r) for r in rifts.reduced(table, ["m"], drop).collect()) == sorted(wanted)


def test_results_meet_their_cases(spark):
    from tessera.operators import report

    results = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("x", "pass")], "id string, verdict string")
    cases = spark.createDataFrame([("a", "text"), ("b", "random"), ("c", "text")], "id string, category string")
    assert sorted(tuple(r) for r in report.with_cases(results, cases).collect()) == [("a", "pass", "text"), ("b", "fail", "random")]


def test_generators_of_all_categories():
    from tessera.kernels import cases, delta, pe

    assert len(cases.GENERATORS) == 9
    for category, generator in cases.GENERATORS.items():
        if category == "corpus_replay":
            continue
        made = list(generator(5, 3))
        assert made == list(generator(5, 3)) and [n for n, *_ in made] == [f"{category}.{i:04}" for i in range(3)]
        for _, reference, target in made[:2]:
            if len(reference) < 3000:
                assert delta.apply(reference, delta.create(reference, target)) == target
    _, a, b = next(cases.image_pairs(5, 1))
    assert [s.name for s in pe.parse(a).sections] == [".text", ".data"] and pe.parse(a).machine == pe.AMD64
    assert delta.apply(a, delta.create(a, b, delta.Options(file_type="auto"))) == b
    assert pe.parse(next(cases.managed_pairs(5, 1))[1]).managed


def test_import_export_and_resource_tables(spark):
    """Directories laid into an image by hand; damaged ones end the tables and nothing else."""
    from tessera.kernels import cases, pe
    from tessera.operators import images

    word = lambda n, size=4: n.to_bytes(size, "little")

    def with_directory(kind, data, at=0x2000):
        out = bytearray(cases.small_image(b"\x90" * 16, data, 9, plus=False))
        place = 0x80 + 24 + 96 + 8 * kind
        out[place : place + 8] = word(at) + word(len(data))
        return bytes(out)

    imports = word(0x2030) + bytes(8) + word(0x2050) + word(0x2040) + bytes(20)
    imports = imports.ljust(0x30, b"\0") + word(0x2060) + word(0x80000007) + bytes(8) + bytes(16) + b"\0" * 0
    imports = imports.ljust(0x50, b"\0") + b"lib.dll\0".ljust(16, b"\0") + b"\0\0open\0"
    exports = (bytes(16) + word(5) + word(2) + word(1) + word(0x2030) + word(0x2040) + word(0x2044)).ljust(0x30, b"\0") + word(0x1000) + word(0x1008)
    exports = exports.ljust(0x40, b"\0") + word(0x2050) + word(1, 2) + bytes(10) + b"run\0"
    tree = lambda name, to: bytes(12) + word(0, 2) + word(1, 2) + word(name) + word(to)
    resources = tree(16, 0x80000018) + tree(3, 0x80000030) + tree(1033, 0x48) + word(0x2100) + word(77) + bytes(8)
    rows = [(1, with_directory(pe.IMPORT, imports)), (2, with_directory(pe.EXPORT, exports)), (3, with_directory(pe.RESOURCE, resources)), (4, with_directory(pe.IMPORT, b"\1" * 30, 0x7FFFFF00)), (5, b"MZ")]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "image_id long, content binary")
    assert {(r.dll, r.name, r.ordinal, r.rva) for r in images.imports(df).collect()} == {("lib.dll", "open", None, 0x2040), ("lib.dll", None, 7, 0x2044)}
    assert {tuple(r) for r in images.exports(df).collect()} == {(2, 5, None, 0x1000), (2, 6, "run", 0x1008)}
    assert [tuple(r) for r in images.resources(df).collect()] == [(3, "16/3/1033", 0x2100, 77)]
    moved = images.imports(df).withColumn("rva", F.col("rva") + 64)
    assert [tuple(r) for r in images.by_name(images.imports(df), moved, ["image_id"], ["dll", "name"]).collect()] == [(1, 0x2040, 0x2080)]
    cut = cases.small_image(b"", b"", 9)[: 0x80 + 24 + 60]
    assert pe.try_parse(cut) is None and pe.parse_lenient(cut).machine == pe.AMD64 and pe.parse_lenient(b"MZ") is None


def test_cli_suites_reports_and_files(spark, tmp_path):
    from tessera import cli
    from tessera.sources.files import cached_base, write_files

    go = lambda *a: cli.run(cli.parser().parse_args([str(x) for x in a]), spark)
    go("gen", 3, tmp_path / "suite", "--count", 2)
    names = {r.id for r in read_jobs(spark, str(tmp_path / "suite/job")).collect()}
    assert {"text.0001", "pe_pair.0000", "corpus.text"} <= names and len(list((tmp_path / "suite/files").iterdir())) > 10
    verdicts = [{"id": "text.0000", "ours_to_ours": {"status": "PASS"}}, {"id": "text.0001", "ours_to_ours": {"status": "EXC", "message": "bad"}}, {"id": "unknown", "ours_to_ours": {"status": "PASS"}}]
    (tmp_path / "results").mkdir()
    import json

    (tmp_path / "results/r.json").write_text(json.dumps({"dll": "x", "domain": "d", "seed": 3, "results": verdicts}))
    go("report", tmp_path / "results", tmp_path / "score", "--cases", tmp_path / "suite/job")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "score")).collect()] == [("x", "ours_to_ours", "text", 1, 2)]
    go("report", tmp_path / "results", tmp_path / "buckets", "--by", "buckets")
    assert spark.read.parquet(str(tmp_path / "buckets")).first().signature == "ours_to_ours|x||ERROR bad"
    rows = spark.createDataFrame([("a/b.bin", bytearray(b"xy")), ("c", None)], "path string, content binary")
    assert [(r.name, r.size) for r in write_files(rows, str(tmp_path / "out")).collect()] == [("b.bin", 2)] and (tmp_path / "out/b.bin").read_bytes() == b"xy"
    assert cached_base(spark, str(tmp_path / "cache"), b"base one") == cached_base(spark, str(tmp_path / "cache")) == b"base one"
    cached_base(spark, str(tmp_path / "cache"), b"base two")
    with pytest.raises(ValueError, match="several"):
        cached_base(spark, str(tmp_path / "cache"))
