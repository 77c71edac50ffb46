"""Queries with SQL against DuckDB, and the pipeline stage by stage on a small fixture."""

import pytest

from tests.conftest import SF, assert_same_as_sql

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm import queries as llm  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_against_sql(spark, name):
    assert_same_as_sql(llm.queries()[name](spark, SF), llm.oracle_sql()[name])


def test_one_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in llm.queries())
    assert names == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]


def test_stages_follow_their_operators(spark, tmp_path):
    """Each stage keeps what a brute-force version of its operator keeps of its own input."""
    from tests.llm.test_operators import _shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        kept = {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":
            best = {}
            for r in before:
                key = "".join(r.text.split())
                best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
            assert kept == {d for _, d in best.values()}
        if name == "simhash_near_dedup":
            own = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.encode().lower().split()] for i in range(max(1, len(w) - 4))} for r in before}
            gone = set(own) - kept
            like = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b])
            assert all(any(like(d, k) >= 0.8 for k in own if k != d) for d in gone)
            assert not [1 for a in kept for b in kept if a < b and like(a, b) >= 0.8]
        if name == "decontamination":
            found = {r.doc_id for r in before if any(s and len(s & _shingles(r.text)) >= 0.8 * len(s) for s in items)}
            assert kept == {r.doc_id for r in before} - found
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [d for d, q in labels.items() if q == 1 and d in {r.doc_id for r in before}]
            assert sum(d in kept for d in good) >= 0.95 * len(good)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == kept


def test_dedup_keeps_one_row_of_groups_without_ids_of_their_own(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    near = " ".join(words[:100] + ["other"] + words[101:])
    rows = [(7, "same text here"), (7, "same  text here"), (None, "no id"), (None, "no id"), (8, " ".join(words)), (8, near), (None, "alone"), (9, "more"), (9, "less")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    exact.write.parquet(str(tmp_path / "exact"))
    exact = spark.read.parquet(str(tmp_path / "exact"))
    wanted = [(7, "same  text here"), (None, "no id"), (8, " ".join(words)), (8, near), (None, "alone"), (9, "more"), (9, "less")]
    assert sorted((str(r.doc_id), r.text) for r in exact.collect()) == sorted((str(d), t) for d, t in wanted)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, exact, SF).collect()]
    assert len(got) == 6 and sum(d == 8 for d, _ in got) == 1
    again = [r.text for r in corpus_pipeline.near_stage(spark, docs.filter("doc_id is null"), SF).collect()]
    assert sorted(again) == ["alone", "no id"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_keep_columns_whatever_they_are_called(spark):
    """Columns that clash with names that the stages use, empty tables, null texts and repeated rows."""
    rows = [(1, "a b c", "x", "k1", "i"), (1, "a b c", "x", "k1", "i"), (2, None, "y", "k2", "i"), (3, "", "y", "k3", "i"), (4, "d " * 5000, "y", "k4", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string, kept string, `id.x` string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = sorted(r.doc_id for r in out.collect())
        assert found == ([1, 2, 4] if "dedup" in name else [1, 1, 2, 3, 4]), name
        assert {r.row_key for r in out.collect()} <= {"x", "y"}
