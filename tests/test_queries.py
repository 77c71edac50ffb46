"""Every query that has SQL, against DuckDB on the same tables; the others against brute force."""

import zlib

import pytest

import __spark_entry__ as entry
from tessera.kernels import rift
from tessera.plans import queries as own
from tests.conftest import SF, assert_same_as_sql, duckdb_rows, same_rows


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_against_sql(spark, name):
    assert_same_as_sql(own.queries()[name](spark, SF), own.oracle_sql()[name])


def test_queries_without_sql(spark):
    _, docs = duckdb_rows("SELECT doc_id, coalesce(text, '') FROM documents")
    got = own.queries()["q_crc32"](spark, SF).collect()
    same_rows([tuple(r) for r in got], [(d, zlib.crc32(t.encode()), zlib.crc32(t.encode()) ^ 0xFFFFFFFF) for d, t in docs])
    _, rows = duckdb_rows(own._MAP_A)
    wanted = [(u, s, t) for u in {r[0] for r in rows} for s, t in rift.inverse(sorted((s, t) for w, s, t in rows if w == u))]
    same_rows([tuple(r) for r in own.queries()["q_rift_inverse"](spark, SF).collect()], wanted)
    _, lines = duckdb_rows("SELECT o_custkey, l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
    by = {}
    for c, s, o, n, p in lines:
        by.setdefault(c, []).append((s, f'{{"l_orderkey":{o},"l_linenumber":{n},"l_partkey":{p}}}', p))
    wanted = [(c, s, t) for c, m in by.items() for s, t in rift.reduced([(s, t) for s, _, t in sorted(m)], True)]
    same_rows([tuple(r) for r in own.queries()["q_rift_vote"](spark, SF).collect()], wanted)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
