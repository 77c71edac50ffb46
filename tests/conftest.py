import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(found, wanted):
    """Two lists of tuples have the same rows, in any order; floats to nine digits."""
    plain = lambda rows: sorted((tuple(repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r) for r in rows))
    assert plain(found) == plain(wanted)


def duckdb_rows(sql, sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    relation = con.sql(sql)
    return relation.columns, relation.fetchall()


def assert_same_as_sql(df, sql, sf_dir=SF):
    columns, wanted = duckdb_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    same_rows([tuple(r) for r in df.select(*columns).collect()], wanted)
