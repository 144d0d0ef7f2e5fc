"""Registered queries against their DuckDB texts, on the smallest folder."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(("op", "pipeline"))])
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    relation = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    assert plain(got.select(*columns).collect()) == plain(relation.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
