"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from vocabmill import queries as own

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = own.queries()[name](spark, D)
    columns = sorted(df.columns)
    result = duck.execute(own.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
def test_concept_details_with_large_supplier_keys(spark, tmp_path):
    """a supplier's key may be a drug's code (1191 is aspirin), which the SQL doesn't ask for."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{D}/part.parquet') TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_suppkey + 1190 AS l_suppkey) FROM '{D}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert con.execute("SELECT count(*) FROM lineitem WHERE l_suppkey = 1191").fetchall()[0][0]
    want = sorted(con.execute(f"SELECT system, code, term, display FROM ({own.oracle_sql()['con06_concept_details']})").fetchall())
    got = own.queries()["con06_concept_details"](spark, str(tmp_path)).select("system", "code", "term", "display").collect()
    assert sorted(map(tuple, got)) == want


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
