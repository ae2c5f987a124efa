"""The registered queries beside their SQL on the smallest tables, and that the library stands without the optional package."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from sievelight.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[expected.columns.index(c)]) for c in order) for r in expected.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(math.isclose(x, y, abs_tol=2e-5) if isinstance(x, float) and y is not None else x == y for x, y in zip(g, w)), (g, w)


def test_exact_duplicate_pairs_with_nulls_and_repeated_keys(spark, tmp_path):
    con = duckdb.connect()
    odd = "p_partkey % 150 AS p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS p_type, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS p_brand, CASE WHEN p_partkey % 11 > 0 THEN p_size END AS p_size"
    con.sql(f"copy (select * replace ({odd}) from '{SF}/part.parquet') to '{tmp_path}/part.parquet'")
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    expected = con.sql(catalogue.oracle_sql()["exact_duplicate_pairs"]).fetchall()
    got = catalogue.queries()["exact_duplicate_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r["a_id"], r["n"]) for r in got) == sorted(expected) and expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_library_stands_without_the_optional_package(tmp_path):
    for name in os.listdir(ROOT):
        if name in ("sievelight", "__spark_entry__.py"):
            (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "sievelight" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
