"""Every registered query with a SQL twin, against DuckDB on the same tables."""

import math
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from plumbline.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


def canonical(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (str, bool)):
        return x
    try:
        return round(float(x), 6) + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(canonical(v) for v in r) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without a SQL form, and the test that checks their results.
ELSEWHERE = {
    "kriging_surface": "test_edges.test_kriging_surface_equals_brute_force",
    "quality_surface": "test_edges.test_kriging_surface_equals_brute_force; its last step is the query surface_regions",
    "sample_priorities": "test_edges.test_sample_priorities_follow_the_distribution",
    "train_forest": "test_edges.test_models_learn_and_stop",
    "train_boosted": "test_edges.test_models_learn_and_stop",
    "score_fix_rate": "test_edges.test_models_learn_and_stop",
}


def test_every_query_is_checked():
    assert set(ROWS_ONLY) == set(ELSEWHERE)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql(spark, sf, name):
    rows = registry.QUERIES[name](spark, sf).toPandas()
    assert len(rows) and not rows.isna().any().any()
    for column, low, high in (("predicted", 0, 100), ("sampled", 0, 1), ("blended", 0, 1), ("importance", 0, 1), ("variance", 0, math.inf)):
        if column in rows and name != "kriging_surface" or column == "variance" and column in rows:
            assert rows[column].between(low, high).all()
    if "importance" in rows:
        assert abs(rows["importance"].sum() - 1) < 1e-3


def test_entry_without_the_training_data_package(tmp_path):
    """A copy of the repository without that package still offers every other query."""
    root = pathlib.Path(__file__).resolve().parent.parent
    for name in ("plumbline", "__spark_entry__.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)},
                          capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-2:] == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))], said.stderr
