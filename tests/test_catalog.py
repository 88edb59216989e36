"""Every query with an oracle against DuckDB on the smallest tables; the others must give a stable schema and rows."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from terravox import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted(repr(tuple(value(v) for v in row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["qid", "neighbours", "density", "outlier"] and df.count() == 500


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, also):
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "*.pyc", *also))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "copy")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_oracle(spark, tables, name):
    got, want = entry_module.queries()[name](spark, DATA).toPandas(), tables.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_rows(spark, name):
    assert entry_module.queries()[name](spark, DATA).count() > 0


def test_brush_of_points_far_out(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings AS SELECT i AS vec_id, [i * 0.1 - 0.3, 0.01, 0.02]::FLOAT[] AS embedding, 0 AS label FROM range(10) t(i)")
    c.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    got, want = catalog.QUERIES["brush_select"](spark, str(tmp_path)).toPandas(), c.execute(catalog.ORACLES["brush_select"]).df()
    assert plain(got) == plain(want) and got["selected"].isna().sum() > 0


def test_queries_read_whole_tables(spark):
    e = catalog.E(spark, DATA)
    rows, labels = e.count(), e.select("label").distinct().count()
    count = lambda name: catalog.QUERIES[name](spark, DATA).count()
    assert count("strike_dip") == count("hillshade") == count("radial_lanczos") == count("raster_color") == count("primitive_distances") == rows
    assert count("plane_intersections") == labels * (labels - 1) // 2
    assert count("plane_line_points") == labels * rows
    assert count("plane_points") > 0
    assert not any(f in sql for sql in catalog.ORACLES.values() for f in ("WHERE id <", "WHERE id %", "WHERE a.id %", "WHERE x = 10"))


def test_training_data_oracles(spark, tables):
    registry = pytest.importorskip("terravox.llm.registry")
    for name, sql in registry.ORACLES.items():
        got, want = entry_module.queries()[name](spark, DATA).toPandas(), tables.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want), name
