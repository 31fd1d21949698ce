import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracles import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = ["gap_sessions", "rle_runs", "minute_resample_centered", "interval_point_join", "awake_periods", "savgol_5_3", "ks_two_sample",
         "location_quantiles", "split_scan_best", "switching_path", "sleep_development", "knn_impute"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    rel = con.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_entry_without_the_text_operators(tmp_path):
    """The entry imports where the text package is absent, with the pipeline's file and without it."""
    root = os.path.dirname(os.path.abspath(contract.__file__))
    shutil.copytree(f"{root}/pulsegrid", tmp_path / "pulsegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.queries()) - set(e.QUERIES)), any(k.startswith(('op1', 'pipeline')) for k in e.queries()))"
    for gone in ("", "corpus_pipeline.py"):
        if gone and (tmp_path / gone).exists():
            (tmp_path / gone).unlink()
        out = subprocess.run([sys.executable, "-B", "-c", say], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert int(out.stdout.split()[0]) > 150 and out.stdout.split()[2] == "False"
