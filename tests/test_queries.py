"""Every query with SQL gives the SQL's rows on the smallest tables; without the llm folder the rest still works."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


# One of each family here; the driver compares all of them.
CHOSEN = ["a5_fetch_lagged_features", "b9_sample_key", "c3_split_by_row_ratio", "c14_systematic_sample", "d1_basic_stats", "e8_quality_report", "f3_drift_profile", "g5_redundancy", "h21_sequence_structure", "i12_feature_metrics_by_split", "j6_decile_table", "j8_segment_metrics", "k4_level_by_period", "l8_auuc_report", "m7_aligned_leaderboard", "x3_label_monitor"]


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = [tuple(norm(r[i]) for i in at) for r in result.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


def test_entry_without_llm(tmp_path):
    root = Path(__file__).parent.parent
    for p in root.iterdir():
        if p.name not in ("corpus_pipeline.py", "plumbline", ".git"):
            os.symlink(p, tmp_path / p.name)
    (tmp_path / "plumbline").mkdir()
    for p in (root / "plumbline").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "plumbline" / p.name)
    code = "import __spark_entry__ as e; assert 'e8_quality_report' in e.queries() and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries(); print('fine')"
    made = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert "fine" in made.stdout, made.stderr
