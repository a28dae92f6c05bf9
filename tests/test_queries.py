import os
from collections import Counter

import duckdb
import pytest

from appendlake import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    return Counter(tuple(None if pd.isna(v) else float(v) if isinstance(v, int | float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = con.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_greedy_rows(spark):
    got = Q.unique_greedy(spark, SF).orderBy("event_id").collect()
    a, b = [r.a for r in got], [r.b for r in got]
    assert len(set(a)) == len(a) and len(set(b)) == len(b) and got


def test_entry_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "appendlake", tmp_path / "appendlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mono_roundtrip' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
