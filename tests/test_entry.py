import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_package():
    code = "import sys\nsys.modules['sunloom.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 60, q"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)


@pytest.mark.skipif(not SMALL.exists(), reason="no driver tables here")
def test_queries_match_sql(spark):
    import duckdb

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("horizon_metrics", "monthly_summary", "paired_compare", "metadata_override", "dup_keys", "array_variability"):
        want = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        got = entry.queries()[name](spark, str(SMALL)).select(*[f"`{c}`" for c in columns]).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall())), name
