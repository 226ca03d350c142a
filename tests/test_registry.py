"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables that hold a panel."""

import math
import os

import duckdb
import pytest

from tallyfold.plans import extended, registry
from tallyfold.plans.context import Lab

SF = os.environ.get("TALLYFOLD_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = [
    "panel_weekly", "panel_gap_islands", "quality", "returns_monthly_simple", "corr_summary", "describe_freq", "ljung_box",
    "bt_trades_cost", "run_metrics", "asset_effect", "concentration_table",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    return float(v) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v


def key(row):
    return [f"{x:.5g}" if isinstance(x, float) else str(x) for x in row]


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    theirs = sorted((tuple(norm(r[k]) for k in at) for r in rel.fetchall()), key=key)
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs):
        assert all(math.isclose(x, y, abs_tol=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_every_query_has_a_name_of_its_own():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


#: Queries whose fits take long before their columns are known.
SLOW = ("variance_profiles", "variance_profiles_gjr", "residual_ljung_box")


@pytest.fixture(scope="module")
def shared_labs():
    """One Lab for all queries of the same panel, so that its tables are written once."""
    labs = {}

    def lab(spark, sf_dir, freq="weekly", level="nation", schedule=extended.SCHEDULE, days=None):
        return labs.setdefault((freq, level, schedule), Lab(spark, sf_dir, freq, level, schedule))

    with pytest.MonkeyPatch.context() as m:
        m.setattr(registry, "Lab", lab)
        m.setattr(extended, "Lab", lab)
        yield


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - set(SLOW)))
def test_columns_are_those_of_the_sql(spark, con, shared_labs, name):
    theirs = sorted(d[0] for d in con.execute(f"DESCRIBE {registry.ORACLE_SQL[name]}").fetchall())
    assert sorted(registry.QUERIES[name](spark, SF).columns) == theirs


def test_package_is_packed_for_a_cluster(tmp_path):
    """What executors are sent imports without the repository."""
    import subprocess
    import sys

    import __spark_entry__

    path = __spark_entry__.packed(str(tmp_path))
    found = subprocess.run([sys.executable, "-c", "import tallyfold.operators.carry as c; print(c.__file__)"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, check=True)
    assert found.stdout.startswith(path)
