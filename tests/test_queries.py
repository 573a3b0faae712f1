"""Every registered query against its SQL, and its plan."""

import math

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

from assetloom import queries as Q

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(rs):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(str([cell(x) for x in r]) for r in rs)


#: Queries that open or parse files in tasks, which only Python can.
PARSED = {"m3_refresh_features", "m3_refresh_files", "m5_build_converted", "s12_file_hashes", "s13_read_ranges", "s13_wav_round_trip", "s16_read_map_faces"}


@pytest.fixture
def plans(monkeypatch):
    """The plans of everything that is written on the way."""
    seen = []
    for kind in ("parquet", "csv", "text"):

        def write(self, *args, _do=getattr(DataFrameWriter, kind), **kwargs):
            seen.append(self._df._jdf.queryExecution().executedPlan().toString())
            return _do(self, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, kind, write)
    return seen


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, con, name, plans):
    df = Q.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    got = df.select(*cols).collect()
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert name in PARSED or "Python" not in plan and "InArrow" not in plan
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({Q.SQL[name]})").fetchall()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["w1_keep_first", "w3_packed_offsets_two_level", "o1_alias_order", "a6_target_conflicts", "w13_resample_chunks", "m1_condition_chunks", "a10_uneven_windows", "j11_inside_points", "m2_envelope"])
def test_result_does_not_depend_on_partitions(spark, name):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, Q.QUERIES[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]


def test_entry_points_import_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/assetloom", tmp_path / "assetloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
