"""Every query against its SQL in another engine, and the shape of the package."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

from estatelens.queries import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = lambda x: f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(shown(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(want.columns, want.fetchall())


def test_nothing_else_imports_the_training_data_part():
    for folder, _, files in os.walk(os.path.join(ROOT, "estatelens")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not re.search(r"estatelens\.llm|corpus_pipeline", text.read())


def test_entry_point_stands_without_it(tmp_path):
    os.symlink(os.path.join(ROOT, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    os.makedirs(tmp_path / "estatelens")
    for x in os.listdir(os.path.join(ROOT, "estatelens")):
        if x != "llm":
            os.symlink(os.path.join(ROOT, "estatelens", x), tmp_path / "estatelens" / x)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], out.stderr
