"""The driver's contract: names, SQL, and that the engine stands without its optional parts."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from eventlake.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "conversations", "orders", "lineitem", "documents"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 134


def test_sql_is_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        order = [rel.columns.index(c) for c in cols]
        assert rows == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


ENGINE = "import __spark_entry__ as e, eventlake.streaming.backup; assert set(e.queries()) == set(e.plans.QUERIES) and set(e.oracle_sql()) == set(e.plans.SQL)"


@pytest.fixture(scope="module")
def without(tmp_path_factory):
    """The repository without its optional parts."""
    root, to = entry.__file__.rsplit("/", 1)[0], tmp_path_factory.mktemp("repo") / "r"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    return to


def _runs(code, at):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=at, env=env).returncode == 0


def test_engine_stands_without_its_optional_parts(without):
    assert _runs(ENGINE, without)
    (without / "eventlake" / "llm" / "__pycache__").mkdir(parents=True)  # a folder that was left over
    assert _runs(ENGINE, without)


def test_engine_stands_without_a_dependency_of_the_optional_parts():
    root = entry.__file__.rsplit("/", 1)[0]
    assert _runs("import sys; sys.modules['public_tokenizers'] = None; " + ENGINE, root)
    assert _runs("import sys; sys.modules['eventlake.llm'] = None; import eventlake.plans.queries, eventlake.streaming.export, eventlake.streaming.backup, eventlake.sources.segments", root)
