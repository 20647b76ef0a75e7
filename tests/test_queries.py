"""Every registered query with SQL against DuckDB on the small tables, and the anchors on the next size."""

import glob
import math
import os

import duckdb
import pytest

from cartaspark.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata"


def connection(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    cursor = connection("sf0.001").execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name, n", [("tile_cover", 3893), ("affected_tiles", 294), ("sheets_to_pull", 57), ("missing_sheets", 1), ("bounds_diff", 858), ("bounds_upsert", 1970), ("between_multiples", 3772), ("nearest_corner_candidate", 150)])
def test_known_row_counts(spark, name, n):
    assert QUERIES[name](spark, f"{DATA}/sf0.01").count() == n


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_kernel_queries_run(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_opening_sets_known_pixels(spark):
    assert QUERIES["opening"](spark, f"{DATA}/sf0.01").where("m = 1").count() == 6403


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["sheet_file"] and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """One join for the difference of snapshots, no nested loop for boxes, pruned scans."""
    plan = QUERIES["bounds_diff"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("SortMergeJoin") + physical.count("ShuffledHashJoin") + physical.count("BroadcastHashJoin") == 1
    words = QUERIES["ocr_char_word_semijoin"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in words and "Cartesian" not in words
    cover = QUERIES["tile_cover"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "c_comment" not in cover.split("== Physical Plan ==")[1]


def test_library_does_not_import_the_corpus_operators():
    import subprocess
    import sys

    code = """
import importlib, pathlib, sys
root = pathlib.Path(sys.argv[1])
for f in sorted(root.glob("cartaspark/**/*.py")):
    parts = f.relative_to(root).with_suffix("").parts
    if parts[1] != "llm":
        importlib.import_module(".".join(p for p in parts if p != "__init__"))
assert not [m for m in sys.modules if m.startswith("cartaspark.llm")]
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code, root], check=True)
