"""The training-data queries that SQL can express, against DuckDB."""

import glob
from pathlib import Path

import duckdb
import pytest

from symtransfer.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
