"""Pairs of alike entities are computed once, dealt out evenly and written in tiles: the same rows, in small files."""

import random
from collections import Counter

import duckdb
import pytest

from symtransfer.operators.candidates import ratio_band_rows, ratio_band_tiles, untiled
from symtransfer.operators.scoring import SIGNALS, profiles
from symtransfer.plans.frontends import customers
from symtransfer.plans.queries import QUERIES, SQL

SF, COPIES = "/root/testdata/sf0.001", 60
COLUMNS = "entity_id long, n_methods long, n_fields long, place long, k array<long>"


def test_tiles_give_the_pairs_of_rows(spark):
    rng = random.Random(5)
    every = [(rng.randrange(60), n := rng.choice([0, 0, 1, 3, 4, 9]), rng.choice([n, 2 * n, 1]), rng.choice([None, 1, 1, 2]), rng.choice([[], [1], [1, 2]])) for _ in range(160)]
    left, right = (spark.createDataFrame(rows, COLUMNS) for rows in (every[:90], every[70:]))
    rows = lambda f, *a: f(left, right, ["place"], *a).selectExpr("u", "t", "size(array_intersect(l_k, r_k)) + l_n_methods AS x")
    want = Counter(map(tuple, rows(ratio_band_rows).collect()))
    assert max(want.values()) > 1
    for size in (1, 3, 128):
        assert Counter(map(tuple, untiled(rows(ratio_band_tiles, size)).collect())) == want
    assert untiled(rows(ratio_band_tiles).where("false")).collect() == []


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    d = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    n = con.execute(f"SELECT max(c_custkey) // 2 * 2 + 2 FROM '{SF}/customer.parquet'").fetchone()[0]
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        con.execute(f"COPY (SELECT * REPLACE ({key} + i * {n} AS {key}) FROM '{SF}/{name}.parquet', range({COPIES}) r(i)) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), con


#: queries with a row per pair
TILED = ["arity_ratio", "dice_fine_reference", "dice_multiset"]


@pytest.mark.parametrize("name", TILED)
def test_rows_of_copies_in_small_files(spark, copies, tmp_path, name):
    d, con = copies
    QUERIES[name](spark, d).write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE OR REPLACE VIEW got AS SELECT u, t, score_e6 FROM '{tmp_path}/out/*.parquet'")
    con.execute(f"CREATE OR REPLACE TABLE want AS SELECT u, t, score_e6 FROM ({SQL[name]})")
    rows = con.execute("SELECT count(*) FROM want").fetchone()[0]
    assert rows > 100_000 and con.execute("SELECT count(*) FROM got").fetchone()[0] == rows
    assert con.execute("SELECT count(*) FROM (FROM want EXCEPT ALL FROM got)").fetchone()[0] == 0
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < rows


@pytest.mark.parametrize("name", TILED)
def test_pairs_are_not_put_into_a_few_tasks(spark, name):
    lines = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x for x in lines) == 2


def test_profiles_of_one_signal(spark):
    side = customers(spark, SF)
    every = profiles(side.entity, side.member, ["nation"])
    for signal in SIGNALS:
        one = profiles(side.entity, side.member, ["nation"], [signal])
        of = lambda df: [c for c in df.columns if c[:2] in ("k_", "t_", "d_", "b_")]
        assert of(one) == [c for c in of(every) if c[2:].startswith(signal)]
        assert sorted(map(repr, one.collect())) == sorted(map(repr, every.select(one.columns).collect()))
