"""Near-duplicates of a table with repeated rows, nulls and copies against SQL; what its plan shuffles."""

import random

import duckdb

from symtransfer.plans.queries import SQL, page_dup_match


def test_pages_with_repeated_rows_and_nulls(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.sample(words, 40)) for _ in range(8)]
    rows = [(i, b) for i, b in enumerate(base)]
    rows += [(20 + i, b.replace("w1", "v1", 3)) for i, b in enumerate(base)] + [(40 + i, b + "\n" + b) for i, b in enumerate(base[:3])]
    # one page in two rows, equal words in other order, no words
    rows += [(50, base[0][:80]), (50, base[0][80:]), (51, " ".join(reversed(base[1].split()))), (52, None), (53, " \n"), (54, "é ü w1"), (55, "w1 ü é"), (None, base[0])]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = page_dup_match(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id IS NOT NULL")
    want = con.execute(f"SELECT u, t, shared, total FROM ({SQL['page_dup_match']})").fetchall()
    assert sorted(tuple(r) for r in got.select("u", "t", "shared", "total").collect()) == sorted(want) and len(want) > 8
    # words become hashes where they are read: no set of strings is shuffled
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list(h" in plan
