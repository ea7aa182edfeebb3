"""Pairs are scored where they are joined: the same results, and no shuffle of all pairs."""

import random

import pytest
from test_matching import side

from symtransfer.operators.candidates import ratio_band_pairs
from symtransfer.operators.scoring import profiles
from symtransfer.operators.select import best_match, best_pairs, meets
from symtransfer.plans.pipeline import best_of_similar_sizes, score
from symtransfer.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def collection(rng, prefix, n):
    out = {}
    for i in range(n):
        if i % 3 == 2:  # a copy of an earlier one
            out[f"{prefix}{i:02}"] = out[f"{prefix}{rng.randrange(i):02}"]
        else:
            member = lambda k: (k, "x", rng.choice(["1", "2", "3", None]), rng.randint(0, 3), rng.randint(0, 2))
            out[f"{prefix}{i:02}"] = [member("m") for _ in range(rng.choice([0, 1, 4, 5, 70]))] + [member("f") for _ in range(rng.randint(0, 3))]
    return out


def test_best_of_similar_sizes_against_all_pairs(spark):
    rng = random.Random(3)
    left, right = side(spark, collection(rng, "u", 24)), side(spark, collection(rng, "t", 24))
    scored = score(ratio_band_pairs(left.entity, right.entity), left, right)
    l, r = (profiles(s.entity, s.member) for s in (left, right))
    for threshold in (None, 0.7):
        want = best_match(scored if threshold is None else scored.where(meets(threshold)))
        got = best_of_similar_sizes(l, r, [], threshold)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


@pytest.fixture
def wide(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


#: queries whose pairs are shuffled nowhere
IN_PLACE = ["arity_ratio", "dice_multiset", "dice_fine_reference", "weighted_score"]
#: queries that bound a pair in the join
BOUNDED = ["customer_best_match", "near_dup_documents", "best_match_documents", "threshold_match", "page_dup_match", "label_transfer_exact", "match_summary", "priority_merge", "label_transfer_lsh"]


@pytest.mark.parametrize("name", IN_PLACE)
def test_no_pair_is_shuffled(wide, name):
    assert "hashpartitioning(u#" not in QUERIES[name](wide, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BOUNDED)
def test_pairs_are_bounded_where_they_meet(wide, name):
    plan = QUERIES[name](wide, SF)._jdf.queryExecution().executedPlan().toString()
    assert any("Join" in line and "bit_count" in line for line in plan.splitlines())


def test_best_pairs_by_hash_table(spark):
    """Exact where scores differ in their last bit, ties go to the smallest t of all longs, and no pair is sorted."""
    ends = [-(1 << 63), -1, 0, 5, (1 << 63) - 1]
    close = [1.0, 1.0 - 2**-53, 0.3, 0.3 + 2**-54, 2**-10, 0.0]
    rows = [(u, t, close[(u + k) % 3 + (u % 2) * 3]) for u in range(20) for k, t in enumerate(ends[u % 4 :] + [7 + u])]
    scored = spark.createDataFrame(rows, "u long, t long, score double").repartition(4)
    got = best_pairs(scored)
    assert {r.u: r.t for r in got.collect()} == {r.u: r.t for r in best_match(scored).collect()}
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


#: queries that hold one target of each entity while they score pairs
HELD = ["customer_best_match", "best_match_documents"]


@pytest.mark.parametrize("name", HELD)
def test_scored_pairs_are_not_sorted(wide, name):
    lines = QUERIES[name](wide, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k, line in enumerate(lines):
        if "SortMergeJoin" in line and "bit_count" in line:
            above = [lines[i] for i in range(k) if depth[i] < min(depth[i + 1 : k + 1])]
            assert "HashAggregate" in next(x for x in reversed(above) if "Sort [" in x or "Aggregate" in x)


#: queries that send sketches only to buckets where entities meet
MEETING = ["near_dup_documents"]


@pytest.mark.parametrize("name", MEETING)
def test_sketches_go_to_buckets_of_several_entities_only(wide, name):
    lines = QUERIES[name](wide, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("Filter" in line and "(low#" in line and "= high#" in line for line in lines)
