"""Scoring, selection, transfer and merging on small collections."""

import random

import pytest
from pyspark.sql import functions as F

from symtransfer.config import TransferConfig
from symtransfer.operators import merge
from symtransfer.operators.candidates import ratio_band_pairs, with_fallback
from symtransfer.operators.lookup import map_class, map_member
from symtransfer.operators.select import best_match, meets, with_unmatched
from symtransfer.operators.transfer import transfer_fields, transfer_methods
from symtransfer.plans.frontends import Side, with_sizes
from symtransfer.plans.pipeline import match_exact, match_lsh, score, transfer

MEMBER = "entity_id string, kind string, ord long, name string, desc string, access int, fine long, coarse string, init_tag int"


def side(spark, classes: dict[str, list[tuple]], refs=("S:java/lang/Object",)) -> Side:
    """classes: name -> (kind, name, desc, fine, coarse)."""
    rows = [(c, k, i, n, d, 1, f, str(g), 0) for c, ms in classes.items() for i, (k, n, d, f, g) in enumerate(ms)]
    member = spark.createDataFrame(rows, MEMBER)
    entity = spark.createDataFrame([(c, i, 1, list(refs)) for i, c in enumerate(classes)], "entity_id string, ord int, flags int, refs array<string>")
    return Side(with_sizes(entity, member), member)


def pairs(spark, *ps):
    return spark.createDataFrame(list(ps), "u string, t string")


FOO = [("m", "a", "()V", 0x1111, 0x2222), ("m", "b", "()I", 0x3333, 0x4444)]


def test_self_match_is_one(spark):
    s = side(spark, {"Foo": FOO})
    row = score(pairs(spark, ("Foo", "Foo")), s, s).first()
    assert row.score == pytest.approx(1.0) and (row.matched_methods, row.total_methods) == (2, 2)


def test_unrelated_scores_what_the_formula_gives(spark):
    a, b = side(spark, {"A": [("m", "a", "()V", 0xAAAA, 0xBBBB)]}), side(spark, {"B": [("m", "a", "()V", 0xCCCC, 0xDDDD)]})
    assert score(pairs(spark, ("A", "B")), a, b).first().score == pytest.approx(0.55)
    best = match_exact(a, b)
    assert best.where(meets(0.7)).count() == 0
    left = with_unmatched(best, a.entity, 0.7).first()
    assert (left.t, left.score, left.total_methods, left.matched) == ("A", 0.0, 1, False)


def test_sizes_reject_the_big_one(spark):
    big = [("m", x, f"({x})V", i, i) for i, x in enumerate("abcde")]
    left, right = side(spark, {"Foo": FOO[:1]}), side(spark, {"Foo": FOO[:1], "Big": big})
    for best in (match_exact(left, right), match_lsh(left, right)):
        rows = best.collect()
        assert [(r.u, r.t) for r in rows] == [("Foo", "Foo")] and rows[0].score > 0.9


def test_repeated_fine_keys(spark):
    twice = [("m", "a", "()V", 7, 1), ("m", "b", "()V", 7, 1)]
    s = side(spark, {"T": twice})
    config = TransferConfig()
    both = pairs(spark, ("T", "T"))
    assert score(both, s, s).first().score == 1.0  # clamped
    multiset = TransferConfig(parity=type(config.parity)(dice_mode="multiset"))
    assert score(both, s, s, multiset).first().score == pytest.approx(1.0)
    with pytest.raises(ValueError):
        score(both, s, s, TransferConfig(parity=type(config.parity)(dice_mode="x")))


def test_ratio_band_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 20), rng.randint(0, 6)) for i in range(80)]
    df = spark.createDataFrame(rows, "entity_id long, n_methods long, n_fields long")
    close = lambda a, b: min(a, b) * 2 >= max(a, b)
    want = sorted((a[0], b[0]) for a in rows for b in rows if close(a[1], b[1]) and close(a[2], b[2]))
    got = ratio_band_pairs(df, df)
    assert sorted((r.u, r.t) for r in got.collect()) == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    some = spark.createDataFrame([(rows[0][0], 5)], "u long, t long")
    fell = {r.u for r in with_fallback(some, df, df).collect()}
    assert fell == {a for a, _ in want} and with_fallback(some, df, df).where(F.col("u") == rows[0][0]).count() == 1


def test_ties_go_to_the_first_target(spark):
    scored = spark.createDataFrame([("u", "z", 0.5), ("u", "a", 0.5), ("u", "m", 0.4)], "u string, t string, score double")
    assert best_match(scored).first().t == "a"
    order = spark.createDataFrame([("z", 0), ("a", 1), ("m", 2)], "t string, ord int")
    assert best_match(scored, order).first().t == "z"


def test_lookup(spark):
    members = spark.createDataFrame([("c", "f", "a", "I", "exact"), ("c", "f", "b", "I", "one"), ("c", "f", "x", "I", "x1"), ("c", "f", "x", "J", "x2")], "from_class string, kind string, from_name string, desc string, to_name string")
    asked = spark.createDataFrame([("c", "f", "a", "I"), ("c", "f", "b", "Z"), ("c", "f", "x", "Z"), ("c", "f", "x", "J"), ("d", "f", "a", "I"), ("c", "m", "a", "I")], "owner string, kind string, name string, desc string")
    got = {(r.owner, r.kind, r.name, r.desc): r.mapped for r in map_member(asked, members).collect()}
    assert list(got.values()).count("a") == 2
    assert got["c", "f", "a", "I"] == "exact" and got["c", "f", "b", "Z"] == "one" and got["c", "f", "x", "Z"] == "x" and got["c", "f", "x", "J"] == "x2"
    classes = spark.createDataFrame([("aaa", "Foo")], "from_name string, to_name string")
    assert {r.mapped for r in map_class(spark.createDataFrame([("aaa",), ("b",)], "name string"), classes).collect()} == {"Foo", "b"}


def test_method_transfer_takes_the_last_name(spark):
    left = spark.createDataFrame([("u", 0, "x", "()V", 1), ("u", 1, "y", "()V", 2)], "entity_id string, ord long, name string, desc string, fine long")
    right = spark.createDataFrame([("t", 0, "p", "()V", 1, "first"), ("t", 1, "q", "()V", 1, "last"), ("t", 2, "r", "()I", 2, "no")], "entity_id string, ord long, name string, desc string, fine long, to_name string")
    got = {r.name: r.to_name for r in transfer_methods(pairs(spark, ("u", "t")), left, right).collect()}
    assert got == {"x": "last", "y": "y"}


def greedy(fields, queue):
    queue, out = list(queue), {}
    for o, name, access, tag in fields:
        best = next((c for c in queue if access and c[2] == access and c[3] == tag), None) or next((c for c in queue if access and c[2] == access), None) or (queue[0] if queue else None)
        if best:
            queue.remove(best)
        out[o] = best[1] if best else name
    return out


def test_field_assignment_against_simulation(spark):
    rng = random.Random(4)
    left, right, want = [], [], {}
    for k in range(120):
        fs = [(i, f"f{i}", rng.randint(0, 2), rng.randint(0, 1)) for i in range(rng.randint(1, 5))]
        qs = [(i, f"q{i}", rng.randint(0, 2), rng.randint(0, 1)) for i in range(rng.randint(0, 5))]
        left += [(f"u{k}", o, n, "I", a, t) for o, n, a, t in fs]
        right += [(f"t{k}", o, n, "I", a, t) for o, n, a, t in qs]
        want |= {(f"u{k}", o): n for o, n in greedy(fs, qs).items()}
    l = spark.createDataFrame(left, "entity_id string, ord long, name string, desc string, access int, init_tag int")  # noqa: E741
    r = spark.createDataFrame(right, "entity_id string, ord long, to_name string, desc string, access int, init_tag int")
    got = transfer_fields(pairs(spark, *[(f"u{k}", f"t{k}") for k in range(120)]), l, r)
    assert {(x.u, x.ord): x.to_name for x in got.collect()} == want


def test_merge(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, at int, v string")
    assert {tuple(r) for r in merge.last_wins(rows, ["k"], "at", "first").collect()} == {("a", 1, "z"), ("b", 2, "y")}
    ids = spark.createDataFrame([(x,) for x in "abcd"], "entity_id string")
    hit = spark.createDataFrame([("a", "A")], "entity_id string, name string")
    given = spark.createDataFrame([("a", "no"), ("b", " p.B "), ("c", "  "), ("d", None)], "entity_id string, name string")
    got = {r.entity_id: (r.to_name, r.source) for r in merge.named(ids, hit, given).collect()}
    assert got == {"a": ("A", "match"), "b": ("p/B", "override"), "c": ("c", "identity"), "d": ("d", "identity")}


def test_transfer_with_overrides(spark):
    right = side(spark, {"t1": FOO, "t2": [("m", "a", "(J)V", 5, 6)] * 1, "unnamed": FOO})
    left = side(spark, {"u1": [("m", "q", "()V", 0x1111, 0x2222), ("m", "r", "()I", 0x3333, 0x4444)], "u2": [("m", "z", "(D)D", 50, 60)]})
    classes = spark.createDataFrame([("t1", "real/One", False, 0), ("t2", "real/Two", False, 1)], "from_name string, to_name string, identity boolean, ord long")
    members = spark.createDataFrame([("t1", "m", "a", "()V", "run", 0)], "from_class string, kind string, from_name string, desc string, to_name string, ord long")
    overrides = spark.createDataFrame([("u2", "by.Hand")], "entity_id string, name string")
    got = transfer(left, right, classes, members, overrides)
    assert {(r.from_name, r.to_name, r.identity) for r in got.classes.collect()} == {("u1", "real/One", False), ("u2", "by/Hand", False)}
    assert {(r.from_name, r.to_name) for r in got.members.collect()} == {("q", "run"), ("r", "b")}


def test_config():
    with pytest.raises(ValueError):
        TransferConfig().validate()
    with pytest.raises(ValueError):
        TransferConfig("a.zip", "m", "b.jar", "o").validate()
    with pytest.raises(ValueError):
        TransferConfig("a.jar", "m", "b.jar", "o", threshold=1.5).validate()
    assert TransferConfig("a.jar", "m", "b.jar", "o").validate().threshold == 0.7
