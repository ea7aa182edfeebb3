"""similar_components loses no link between groups."""

import random

from symtransfer.llm.simhash import _may_be_similar, similar_components


def test_link_inside_a_crowd_that_shares_its_rare_shingles(spark):
    """A crowd whose texts share most shingles but are not similar, and pairs in it that are; draws that see nothing."""
    common = [f"c{i}" for i in range(60)]
    rows = []
    for k in range(40):
        own = [f"w{k}.{i}" for i in range(40)]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + own[:-3] + [f"z{k}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.keep_id for r in similar_components(docs, tables=1, sample=64).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


def test_long_sketches_keep_similar_pairs_and_spare_the_others_sets(spark):
    """Sets of many sizes: no pair at 0.8 or more goes, and hardly any other long one stays to be sent whole."""
    rng = random.Random(5)
    sets, pairs, want = [], [], set()
    for k, n in enumerate([1, 2, 5, 17, 64, 300, 1100, 4000] * 4):
        own = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
        near = own[: max(1, round(n * 0.82))] if k % 2 else [*own, *(rng.getrandbits(63) for _ in range(n // 5))]
        far = [*own[: n // 2], *(rng.getrandbits(63) for _ in range(n - n // 2))]
        sets += [(3 * k, own), (3 * k + 1, near), (3 * k + 2, far)]
        pairs += [(3 * k + 1, 3 * k), (3 * k + 2, 3 * k)]
        want |= {(a, b) for a, b, x in ((3 * k + 1, 3 * k, near), (3 * k + 2, 3 * k, far)) if len({*own} & {*x}) >= 0.8 * len({*own} | {*x})}
    frame = spark.createDataFrame(sets, "node long, shingles array<long>")
    got = {tuple(r) for r in _may_be_similar(spark.createDataFrame(pairs, "a long, b long"), frame, 0.8).collect()}
    assert got >= want and len(want) > 20
    assert not [p for p in got - want if len(sets[p[0]][1]) > 64]
