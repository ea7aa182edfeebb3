"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from symtransfer.functions import features
from symtransfer.operators.minhash import MinHash, seeds
from symtransfer.sources.mappings import field_descriptor, method_descriptor, strip_generics


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")


def test_opcode_categories(spark):
    want = {1: 0, 18: 0, 21: 0, 46: 0, 190: 0, 54: 1, 79: 1, 86: 1, 96: 2, 152: 2, 153: 3, 171: 3, 198: 3, 199: 3, 172: 4, 177: 4, 182: 5, 186: 5, 178: 6, 181: 6, 187: 7, 192: 7, 193: 7, 191: 8, 194: 9, 195: 9, 197: 9, 0: 10, 87: 10, 95: 10, 196: 10, 202: 10, 254: 10, 255: 10, 9999: 10, -1: 10}
    rows = spark.createDataFrame([(k,) for k in want], "op int").select("op", features.opcode_category(F.col("op")).alias("c")).collect()
    assert {r.op: r.c for r in rows} == want
    assert all(0 <= c < features.CATEGORIES for c in features.opcode_table())


def test_fingerprints(spark):
    fine = lambda ops, tags=None: value(spark, features.fine_fingerprint(ints(*ops), F.array(*[F.lit(t) for t in tags or [""] * len(ops)]).cast("array<string>")))
    coarse = lambda *ops: value(spark, features.category_histogram(ints(*ops)))
    assert fine([177]) == fine([177]) != 0
    assert fine([177]) != fine([3, 177]) and fine([18, 177], ["k1", ""]) != fine([18, 177], ["k5", ""])
    assert fine([]) == 0
    assert coarse(177) != coarse(3, 87, 177) and coarse(3, 177) == coarse(4, 177)
    assert coarse() == ",".join("0" * 11)


def test_hashes_of_outlines(spark):
    one = lambda *x: value(spark, features.profile_hash(*map(F.lit, x)))
    assert one(1, 2, 3, 4) == one(1, 2, 3, 4) != one(1, 2, 4, 3)
    assert [value(spark, features.fold32(F.lit(x).cast("long"))) for x in (0, 1, -1, 1 << 32)] == [0, 1, 0, 1]


@pytest.mark.parametrize(("a", "b", "want"), [(0, 0, 1.0), (1, 0, 0.0), (3, 1, 0.5), (-1, -1, 1.0), (-1, 1, 1 / 32)])
def test_flag_overlap(spark, a, b, want):
    assert value(spark, features.flag_overlap(F.lit(a), F.lit(b))) == want


def test_ratios_and_dice(spark):
    assert [value(spark, features.ratio(F.lit(a), F.lit(b))) for a, b in ((0, 0), (0, 2), (2, 4))] == [1.0, 0.0, 0.5]
    assert [value(spark, features.dice(F.lit(o), F.lit(a), F.lit(b))) for o, a, b in ((0, 0, 0), (1, 1, 3), (0, 1, 0))] == [1.0, 0.5, 0.0]
    refs = lambda s, *i: features.reference_set(F.lit(s).cast("string"), F.array(*[F.lit(x) for x in i]).cast("array<string>"))
    assert value(spark, refs("java/lang/Object", "own/A", "jdk/B", "jdk/B")) == ["S:java/lang/Object", "I:jdk/B"]
    assert value(spark, refs(None)) == []
    assert value(spark, features.set_dice(refs("own/A"), refs("own/B"))) == 0.5
    assert value(spark, features.set_dice(refs("java/A"), refs("own/B"))) == 0.0
    pairs = [(a, b, features.within_twice(F.lit(a), F.lit(b))) for a in range(9) for b in range(9)]
    assert all(value(spark, c) == (a <= 2 * b and b <= 2 * a) for a, b, c in pairs[::5])


def test_size_buckets_of_similar_sizes_are_neighbours(spark):
    b = {r.n: r.b for r in spark.range(40).select(F.col("id").alias("n"), features.size_bucket(F.col("id")).alias("b")).collect()}
    assert b[0] == -9 and b[1] == 0 and b[7] == 2 and b[8] == 3
    assert all(abs(b[x] - b[y]) <= 1 for x in range(1, 40) for y in range(1, 40) if min(x, y) * 2 >= max(x, y))


def test_texts(spark):
    assert value(spark, features.percent(F.lit(0.1234))) == "12.3%"
    assert value(spark, features.escape_name(F.lit("a\tb\\c\nd\r"))) == "a\\tb\\\\c\\nd\\r"
    for name in ("a\tb", "\\t", "x\\\\ny", "plain", "\r\n"):
        assert value(spark, features.unescape_name(features.escape_name(F.lit(name)))) == name
    shape = {"(I)V": True, "[I": True, "Lx;": True, "I": True, "V": True, "X": False, "II": False, "": False}
    assert {t: value(spark, features.looks_like_descriptor(F.lit(t))) for t in shape} == shape
    assert value(spark, features.status(F.lit(0.0), F.lit("a"), F.lit("a"))) == "Unmatched"
    assert value(spark, features.status(F.lit(0.5), F.lit("a"), F.lit("a"))) == "Identity"


def test_descriptors(spark):
    want = {"int": "I", "byte[]": "[B", "java.util.Map<java.lang.String,java.lang.Integer>[]": "[Ljava/util/Map;", "": "Ljava/lang/Object;", "a.B[] []": "[[La/B;", "void": "V"}
    assert {t: value(spark, field_descriptor(F.lit(t))) for t in want} == want
    method = lambda r, p, **k: value(spark, method_descriptor(F.lit(r), F.lit(p), **k))
    assert method("java.lang.String", "(int,byte[],java.util.Map)") == "(I[BLjava/util/Map;)Ljava/lang/String;"
    assert method("void", "()") == "()V"
    both = "(java.util.Map<a.B,c.D>,int,java.util.List<e.F>)"
    assert method("void", both) == "(Ljava/util/Map;)V"
    assert method("void", both, nested=True) == "(Ljava/util/Map;ILjava/util/List;)V"
    assert value(spark, strip_generics(F.lit("a<b"))) == "a"


def test_minhash(spark):
    assert seeds(4) == [753593889, -1434421939, -1278963638, -1133916350]
    for bad in ((0, 1), (8, 0), (8, 3)):
        with pytest.raises(ValueError):
            MinHash(*bad)
    lsh = MinHash(16, 4)
    elements = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "x"), ("c", "z")], "entity_id string, element string")
    sig = lsh.signatures(elements, spark.createDataFrame([(x,) for x in "abcde"], "entity_id string"))
    got = {r.entity_id: list(r.sig) for r in sig.collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"] == [0] * 16
    assert all(-(1 << 31) <= x < 1 << 31 for x in got["a"])
    bands = lsh.bands(sig)
    assert lsh.stats(bands).first().indexed == 20
    from symtransfer.operators.candidates import lsh_pairs

    pairs = {(r.u, r.t) for r in lsh_pairs(bands, bands).collect()}
    assert {("a", "b"), ("d", "e")} <= pairs and ("a", "d") not in pairs
