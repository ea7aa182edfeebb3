"""The corpus pipeline, stage by stage, against a brute-force version."""

import random
import subprocess
import sys

import corpus_pipeline
from test_shared_spans import thue_morse
from test_text_operators import measured

from symtransfer.llm import bpe, pii, quality
from symtransfer.llm.simhash import similar_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(rows, similarity=0.8):
    """Smallest identifier reachable, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (own, _) in enumerate(rows):
        least[find(i)] = min(own, least.get(find(i), own))
    return {own: least[find(i)] for i, (own, _) in enumerate(rows)}


def edited(text, rng, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def planted(spark):
    rng = random.Random(12)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = [t for _, t in rows if len(t.split()) > 120][:20]
    at = 10_000
    for t in long:
        for n in (0, 1, 2, 4, 60):
            rows.append((at, edited(t, rng, n)))
            at += 1
    rows += [(at, "  " + long[0] + "\n"), (at + 1, None), (at + 2, ""), (at + 3, "word " * 90), (at + 4, long[1] + " mail me.now@mail7.example.com or +1 (301) 555-0101")]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = planted(spark)
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), df.columns
    stage = dict(corpus_pipeline.STAGES)
    rules = quality.Rules()
    docs = stage["quality_rules"](spark, docs, str(tmp_path))
    assert docs.columns == columns
    got = {r.doc_id: r.text for r in docs.collect()}
    short = [(i, t) for i, t in rows if t is None or len(t.split()) < 400]
    assert {i for i, t in short if i in got} == {i for i, t in short if measured(t, rules)[-1]}

    exact = stage["exact_dedup"](spark, docs, str(tmp_path))
    assert exact.columns == columns
    best = {}
    for i, t in got.items():
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, i)), (-len(t), i))
    kept = {i for _, i in best.values()}
    assert sorted(r.doc_id for r in exact.collect()) == sorted(kept)

    near = stage["near_dedup"](spark, exact, str(tmp_path))
    assert near.columns == columns
    left = sorted((i, got[i]) for i in kept)
    want = groups(left)
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(left) - 15

    private = stage["pii_surrogates"](spark, near, str(tmp_path))
    assert private.columns == columns
    texts = {r.doc_id: r.text for r in private.collect()}
    assert set(texts) == set(want.values())
    for i, t in texts.items():
        found = pii.entities(got[i])
        assert (t == got[i]) == (not found)
        assert not any(got[i][a:b] in t for a, b, k, _ in found if not k.startswith("first_"))

    packed = stage["packing"](spark, private, str(tmp_path)).collect()
    enc = bpe.ByWord(bpe.tokenizer_path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(enc.encode(t)) // 4 + 1 for t in texts.values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cut = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert cut(whole) == cut(packed)


def test_similar_groups_of_a_crowd(spark):
    """Many near copies of one text, a common passage in others, texts without words and repeated rows."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(300))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, edited(base, rng, rng.choice([1, 2, 3]))) for i in range(60)]
    rows += [(100 + i, passage + " " + " ".join(f"x{rng.randint(0, 9999)}" for _ in range(80))) for i in range(40)]
    rows += [(200, ""), (201, " \n"), (202, "one two"), (203, "One Two"), (204, "one three")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.id: r.keep_id for r in similar_components(df).collect()}
    want = {i: k for i, k in groups(rows).items()}
    assert {i: got.get(i, i) for i in want} == want
    assert similar_components(df.where("false")).count() == 0


def test_near_copies_within_a_template_family(spark):
    """Pages that share most of their text meet in the same buckets; only the near copies among them are similar."""
    rng = random.Random(5)
    template = " ".join(f"t{i}" for i in range(160))
    own = lambda: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(24))
    rows = [(i, f"{template} {own()}") for i in range(500)]
    rows += [(1000 + i, edited(rows[i * 10 + 4][1], rng, 3)) for i in range(50)]
    rng.shuffle(rows)
    want = groups(rows)
    assert sum(i != k for i, k in want.items()) >= 40
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.id: r.keep_id for r in similar_components(df).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_recall_against_exact_similarity(spark):
    """Over all documents: of the pairs at 0.8 or more, by tenth of similarity above, how many are in one group."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: shingles(t or "") for i, t in rows}
    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    shared = {}
    for ids in having.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    similar = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.id: r.keep_id for r in similar_components(df).collect()}
    found = {}
    for (a, b), s in similar.items():
        if s >= 0.8:
            found.setdefault(min(int(s * 10), 9), []).append(got.get(a, a) == got.get(b, b))
    assert sum(map(len, found.values())) > 20
    assert all(sum(x) >= 0.9 * len(x) for x in found.values()), {k: (sum(x), len(x)) for k, x in found.items()}
    # nothing is in a group that no chain of similar pairs joins
    links = {}
    for (a, b), s in similar.items():
        if s >= 0.8:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert set(got) <= set(links)


def test_words_with_equal_hashes_are_not_similar(spark):
    x, y = thue_morse(4096)
    five = [f"w{i}" for i in range(5)]
    rows = [(1, f"{x} {' '.join(five)}"), (2, f"{y} {' '.join(five)}"), (3, f"{x} {' '.join(five)}.")]
    rows = [(i, t + " " + " ".join([x if i == 1 else y] * 20)) for i, t in rows]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    want = groups(rows)
    got = {r.id: r.keep_id for r in similar_components(df).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_edge_rows_and_empty_tables_through_all_stages(spark, tmp_path):
    """Nulls in any column, equal identifiers, repeated rows, very long words, and no rows at all."""
    long = "x" * 300_000 + " " + " ".join(f"w{i}" for i in range(400))
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "s", 0), (1, long, "en", None, 5), (1, long, "en", None, 5), (2, long.replace("w7 ", "v7 "), "en", "s", None), (None, "\x00 \n", "", "", 1)]
    for name, given in (("some", rows), ("none", [])):
        spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} == ({1} if given else set())


def test_workers_give_memory_back():
    """Freed arrays below an array that stays: without giving_back the heap keeps all of it."""
    code = """
import sys
import numpy as np
import pyarrow as pa
from symtransfer.llm.common import giving_back

stays = []

def run(batches):
    for batch in batches:
        some = [np.ones(10_000) for _ in range(2000)]  # 80 kB each, so on the heap
        stays.extend(some[99::100])
        del some
        yield batch

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

before = mb()
run = giving_back(run) if sys.argv[1] == "yes" else run
assert sum(b.num_rows for b in run(iter([pa.record_batch({"a": [1, 2]})]))) == 2
print(mb() - before)
"""
    kept = {x: float(subprocess.run([sys.executable, "-c", code, x], check=True, capture_output=True, text=True).stdout) for x in ("no", "yes")}
    assert kept["no"] > 100 and kept["yes"] < kept["no"] / 2
