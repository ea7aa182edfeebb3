"""Both removal operators against brute force, and suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest

from symtransfer.llm import sais
from symtransfer.llm.sais import concat, permuted_lcp, suffix_array
from symtransfer.llm.substring_dedup import SuffixAutomaton, remove_shared_windows
from symtransfer.llm.suffix_dedup import remove_shared_bytes

SCHEMA = "doc_id long, text string, kept string, g int, id int"


@pytest.mark.parametrize("small", [1 << 15, 3])
def test_suffix_array_and_common_prefixes(monkeypatch, small):
    """With reduced texts sorted by doubling, and by recursion down to three names."""
    monkeypatch.setattr(sais, "SMALL", small)
    rng = random.Random(3)
    for t in range(300):
        letters = bytes(range(97, 97 + rng.choice([1, 2, 3, 20])))
        strings = [bytes(rng.choices(letters, k=rng.randint(1, rng.choice([3, 20, 60])))) for _ in range(rng.randint(1, 8))]
        if t % 9 == 0:
            strings.append(bytes([255, 0, 255, 255]))
        symbols = [c for k, s in enumerate(strings) for c in [*(1000 + x for x in s), k]]
        text, _ = concat(strings)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        common = permuted_lcp(text, order)
        for a, b in zip(order[1:], order, strict=False):
            n = 0
            while max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
                n += 1
            assert common[a] == n


def test_suffix_automaton_owners():
    rng = random.Random(5)
    for _ in range(200):
        sequences = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(5)]
        owners = sorted(rng.randint(0, 4) for _ in sequences)
        auto = SuffixAutomaton()
        for k, s in enumerate(sequences):
            want = [min((o for t, o in zip(sequences[:k], owners, strict=False) if any(t[j : j + 3] == s[i : i + 3] for j in range(len(t) - 2))), default=None) for i in range(len(s) - 2)]
            assert auto.owners_of_windows(s, 3) == want
            auto.add(s, owners[k])


def thue_morse(n):
    """A word of n letters and its complement, which polynomial hashes modulo a power of two can't tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("sizes", [{}, {"group_mb": 0.002}])
def test_segments_with_equal_hashes_are_told_apart(spark, sizes):
    x, y = thue_morse(4096)
    twelve = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{twelve} {x}"), (2, f"{twelve} {y}"), (3, f"{twelve} {y}"), (4, y), (5, x), (6, f"{x} {y}")]
    for width, split, remove in ((13, lambda t: t.encode().split(), remove_shared_windows), (5000, lambda t: list(t.encode()), remove_shared_bytes)):
        got = remove(frame(spark, rows), width=width, **sizes).collect()
        want = brute(rows, width, split)
        assert sorted((r.doc_id, sum(s.stop - s.start for s in r.spans)) for r in got) == [(i, n) for (i, _), (_, n, _, _) in zip(rows, want, strict=True)]


def test_rows_without_identifiers_are_dealt_evenly(spark):
    """A third of all rows may repeat one identifier, or have none: results stay, and no group gets them all."""
    from symtransfer.llm.common import NO_ID, id_and_text

    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(rng.choice([None, None, 7, i]), f"{passage} " * rng.randint(0, 1) + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(400)]
    got = remove_shared_windows(frame(spark, rows), group_mb=0.015, chunk=1000).collect()
    want = brute(rows, 13, lambda t: t.encode().split())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept.encode()) for r in got) == sorted((i is None, i or 0, b" ".join(k)) for (i, _), (k, _, _, _) in zip(rows, want, strict=True))
    dealt = id_and_text(frame(spark, rows)).where(f"id = {NO_ID}").selectExpr("pmod(xxhash64(id, text), 8) AS g")
    groups = {r.g for r in dealt.collect()}
    assert len(groups) == 8


def test_sizes_grow_with_the_root_of_the_input():
    from symtransfer.llm.shared_spans import Windows, sizes_for

    win = Windows(50, 20)
    for size in (10**8, 10**10, 10**12, 10**14):
        groups, buckets, shards = sizes_for(size, win)
        assert size / groups <= 257e6 and 0.4 * size / shards <= 65e6 and buckets >= 1
        assert size / (groups * shards) >= 100 or groups == shards == 1 or size < 10**13
    assert sizes_for(0, win) == (1, 1, 1)


def brute(rows, width, split):
    """rows: (id, text). Kept symbols, removed count and runs by row."""
    seqs = [(10**19 if i is None else i, split(t or "")) for i, t in rows]
    owner = {}
    for i, s in seqs:
        for p in range(len(s) - width + 1):
            key = tuple(s[p : p + width])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for p in range(len(s) - width + 1):
            if owner[tuple(s[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append(([x for x, g in zip(s, gone, strict=True) if not g], sum(gone), runs, len(s)))
    return out


def texts(seed, n, alphabet, shared, sep):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(1, 6)))
    passages = [sep.join(word() for _ in range(rng.randint(12, 40))) for _ in range(shared)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([word() + " " + word(), p, p[cut:], p[: len(p) - cut]]))
        rows.append((i * 3 % 101, sep.join(parts)))
    rows += [(None, passages[0]), (500, None), (501, ""), (502, " \n\t "), (7, passages[0]), (7, passages[0]), (503, "a" * 400), (504, "a" * 60), (505, "é日本語" * 30), (506, "x" + "é日本語" * 30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 1, 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{}, {"group_mb": 0.002, "bucket_anchors": 200, "shard_mb": 0.001, "chunk": 300}])
def test_bytes_against_brute_force(spark, sizes):
    for seed, alphabet in ((1, "abcdefgh"), (2, "ab"), (3, "é日ab")):
        rows = texts(seed, 60, alphabet, 6, " ")
        want = brute(rows, 50, lambda t: list(t.encode()))
        got = remove_shared_bytes(frame(spark, rows), **sizes).collect()
        have = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept), sum(s.stop - s.start for s in r.spans), len(r.spans), r.n_bytes) for r in got)
        assert have == sorted((i is None, i or 0, bytes(k), n, s, size) for (i, _), (k, n, s, size) in zip(rows, want, strict=True))


@pytest.mark.parametrize("sizes", [{}, {"group_mb": 0.002, "bucket_anchors": 200, "shard_mb": 0.001, "chunk": 300}])
def test_words_against_brute_force(spark, sizes):
    for seed, alphabet, sep in ((1, "abcdefgh", "  "), (2, "ab", "\n"), (3, "é日ab", "\t ")):
        rows = texts(seed, 60, alphabet, 6, sep)
        want = brute(rows, 13, lambda t: t.encode().split())
        got = remove_shared_windows(frame(spark, rows), **sizes).collect()
        have = sorted((r.doc_id is None, r.doc_id or 0, r.kept.encode(), sum(s.stop - s.start for s in r.spans), len(r.spans), r.n_words) for r in got)
        assert have == sorted((i is None, i or 0, b" ".join(k), n, s, size) for (i, _), (k, n, s, size) in zip(rows, want, strict=True))


def test_empty_table(spark):
    none = frame(spark, [])
    assert remove_shared_bytes(none).count() == 0
    assert remove_shared_windows(none).count() == 0


def test_queries_match_brute_force_on_documents(spark):
    from symtransfer.llm.substring_dedup import op10_suffix_automaton_dedup
    from symtransfer.llm.suffix_dedup import op6_suffix_array_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, size, n, s, sha(bytes(k))) for (i, _), (k, n, s, size) in zip(rows, brute(rows, 50, lambda t: list(t.encode())), strict=True)}
    assert {tuple(r) for r in op6_suffix_array_dedup(spark, sf).collect()} == want
    want = {(i, size, n, sha(b" ".join(k))) for (i, _), (k, n, s, size) in zip(rows, brute(rows, 13, lambda t: t.encode().split()), strict=True)}
    assert {tuple(r) for r in op10_suffix_automaton_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("top", [90, 255])
def test_long_common_prefixes_of_narrow_and_wide_symbols(top):
    """Prefixes beyond 255 symbols, with eight and with four symbols to an integer; suffixes that are told apart are not sorted again."""
    rng = random.Random(5)
    shared = bytes(rng.choices([88, 89, top], k=700))
    strings = [shared, b"Z" + shared[:300], shared[5:] + b"Y", b"X" * 300]
    symbols = [c for k, s in enumerate(strings) for c in [*(1000 + x for x in s), k]]
    text, _ = concat(strings)
    packed, bits = sais._packed(text)
    assert bits == (8 if top < 255 else 16)
    order = suffix_array(text, (packed, bits))
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = permuted_lcp(text, order, (packed, bits))
    for a, b in zip(order[1:], order, strict=False):
        n = 0
        while symbols[a + n] == symbols[b + n]:
            n += 1
        assert common[a] == n
    names = np.array([3, 1, 2, 1, 2, 1, 2, 4, 1, 2, 0])
    sizes = []
    argsort = np.argsort
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or argsort(x, *a, **k))
        order = sais._by_doubling(names)
    assert order.tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())
    assert sizes[:2] == [11, 6]
