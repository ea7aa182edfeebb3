"""The operators on whole texts against brute force, the library, round trips and planted cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtransfer.llm import bpe, exact_dedup, packing, pii, quality, simhash
from symtransfer.llm.license_scan import SENTENCES, license_scan
from test_shared_spans import thue_morse

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, "a b c"), (2, "  a\tb\nc "), (3, None), (4, ""), (5, " \n\x0b\x0c\r\t"), (6, "abc"), (None, "a b c"), (1, "a b c"), (7, "é日本 é日本"),
    (8, "x" * 30_000), (9, "word " * 4000), (10, "a\x00b"), (11, "a b"), (12, "line one\nline one\n\nline two\nline one"), (None, None),
]
SCHEMA = "doc_id long, text string, id int, piece string, fp string, kept string, n_words string"


def frame(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, 5, None, "x", "y", None) for i, t in rows], SCHEMA)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def split(t):
    return (t or "").encode().split()


def longest_repeats(words, least):
    """By brute force: the longest repeat of `least` words or more from each place."""
    n = len(words)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


def measured(text, rules):
    t = text or ""
    words = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    covered, gone = set(), set()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            gone.update(range(i, i + 3))
    sizes = longest_repeats(words, 3)
    for i, k in enumerate(sizes):
        if k >= rules.repeat_from:
            covered.update(range(i, i + k))
    n = len(words)
    base = n < 50 or 100 * len(gone) > 50 * n
    longest = max(sizes, default=0)
    kept = not base and len(covered) <= rules.most_covered * n and not (longest >= rules.longest_from and longest > rules.longest_share * n)
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(gone), longest, len(covered), base, kept)


def test_quality_against_brute_force(spark):
    rng = random.Random(2)
    rows = [r for r in EDGE if len(r[1] or "") < 3000]
    for i in range(60):
        vocabulary = ["aa", "b#", "é", "日", "d|"][: rng.randint(1, 5)] + [f"w{k}" for k in range(rng.choice([0, 3, 40]))]
        words = rng.choices(vocabulary, k=rng.randint(0, 150))
        if rng.random() < 0.5:
            words += words[-rng.randint(1, 70) :]
        rows.append((100 + i, "".join(w + rng.choice([" ", "\n", "\t "]) for w in words)))
    rules = quality.Rules()
    got = quality.quality(frame(spark, rows), rules).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_covered", "base_failed", "kept"]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=key) == sorted(((i, *measured(t, rules)) for i, t in rows), key=key)


def test_quality_tells_words_and_lines_with_equal_hashes_apart(spark):
    x, y = thue_morse(4096)
    rows = [(1, f"{x}\n{y}\n{x}"), (2, f"A {x} {y} B {x} {y}"), (3, f"A {x} B {y} A {y} B {x}"), (4, f"{x} {x} {y} {y} " * 3)]
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words, r.longest_repeat) for r in quality.quality(frame(spark, rows)).collect()}
    want = {i: [measured(t, quality.Rules())[k] for k in (3, 4, 5)] for i, t in rows}
    assert got == {i: tuple(w) for i, w in want.items()}


def test_intervals_of_common_prefixes():
    """Against all repeats by brute force: each suffix's innermost maximal interval, and which intervals there are."""
    rng = random.Random(4)
    for _ in range(200):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0] * len(order)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            while text[a + common[k]] == text[b + common[k]]:
                common[k] += 1
        least = rng.randint(1, 3)
        depth = quality.innermost(np.array(text), np.array(order), np.array(common), least)
        where = {}
        for i in range(len(text)):
            for j in range(i + least, len(text)):
                where.setdefault(tuple(text[i:j]), []).append(i)
        maximal = {w: p for w, p in where.items() if len(p) > 1 and len({text[i - 1] if i else -1 for i in p}) > 1 and len({text[i + len(w)] if i + len(w) < len(text) else -2 for i in p}) > 1}
        want = [max((len(w) for w, p in maximal.items() if i in p), default=0) for i in range(len(text))]
        assert depth.tolist() == want


def test_quality_rejects_long_repeats_and_keeps_prose(spark):
    rng = random.Random(4)
    prose = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    block = [f"v{i}" for i in range(120)]
    rows = [(1, " ".join(prose)), (2, " ".join(block + prose[:40] + block)), (3, " ".join(prose + block[:20] + prose[200:230]))]
    got = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_chunks_do_not_change_measures():
    rows = [b"a b c a b c\na b c a b c", b"", b"x y z " * 50, "é ü ".encode() * 9]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    buf = np.frombuffer(b"".join(rows), np.uint8)
    whole = quality.measures(buf, ends, quality.Rules())
    for k, r in enumerate(rows):
        one = quality.measures(np.frombuffer(r, np.uint8), np.array([0, len(r)]), quality.Rules())
        assert [c[k] for c in whole] == [c[0] for c in one]


def hard_texts():
    rng = random.Random(1)
    alphabet = "ab é日\n\t  '’1२ \u0085\x1c!?#Σσßİi̇éS<|endoftext|>"
    out = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)]
    out += ["a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "é" * 3000, "ab" * 5000, "   " * 2000, "!?" * 3000, "x" * 100_000, "\n" * 2000, "ΑΣ ΑΣ. ΣΑ", "don't we'll I'M"]
    return out + ["".join(rng.choices("abcdehilnorst", k=rng.randint(500, 6000))) for _ in range(20)]


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*EDGE, *((1000 + i, t) for i, t in enumerate(hard_texts())), *documents(spark)]
    encoded = bpe.bpe_encode(frame(spark, rows), path)
    got = bpe.with_ids_sha256(bpe.bpe_decode(encoded, path)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), library.decode(ids, skip_special_tokens=False)))
        assert want[-1][3] == (t or "")
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_encode(frame(spark, []), path).count() == 0


def test_tree_join_grows_until_both_sides_agree():
    enc = bpe.ByteLevel(bpe.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    for _ in range(60):
        data = bytes(rng.choices(rng.choice([b"ab", b"aeinorst", b"!?-=", "éèñ".encode()]), k=rng.randint(50, 900)))
        assert bpe.tree_encode(enc._tokens, data, most=rng.randint(4, 40)) == enc._tokens(data)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*EDGE, *((1000 + i, t) for i, t in enumerate(hard_texts())), *documents(spark)]
    got = packing.packed_documents(frame(spark, rows), path, keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), 2048):
            cut = ids[p : p + 2048].tobytes()
            want.append((i, p // 2048, p, len(cut) // 4, zlib.crc32(cut), cut))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(places) <= least * 1.02 + 2
    assert packing.packed_documents(frame(spark, []), path).count() == 0


def test_sum_of_squares_choice():
    """Each place has the smallest sum of squared counts that any open sequence with room would have given."""
    rng = random.Random(8)
    lengths = np.array([rng.randint(1, 12) for _ in range(120)])
    number, offset = packing.pack(lengths, 12)
    gaps, made = {}, set()
    for i in np.argsort(-lengths, kind="stable"):
        n, b = int(lengths[i]), int(number[i])

        def total(bin_, gap):
            after = {**gaps, bin_: gap - n}
            counts = np.bincount([g for g in after.values() if g], minlength=13)
            return int((counts**2).sum())

        choices = [total(k, g) for k, g in gaps.items() if g >= n] or [total("new", 12)]
        assert total(b, gaps.get(b, 12)) == min(choices)
        assert offset[i] == 12 - gaps.get(b, 12)
        gaps[b] = gaps.get(b, 12) - n
        made.add(b)
    assert sorted(made) == list(range(len(made)))


def test_exact_duplicates(spark):
    rows = [*EDGE, *documents(spark)]
    groups = {}
    for i, t in rows:
        key = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(t or ""), 10**19 if i is None else i))
    want = []
    for i, t in rows:
        key = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        own = min(groups[key])[1]
        own = None if own == 10**19 else own
        want.append((i, own, len(groups[key]), i == own, hashlib.sha256(key.encode()).hexdigest()))
    for memory in (96.0, 0.01):
        got = exact_dedup.exact_duplicates(frame(spark, rows), memory_mb=memory).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, bool(r.kept), r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1 << 40, 6000, 900])
def test_trie_spills_by_subtree(limit):
    rng = random.Random(limit)
    trie, want = exact_dedup.PatriciaTrie(limit), {}
    for i in range(900):
        key = bytes(rng.choices(b"ab", k=rng.randint(0, 9))) * rng.choice([1, 1, 8])
        value = (-rng.randint(0, 3), rng.randint(0, 50), 1, b"d")
        want[key] = exact_dedup.merge(want[key], value) if key in want else value
        trie.insert(key, value)
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


def brute_print(text, n=3):
    import xxhash

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (id, fingerprint); the smallest identifier reachable by links of at most two bits."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, f in prints:
        least[find(f)] = min(least.get(find(f), 10**19), 10**19 if i is None else i)
    return [(i, f"{f:016x}", None if least[find(f)] == 10**19 else least[find(f)]) for i, f in prints]


def test_simhash_against_brute_force(spark):
    rng = random.Random(6)
    rows = [r for r in EDGE if len(r[1] or "") < 3000] + documents(spark)
    base = [f"w{i}" for i in range(2000)]
    for i in range(60):
        words = list(base)
        words[rng.randrange(2000)] = "changed"
        rows.append((5000 - i, " ".join(words)))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_of_crowded_and_chained_fingerprints(spark):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = {centre} | {centre ^ 1 << i for i in range(64)} | {centre ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    chain = rng.getrandbits(64)
    for k in range(30):
        values.add(chain)
        chain ^= 1 << (2 * k) % 64 | 1 << (2 * k + 1) % 64
    values |= {0, (1 << 64) - 1, 1 << 63} | {rng.getrandbits(64) for _ in range(300)}
    prints = list(enumerate(sorted(values, key=lambda v: v * 7919 % 104729)))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in prints], "fp long")
    found = simhash.components(simhash.links(df)).collect()
    root = {r.node % (1 << 64): r.root for r in found}
    groups, want = {}, {}
    for i, v in prints:
        groups.setdefault(root.get(v, v - (1 << 64) if v >> 63 else v), set()).add(i)
    for i, _, c in brute_components(prints):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_crowded_cells_respect_the_distance(distance):
    centre = 0x0123456789ABCDEF
    crowd = [centre ^ 1 << i ^ 1 << j for i in range(16) for j in range(i)] + [centre ^ 1 << i for i in range(0, 16, 5)]
    fp = np.array(sorted(crowd), np.uint64)
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = {frozenset((i, j)) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= distance}
    for i, j in simhash.links_in(np.zeros(len(fp), np.int64), fp, distance):
        assert frozenset((i, j)) in want or distance == 2
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(j) for i, j in want)
    if distance < 2:
        assert len({find(i) for i in range(len(fp))}) == len(fp) - len(want) + (0 if distance == 0 else len(want) - sum(find(i) != i for i in range(len(fp))))


def test_which_of_tied_rows_stays_is_fixed(spark):
    rows = [(5, "a b"), (5, "a\tb"), (5, "a\nb"), (6, "ab"), (None, "x y"), (None, "x\ty")]
    orders = [sorted(rows, key=lambda r: random.Random(k).random() + hash(r[1]) % (k + 2)) for k in range(4)]
    kept = {tuple(sorted(((r.doc_id, r.text) for r in exact_dedup.keep_one(frame(spark, o).repartition(k + 1)).collect()), key=repr)) for k, o in enumerate(orders)}
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_packing_deals_rows_without_identifiers(spark):
    """One identifier, or none, for all rows: they are dealt into groups by their content too, and each is placed once."""
    rows = [(None, f"text number {i} " * (i % 40)) for i in range(400)] + [(7, f"other {i}") for i in range(200)]
    got = packing.packed_documents(frame(spark, rows), bpe.tokenizer_path("word_bpe_49k.json"), per_group=60).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id >> 36] = sizes.get(r.sequence_id >> 36, 0) + 1
    assert len(got) == 600 and len(sizes) == 10 and max(sizes.values()) < 200


def test_a_cluster_needs_a_shared_folder():
    from symtransfer.llm.common import shared_folder

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(type("Session", (), {"sparkContext": Context}))


def test_licences(spark):
    mit = " ".join(SENTENCES[s] for s in ("mit-grant", "mit-notice", "as-is"))
    rows = [
        (1, f"Some prose.\n{mit}\nMore prose."), (2, "Hello there.\nReleased under the MIT License.\nBye."), (3, None), (4, ""), (5, "licensed UNDER the apache license, version 2.0"),
        (6, SENTENCES["mit-grant"]), (7, SENTENCES["bsd-redistribution"] + "\n" + SENTENCES["bsd-no-endorsement"]), (8, "License. The licence is fine. " * 3000), (2, "Licensed under CC BY-NC 4.0. Released under the MIT License."),
    ]
    got = sorted((r.doc_id, r.licences) for r in license_scan(frame(spark, rows)).collect())
    assert got == [(1, ["MIT"]), (2, ["CC-BY-NC-4.0", "MIT"]), (2, ["MIT"]), (3, []), (4, []), (5, ["Apache-2.0"]), (6, []), (7, ["BSD-3-Clause"]), (8, [])]
    span = next(r.spans for r in license_scan(frame(spark, rows)).collect() if r.doc_id == 1)[0]
    assert rows[0][1][span.start : span.stop].startswith("Permission is hereby") and rows[0][1][: span.stop].endswith("NONINFRINGEMENT")
    assert license_scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("licence, names", [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]), ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]), ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope"]), ("AGPL-3.0-or-later", ["agpl-redistribute", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]), ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement"]), ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]), ("Apache-2.0", ["apache2-may-not-use", "apache2-copy-at"]), ("MPL-2.0", ["mpl2-subject"]), ("Unlicense", ["unlicense-public"]), ("Zlib", ["zlib-grant"]), ("BSL-1.0", ["boost-grant"]),
])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_and_commented_licences(licence, names, mark):
    import textwrap

    from symtransfer.llm.license_scan import RULES, Recogniser

    recogniser = Recogniser(SENTENCES, RULES)
    for width in (40, 72):
        body = "\n".join(mark + x for x in textwrap.wrap(" ".join(SENTENCES[n] for n in names), width, break_long_words=False, break_on_hyphens=False))
        text = f"some title\n{mark}\n{body}\nint main() {{ return 0; }}"
        found = recogniser.licences(recogniser.sentences(text))
        assert [x for x, _, _ in found] == [licence], (width, found)
        assert text[found[0][1] : found[0][2]].count("\n") >= body.count("\n") - 1


PRIVATE = [
    (1, "mail hein.19@mail5.example.com or HEIN.19@MAIL5.EXAMPLE.COM, call +1 (743) 555-3824 or +1 743 555 3824 now"),
    (2, "card 4785380592391139$$$ and 4111 1111 1111 1111, ip 70.23.22.57 and 192.168.3.4."),
    (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" ssn 123-45-6789'),
    (4, "Mr John Miller met Mrs Anna Miller; Mr Miller left. Г-н Иван Петров. Frau Schmidt"),
    (5, "Clean prose with 3 apples, version 2.0.1, year 2024 and 1,000 things."), (6, None), (7, ""), (1, "hein.19@mail5.example.com"),
    (8, 'login password=7602ad27cf5550de1c st, TOKEN | = | "F33E61083EB5DBDF4BD2369D2F80176E"!! tel +1%%% (743)### 555-3824$$$'), (9, "The secret: nothing. A password is needed."),
]


def test_surrogates(spark):
    out = pii.pseudonymise(frame(spark, PRIVATE), "k")
    assert out.columns == [*frame(spark, []).columns, "n_entities"]
    got = {(r.doc_id, i): r.text for i, r in enumerate(out.collect())}
    text = {i: t for (_, i), t in got.items()}
    assert (text[4], text[5], text[6], text[9]) == (PRIVATE[4][1], None, "", PRIVATE[9][1])
    for secret in ("hein", "HEIN", "743", "4785380592391139", "4111 1111 1111 1111", "70.23.22.57", "192.168.3.4", "2abc3ff2", "123-45-6789", "John", "Miller", "Anna M", "Иван", "Петров", "Schmidt", "7602ad27", "F33E61", "(743)"):
        assert not any(secret in (t or "") for t in text.values()), secret
    found = {i: [(t[a:b], k, c) for a, b, k, c in pii.entities(t or "")] for i, t in text.items()}
    assert [k for _, k, _ in found[0]] == ["email", "email", "phone", "phone"]
    assert found[0][0][0].upper() == found[0][1][0] and found[0][2][2] == found[0][3][2] and found[7][0][0] == found[0][0][0]
    assert [pii._luhn(found[1][k][2]) == 0 for k in (0, 1)] == [pii._luhn(c) == 0 for c in ("4785380592391139", "4111111111111111")]
    assert text[1].split("ip ")[1].split(" and ")[1].startswith("192.168.")
    names = {k: [c for _, kind, c in found[3] if kind == k] for k in ("family", "first_m", "first_f")}
    assert names["family"][0] == names["family"][1] == names["family"][2]
    latin = [x.lower() for x in pii.FIRST["latin", "m"]]
    assert names["first_m"][0] in latin and names["first_m"][1] in [x.lower() for x in pii.FIRST["cyrillic", "m"]]
    assert names["first_f"] and names["first_f"][0] in [x.lower() for x in pii.FIRST["latin", "f"]]
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0
    assert {r.text for r in pii.pseudonymise(frame(spark, PRIVATE), "other").collect()} != set(text.values())


@pytest.mark.parametrize("text, words", [
    ("Mrs Anna Maria Smith left", ["Anna", "Maria", "Smith"]), ("Ms Smith-Jones left", ["Smith-Jones"]), ("Frau Anna von Berg kam", ["Anna", "Berg"]), ("Frau von Berg kam", ["Berg"]),
    ("Mr O'Neil left", ["O'Neil"]), ("Mr Drake left", ["Drake"]), ("Mrs Drew Barry left", ["Drew", "Barry"]), ("Mr Miller Mrs Smith", ["Miller", "Smith"]), ("Dr Mr left", []),
])
def test_whole_names_are_found(text, words):
    found = pii.entities(text)
    assert [text[a:b] for a, b, _, _ in found] == words
    assert all(kind == "family" or i < len(found) - 1 for i, (_, _, kind, _) in enumerate(found))


def test_people_of_one_family_stay_distinct(spark):
    first = "Abigail Beatrice Carol Doris Edith Flora Gloria Hilda Ida Jane Kate Lucy Martha Nancy Olive Pamela Queenie Ruth Sarah Tess".split() + ["Anna", "Clara"]
    out = pii.pseudonymise(frame(spark, [(i, f"Mrs {x} Miller") for i, x in enumerate(first)]), "k").collect()
    assert len({r.text for r in out}) == len(first)
    assert not {r.text.split()[1] for r in out} & set(first)


def test_a_first_name_keeps_surrogate_and_gender_beside_any_title(spark):
    first = "Anna Clara Jane Kate Lucy Ruth Sarah Tess".split()
    rows = [(i, f"Mrs {x} Miller") for i, x in enumerate(first)] + [(i, f"Dr {x} Miller") for i, x in enumerate(first)] + [(90, "Prof Vera Stone")]
    out = [(r.doc_id, r.text.split()[1:]) for r in pii.pseudonymise(frame(spark, rows), "k").collect()]
    for i, _ in enumerate(first):
        a, b = (x for j, x in out if j == i)
        assert a == b
    female = set(pii.FIRST["latin", "f"])
    assert all(x[0].split("-")[0] in female for _, x in out)


def test_surrogates_are_redrawn_on_collision(spark, monkeypatch):
    """With a draw that always collides at first, distinct entities still get distinct surrogates, and texts use them."""
    draw = pii.surrogate

    def first_the_same(key, kind, canonical, attempt=0):
        return "1.2.3.4" if kind == "ip" and attempt == 0 else draw(key, kind, canonical, attempt)

    monkeypatch.setattr(pii, "surrogate", first_the_same)
    rows = [(i, f"host 70.1.1.{i} and 70.1.1.{i + 1}") for i in range(1, 6)] + [(9, "host 1.2.3.4")]
    known = pii.assignments(spark.createDataFrame([("ip", c) for _, t in rows for _, _, _, c in pii.entities(t)], "kind string, canonical string"), b"k").collect()
    assert len({r.surrogate for r in known}) == len(known) == 7
    assert not {r.surrogate for r in known} & {r.canonical for r in known}


def replaced(spark, texts, **how):
    rows = list(enumerate(texts))
    return [r.text for r in sorted(pii.pseudonymise(frame(spark, rows), "k", **how).collect(), key=lambda r: r.doc_id)]


def test_masked_secrets_get_a_drawn_form(spark):
    texts = ['password = "********"', 'password: "........"', "pwd='--------'", 'password = "********"']
    out = replaced(spark, texts)
    assert out[0] == out[3] and len(set(out)) == 3
    for t, o in zip(texts, out, strict=True):
        assert len(o) == len(t) and not any(x in o for x in ("****", "....", "----"))


def test_shapes_that_are_used_up_get_wider(spark):
    names = [a + b for a in "BCDFGHKLMNPRSTW" for b in "aeio"]
    out = replaced(spark, [f"Mr {x}" for x in names])
    new = [t.split()[1] for t in out]
    assert len(names) == len(set(new)) == 60 and not {x.lower() for x in new} & {x.lower() for x in names}
    every = spark.range(65_536).selectExpr("'ip' AS kind", "concat('192.168.', id div 256, '.', id % 256) AS canonical")
    known = pii.assignments(every, b"k").collect()
    assert len({r.surrogate for r in known}) == 65_536
    assert all(r.surrogate.startswith(("10.", "2001:db8:")) for r in known)


def test_a_name_is_replaced_throughout_its_document(spark):
    out = replaced(spark, [
        "Mr John Miller called. Later John Miller left; JOHN MILLER, Miller's dog and Millers stay.", "John Miller of another text", "Mr John met Dr John Smith.", "Dr 王小明 left, 王小明说",
        "Г-н Иван Петров. Иван Петров ушёл", "Prof محمد spoke; محمد left", "Mr Ng ordered Ng-soup at ng@mail.example.com",
    ])
    first, family = out[0].split()[1], out[0].split()[2]
    assert out[0] == f"Mr {first} {family} called. Later {first} {family} left; {first.upper()} {family.upper()}, {family}'s dog and Millers stay."
    assert out[1] == "John Miller of another text"
    assert out[2].split()[1] == out[2].split()[4] == first
    name = out[3].split()[1]
    assert out[3] == f"Dr {name} left, {name}说" and len(name) == 3 and all("一" <= c <= "鿿" for c in name)
    assert out[4].replace(".", "").split()[1:3] == out[4].split()[3:5] and "Иван" not in out[4] and "Петров" not in out[4]
    arabic = out[5].split()[1]
    assert out[5] == f"Prof {arabic} spoke; {arabic} left" and len(arabic) == 4 and all("\u0600" <= c <= "\u06ff" for c in arabic)
    assert "ng@" not in out[6]


def test_clashing_names_and_edge_rows(spark):
    df = frame(spark).withColumn("n_entities", F.lit("mine"))
    out = pii.pseudonymise(df, "k")
    assert out.columns == [*df.columns, "n_entities_"]
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.text, r.n_entities) for r in out.collect()), key=key) == sorted(((i, t, "mine") for i, t in EDGE), key=key)
    assert {r.n_entities_ for r in out.collect()} == {0}


def planted_private(rng, n):
    """Texts made of words and private strings that the test itself knows, with the entity of each."""
    first, family = ["Abel", "Berta", "Cyrus", "Doris", "Edgar"], ["Quandt", "Rhee", "Stolz", "Tamm", "Urbach", "Vance"]
    for i in range(n):
        hosts = [f"{rng.randint(20, 90)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}" for _ in range(2)]
        person = f"{rng.choice(first)} {rng.choice(family)}"
        private = {
            f"u{rng.randint(0, 999)}.x@mail{rng.randint(0, 9)}.example.com": "email", hosts[0]: "ip", hosts[1]: "ip", person: "person", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}": "phone",
            f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}": "ssn", f"{rng.randint(4 * 10**15, 5 * 10**15 - 1)}": "card", "".join(rng.choices("0123456789abcdef", k=38)) + "a1": "secret",
        }
        parts = [f"Dr {x}" if k == "person" else x for x, k in private.items()]
        rng.shuffle(parts)
        yield " and so ".join([*parts, *rng.sample(parts, 2), person + " again"]), private


@pytest.mark.parametrize("broadcast", [pii.BROADCAST, -1])
def test_planted_private_strings(spark, broadcast):
    """Every planted string goes; what stands between stays; one entity has one surrogate, and two have two, over all texts."""
    rng = random.Random(17)
    cases = list(planted_private(rng, 150))
    out = replaced(spark, [t for t, _ in cases], broadcast=broadcast)
    seen = {}
    for (text, private), new in zip(cases, out, strict=True):
        assert not any(part in new for x, k in private.items() for part in (x.split() if k == "person" else [x]))
        before = [w for w in text.split(" and so ")]
        after = new.split(" and so ")
        assert len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            a, b = a.removeprefix("Dr ").removesuffix(" again"), b.removeprefix("Dr ").removesuffix(" again")
            for x, y in zip(*((a.split(), b.split()) if private.get(a) == "person" else ([a], [b])), strict=True):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    assert not set(seen) & set(seen.values())


def test_both_ways_of_changed_entities_agree(spark):
    texts = [f"Mr {a}{b} met Mr Kim Lee, Dr Kim and Ms Lee Park" for a in "BCDFGHKLMNPRSTW" for b in "aeio"] + ["", "plain"]
    assert replaced(spark, texts) == replaced(spark, texts, broadcast=-1)


def test_every_document_loses_its_private_strings(spark):
    texts = dict(documents(spark))
    out = {r.doc_id: r for r in pii.op8_pii_surrogates(spark, SF).collect()}
    assert len(out) == len(texts)
    for i, t in texts.items():
        found = pii.entities(t)
        assert out[i].n_entities == len(found)
        if not found:
            assert out[i].text == t
        for a, b, kind, _ in found:
            assert t[a:b] not in out[i].text or kind.startswith("first_")
