"""SimHash fingerprints, their exact range join in a grid of popcounts, and linked components.

A fingerprint becomes the vector of its 16 segments' bit counts. Every differing bit moves that
vector by at most one, so the Manhattan distance of two vectors is a lower bound of the Hamming
distance. Points at distance 2 or less have a grid point within 1 of both: each fingerprint goes
to its own cell and the 32 next to it, and fingerprints that meet in a cell are verified exactly.
Equal fingerprints are one point, and a cell answers with a spanning forest of its links, so no
group of copies makes pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, chunks, cut_lineage, giving_back, id_and_text, interned, let_go, read, real_id, utf8, words_of
from .shared_spans import _BYTE, _kgrams, _mix, _spans_hash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

PRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints_of(buf: np.ndarray, ends: np.ndarray, shingle: int) -> np.ndarray:
    """One unsigned fingerprint for each row; zero for a row without words."""
    import xxhash

    buf = _LOWER[buf]
    starts, stops, row = words_of(buf, ends)
    out = np.zeros(len(ends) - 1, np.uint64)
    if not len(starts):
        return out
    size = stops - starts
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[stops] -= 1
    at = np.cumsum(size + 1) - size - 1
    flat = np.full(int((size + 1).sum()), 32, np.uint8)
    letters = np.ones(len(flat), bool)
    letters[at + size] = False
    flat[letters] = buf[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    raw = flat.tobytes()
    n = len(starts)
    end = np.minimum(np.arange(n) + shingle - 1, n - 1)
    whole = row[end] == row
    whole &= np.arange(n) + shingle - 1 < n
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    last = np.append(np.flatnonzero(first)[1:], n) - 1
    short = np.flatnonzero(first)[last - np.flatnonzero(first) + 1 < shingle]
    whole[short] = True
    end[short] = last[last - np.flatnonzero(first) + 1 < shingle]
    which = np.flatnonzero(whole)
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(raw[i:j], 42) for i, j in zip(at[which].tolist(), (at[end[which]] + size[end[which]]).tolist(), strict=True)], "<u8")
    rows = row[which]
    cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    many = 2 * ones > np.diff(np.append(cut, len(rows)))[:, None]
    out[rows[cut]] = np.packbits(many, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch["text"])
            got = [fingerprints_of(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle) for a, b in chunks(ends, 1 << 20)]
            fp = np.concatenate(got or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fp)], schema=PRINTS)

    return id_and_text(docs, id_col, text_col).mapInArrow(giving_back(run), "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(prints: DataFrame) -> DataFrame:
    """fp with each cell within distance 1: sixteen counts, each plus one, of four bits."""
    own = F.lit(0).cast("long")
    for i in range(16):
        count = F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(0xF << 4 * i)))) + 1
        own = own.bitwiseOR(F.shiftleft(count.cast("long"), 4 * i))
    steps = F.array(F.lit(0).cast("long"), *[F.lit(s << 4 * i).cast("long") for i in range(16) for s in (1, -1)])
    return prints.select("fp", own.alias("own")).select("fp", F.explode(F.transform(steps, lambda s: F.col("own") + s)).alias("cell"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links_in(cell: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest, by cell, of the links at `distance` bits or less. cell: sorted; fp: unsigned.

    A cell's fingerprints are compared with the next 64 of their cell. In a larger one, all that share a value
    at one flipped bit are within 2 bits of each other and join its first, or, at distance 1, the one that has the value.
    """
    if distance == 0:  # distinct fingerprints
        return []
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = cell[1:] != cell[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    many = np.repeat(size, size) > 64
    pairs = []
    small = np.flatnonzero(~many)
    for d in range(1, int(size[size <= 64].max(initial=1))):
        i = small[:-d]
        j = i + d
        ok = (small[d:] == j) & (cell[i] == cell[np.minimum(j, n - 1)])
        i, j = i[ok], j[ok]
        near = _popcount(fp[i] ^ fp[j]) <= distance
        pairs.append(np.stack([i[near], j[near]], 1))
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for s, m in zip(start.tolist(), size.tolist(), strict=True):
        if m > 64:
            value = (fp[s : s + m, None] ^ flips).ravel()
            member = np.repeat(np.arange(s, s + m), 65)
            flipped = np.tile(flips != 0, m)
            order = np.lexsort((member, flipped, value))
            value, member, flipped = value[order], member[order], flipped[order]
            first = np.r_[True, value[1:] != value[:-1]]
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            joined = ~first & (~flipped[head] | (distance == 2))
            pairs.append(np.stack([member[head[joined]], member[joined]], 1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for i, j in np.concatenate(pairs).tolist() if pairs else ():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _links(distance: int):
    def some(cell, fp):
        found = links_in(cell, fp, distance)
        i, j = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ([], [])))
        a, b = fp.view(np.int64)[i], fp.view(np.int64)[j]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=LINKS)

    def run(batches):
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, batch["cell"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
            ready = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if ready > 50_000:
                yield some(cell[:ready], fp[:ready])
                cell, fp = cell[ready:], fp[ready:]
        yield some(cell, fp)

    return run


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Columns a > b: links among distinct fp, at least a spanning forest of those at 2 bits or less."""
    if distance not in (0, 1, 2):
        raise ValueError("the grid's cells reach a distance of 2")
    met = cells(prints)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(giving_back(_links(distance)), "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, root (the smallest node reachable) of all nodes with an edge but the roots. edges: a > b, longs.

    Alternates the large-star and small-star steps until nothing changes.
    """
    edges = cut_lineage(edges.select("a", "b"))
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut_lineage(small.where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, fingerprint (16 hexadecimal digits), component_id.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; fingerprints come from XXH64 (seed 42) of
    shingles, repeats included; a text without words, or null, has fingerprint zero and links like any other.
    component_id is the smallest identifier that links of `distance` bits or less reach (null ranks last). Rows may
    repeat; an empty table gives no rows; other columns are ignored.
    """
    own = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    distinct = own.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(distinct.select("fp"), distance))
    distinct = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = distinct.groupBy("root").agg(F.min("least").alias("component"))
    classes = distinct.join(least, "root").select("fp", "component")
    out = own.join(classes, "fp")
    return out.select(real_id().alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("component").alias("component_id"))


SKETCH = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("tables", pa.list_(pa.int64()))])


def _shingles(buf: np.ndarray, ends: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lower-cased words, and their rows in order; a shorter row has one of all its words."""
    import xxhash

    buf = _LOWER[buf]
    starts, stops, row = words_of(buf, ends)
    number = interned(buf, starts, stops, _spans_hash(_BYTE[buf], starts, stops))
    raw, one = buf.tobytes(), np.unique(number, return_index=True)[1]
    # sums of these mixed values make the shingles' hashes, so no two chosen words can cancel out
    words = np.array([xxhash.xxh64_intdigest(raw[i:j], 11) for i, j in zip(starts[one].tolist(), stops[one].tolist(), strict=True)], np.uint64)[np.unique(number, return_inverse=True)[1]]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(row))
    short = last - first < shingle
    h, r = _spans_hash(words, first[short], last[short]), row[first[short]]
    if len(words) >= shingle:
        at = np.flatnonzero(row[: len(words) - shingle + 1] == row[shingle - 1 :])
        h, r = np.concatenate([h, _kgrams(words, shingle)[at]]), np.concatenate([r, row[at]])
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def _majority(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(np.append(cut, len(h)))[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _sketches(shingle: int, tables: int, sample: int):
    seeds = np.random.default_rng(11).integers(0, 1 << 64, (tables, sample), dtype=np.uint64)

    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch["text"])
            for a, b in chunks(ends, 1 << 20):
                h, row = _shingles(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                if not len(h):
                    continue
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                n = len(cut)
                drawn = np.empty((n, tables), np.uint64)
                for t in range(tables):
                    least = np.stack([np.minimum.reduceat(_mix(h ^ s), cut) for s in seeds[t]], 1)
                    drawn[:, t] = _majority(least.ravel(), np.arange(n) * sample)
                part = batch.slice(a, b - a).take(pa.array(row[cut]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(drawn.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["id"], part["node"], pa.array(_majority(h, cut).view(np.int64)), lists], schema=SKETCH)

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch["text"])
            for a, b in chunks(ends, 1 << 20):
                h, row = _shingles(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                at = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a), lists], names=["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _long_sketches(batches):
    """node, n and bits of shingle sets: about four bits a shingle, as a power of two of longs."""
    for batch in batches:
        lists = batch["shingles"]
        ends = lists.offsets.to_numpy().astype(np.int64)
        h = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
        n = np.diff(ends)
        longs = 1 << np.ceil(np.log2(np.maximum(n / 16, 1))).astype(np.int64)
        at = np.r_[0, np.cumsum(longs)]
        out = np.zeros(at[-1], np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        np.bitwise_or.at(out, at[row] + ((h >> np.uint64(6)) & (longs[row] - 1).astype(np.uint64)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
        bits = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(n), bits], names=["node", "n", "bits"])


def _may_be_similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but those whose long sketches rule the similarity out: whole sets are sent for the others alone."""
    long = sets.select("node", "shingles").mapInArrow(giving_back(_long_sketches), "node long, n long, bits array<long>")
    both = pairs
    for own, m in (("a", "l_"), ("b", "r_")):
        both = both.join(long.select(F.col("node").alias(own), *[F.col(c).alias(m + c) for c in ("n", "bits")]), own)
    # the longer sketch is folded to the other's length, where more shingles share a bit
    part = lambda m, o: f"transform(slice({m}bits, 1, least(size({m}bits), size({o}bits))), (v, i) -> aggregate(sequence(i, size({m}bits) - 1, size({o}bits)), v, (s, k) -> s | {m}bits[k]))"
    both = both.select("a", "b", "l_n", "r_n", F.expr(part("l_", "r_")).alias("l"), F.expr(part("r_", "l_")).alias("r"))
    beyond = lambda m: f"{m}_n - aggregate({m}, 0L, (s, v) -> s + bit_count(v))"
    shared = "aggregate(zip_with(l, r, (p, q) -> bit_count(p & q)), 0L, (s, c) -> s + c)"
    return both.where(f"{shared} + least({beyond('l')}, {beyond('r')}) >= {similarity / (1 + similarity)!r}D * (l_n + r_n) - 1e-6D").select("a", "b")


PREFIX = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("i", pa.int64())])
#: Longs of a shingle set's sketch; the shingles that prefixes may put last.
BITS, MOST_COMMON = 16, 10_000


def _prefixes(shingle: int, similarity: float, common: np.ndarray):
    """node, n (distinct shingles), s, i: each row's first shingles, in an order that all rows share; any two similar rows have one of these in common.

    common: the shingles that come last, the most frequent one at the end; the others come in order of their hashes. Any
    order is right, so that they are a sample's costs no pair.
    """
    sorter = np.argsort(common)
    ordered = common[sorter]

    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch["text"])
            for a, b in chunks(ends, 1 << 20):
                h, row = _shingles(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                if not len(h):
                    continue
                late = np.zeros(len(h), np.int64)
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                    late = np.where(ordered[at] == h, sorter[at] + 1, 0)
                order = np.lexsort((h, late, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                h, row = h[new], row[new]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                size = np.diff(np.append(first, len(row)))
                n = np.repeat(size, size)
                i = np.arange(len(row)) - np.repeat(first, size)
                few = i <= n - np.ceil(similarity * n - 1e-6)
                node = batch["node"].slice(a, b - a).take(pa.array(row[few]))
                yield pa.RecordBatch.from_arrays([node, pa.array(n[few]), pa.array(h[few].view(np.int64)), pa.array(i[few])], schema=PREFIX)

    return run


def _bits(shingle: int):
    """node and BITS longs: a bit for each shingle of the row."""

    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch["text"])
            for a, b in chunks(ends, 1 << 20):
                h, row = _shingles(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                out = np.zeros((b - a, BITS), np.uint64)
                np.bitwise_or.at(out, (row, ((h >> np.uint64(6)) % np.uint64(BITS)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(a, b - a), *[pa.array(out[:, k].view(np.int64)) for k in range(BITS)]], names=["node", *[f"b{k}" for k in range(BITS)]])

    return run


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles of every 16th document by hash, rarest first. They only order prefixes."""
    sample = rows.where("pmod(xxhash64(node), 16) = 0").select("node", "text").mapInArrow(giving_back(_sets(shingle)), "node long, shingles array<long>")
    often = sample.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 3")
    found = often.orderBy(F.desc("df"), "s").limit(MOST_COMMON).collect()
    return np.array([r.s for r in reversed(found)], np.int64).view(np.uint64)


def _seen(rows: DataFrame, own: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a > b that meet by fingerprints, and the components of those that are similar."""
    point = F.struct("id", "node")
    drawn = own.select("id", "node", F.posexplode("tables").alias("t", "value"))
    met = cut_lineage(drawn.groupBy("t", "value").agg(F.min(point).alias("low"), F.max(point).alias("high"), F.count("*").alias("n")).where("low.node != high.node"))
    pairs = drawn.join(met, ["t", "value"]).select("node", F.explode(F.array("low.node", "high.node")).alias("other"))
    prints = own.groupBy("fp").agg(F.min(point).alias("low"))
    near = links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("low.node").alias("node")), "a").join(prints.select(F.col("fp").alias("b"), F.col("low.node").alias("other")), "b")
    same = own.join(prints, "fp").select("node", F.col("low.node").alias("other"))
    pairs = pairs.unionByName(near.select("node", "other")).unionByName(same).where("node != other")
    pairs = cut_lineage(pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = rows.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(giving_back(_sets(shingle)), "node long, shingles array<long>").dropDuplicates(["node"])
    # written out, so the joins below deal both sides only for themselves and a crowded leader's pairs can be split
    sets = cut_lineage(sets.select("node", F.array_distinct("shingles").alias("shingles")))
    return pairs, components(_verified(pairs, sets, similarity))


def _unseen(rows: DataFrame, root: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs a > b of nodes of different groups that may be similar: all that are, by prefix filter, positions and sketches."""
    within = Window.partitionBy("s")
    prefix = rows.select("node", "text").mapInArrow(giving_back(_prefixes(shingle, similarity, _common(rows, shingle))), "node long, n long, s long, i long")
    # one shuffle of the prefixes; shingles of one node alone go
    met = prefix.withColumns({"low": F.min("node").over(within), "high": F.max("node").over(within)}).where("low != high").select("node", "n", "s", "i")
    met = met.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = met.withColumns({"low": F.min("root").over(within), "high": F.max("root").over(within)}).where("low != high").drop("low", "high").dropDuplicates(["s", "node"])
    met = cut_lineage(met)
    del prefix
    let_go(rows.sparkSession)
    wanted = met.select("node").distinct()
    bits = rows.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(giving_back(_bits(shingle)), "node long, " + ", ".join(f"b{k} long" for k in range(BITS))).dropDuplicates(["node"])
    bits = bits.withColumn("ones", F.expr(" + ".join(f"bit_count(b{k})" for k in range(BITS))))
    met = cut_lineage(met.join(bits, "node").withColumn("x", F.col("n") - F.col("ones")).drop("ones"))
    del bits, wanted
    let_go(rows.sparkSession)
    l, r = (met.select("s", *[F.col(c).alias(m + c) for c in met.columns if c != "s"]) for m in ("l_", "r_"))  # noqa: E741
    share = f"{similarity / (1 + similarity)!r}D * (l_n + r_n) - 1e-6D"
    most = " + ".join(f"bit_count(l_b{k} & r_b{k})" for k in range(BITS)) + " + least(l_x, r_x)"
    pairs = l.join(r, "s").where(f"l_node > r_node AND l_root != r_root AND least(l_n - l_i, r_n - r_i) >= {share} AND {most} >= {share}")
    return pairs.select(F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()


def _joined(root: DataFrame, more: DataFrame) -> DataFrame:
    """Components after more links a, b: only the groups' roots meet again."""
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    ends = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a != b").distinct()
    moved = components(ends)
    up = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return root.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(moved)


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tables: int = 12, sample: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of similar texts: node (a 64-bit hash of identifier and text), id, keep_id and kept, of the texts in groups of two or more.

    Texts are linked whose sets of word shingles have a Jaccard similarity of `similarity` or more, exactly verified.
    Candidates are those whose fingerprints of all shingles differ in at most two bits (the popcount grid), and those
    with equal fingerprints of a few shingles drawn alike from both (`tables` draws of `sample`): two texts of similarity
    s share one with probability 1 - (1 - s^sample)^tables, 0.998 at the defaults. Each candidate is compared with the
    first and the last of those it meets. Then what these did not see is found exactly: with shingles in one order for all,
    two similar texts share one of their first n - ceil(similarity n) + 1, and nodes of different groups that meet there are
    compared unless their places or sketches rule the similarity out. So no link between groups is lost, and pairs of one
    group are not made again. Texts without words have no links,
    null and empty ones among them. Rows that repeat identifier and text are one node; a null identifier ranks last; an
    empty table gives no rows; other columns are ignored; long texts are compared whole.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("node", F.xxhash64("id", "text"))
    own = cut_lineage(rows.mapInArrow(giving_back(_sketches(shingle, tables, sample)), "id long, node long, fp long, tables array<long>"))
    pairs, root = _seen(rows, own, similarity, shingle)
    let_go(rows.sparkSession)
    rest = cut_lineage(_unseen(rows, root, similarity, shingle).join(pairs, ["a", "b"], "left_anti"))
    let_go(rows.sparkSession)
    if not rest.isEmpty():
        wanted = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = rows.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(giving_back(_sets(shingle)), "node long, shingles array<long>").dropDuplicates(["node"])
        sets = cut_lineage(sets.select("node", F.array_distinct("shingles").alias("shingles")))
        root = _joined(root, _verified(_may_be_similar(rest, sets, similarity), sets, similarity))
    nodes = root.select("node", "root").unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    nodes = nodes.join(own.select("id", "node").distinct(), "node")
    kept = nodes.groupBy("root").agg(F.min(F.struct("id", "node")).alias("low"))
    return nodes.join(kept, "root").select("node", "id", F.col("low.id").alias("keep_id"), (F.col("low.node") == F.col("node")).alias("kept"))


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **draws) -> DataFrame:
    """All rows and columns but those of similar_components() that are not kept: the smallest identifier of each group stays.

    Texts without words, null and empty ones all stay. Rows that repeat identifier and text are one document, which stays or
    goes with all its rows; of equal texts with one identifier in different spelling one stays, by a hash. An empty table
    gives no rows; other columns stay whatever their names. Long texts are compared whole.
    """
    gone = similar_components(docs, similarity, shingle, id_col=id_col, text_col=text_col, **draws).where("NOT kept").select(F.col("node").alias("_gone"), F.coalesce("id", F.lit(NO_ID)).alias("_id"))
    plain = id_and_text(docs, id_col, text_col, tuple(docs.columns)).withColumn("_gone", F.xxhash64("id", "text")).withColumnRenamed("id", "_id").drop("text")
    return plain.join(gone, ["_gone", "_id"], "left_anti").drop("_gone", "_id").toDF(*docs.columns)


def op9_simhash_popcount_grid(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir))
