"""Which windows of a document also start in a document with a smaller identifier.

A window is `width` consecutive symbols (bytes, or words). Every window owns one anchor, the
k-gram in it with the smallest hash (the leftmost of equals); equal windows own equal anchors.
So it is enough to bring together segments with equal anchors: the symbols of all windows
that own one occurrence of it.

1. Documents are dealt into groups of bounded size. Each group sends every anchor hash once
   to the hash's bucket, and the bucket answers which hashes other documents have too.
2. Each group sends the distinct segments of such anchors, with the smallest identifier that
   has them, to the anchor's shard. A shard's kernel (a suffix array, or a suffix automaton)
   finds the smallest identifier for each window of each segment.
3. The answers go back to the groups, which mark the windows of larger identifiers.

A hash only picks candidates: groups, shards and kernels tell segments apart by their bytes. A
group reads its rows in one order, so an answer names its segment by the number of its first
occurrence there. A hot passage arrives once from each group, however many documents have it, and
no step makes pairs of documents. Groups are dealt by identifier and text, so rows that all repeat
one identifier, or have none, are dealt evenly too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, groups_for, id_and_text, text_bytes, utf8, words_of

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _kgrams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of k symbols from each place on, from hashes of 1, 2, 4 ... symbols."""
    done, got, span, size = 0, None, x, 1
    while True:
        if k & size:
            if got is None:
                got = span
            else:
                m = len(x) - done - size + 1
                got = got[:m] * np.uint64(pow(int(_P), size, 1 << 64)) + span[done : done + m]
            done += size
        size *= 2
        if size > k:
            return _mix(got)
        half = size // 2
        m = len(x) - size + 1
        span = span[:m] * np.uint64(pow(int(_P), half, 1 << 64)) + span[half : half + m]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, p in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            x = np.ones(m, np.uint64)
            done = 1
            while done < m:
                x[done : 2 * done] = x[:done] * np.uint64(pow(p, done, 1 << 64))
                done *= 2
            _POWERS[i] = x
    return _POWERS[0][:n], _POWERS[1][:n]


def _spans_hash(symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:stop] for each pair."""
    up, down = _powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return _mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _MIX)


@dataclass(frozen=True)
class Windows:
    """What a window is: `width` symbols, anchors of `k` symbols."""

    width: int
    k: int
    words: bool = False
    group_mb: float = 8.0
    bucket_anchors: int = 1_500_000
    shard_mb: float = 1.0
    chunk: int = 1 << 19

    def density(self) -> float:
        """Anchors for each byte of random text, about."""
        return 2 / (self.width - self.k + 2) / (6 if self.words else 1)


@dataclass
class Chunk:
    """Symbols of some rows of a group, and the segment of each anchor among their windows."""

    row0: int
    rows: int
    ends: np.ndarray  # of the rows' bytes
    buf: np.ndarray  # the bytes
    row: np.ndarray  # of each symbol
    starts: np.ndarray  # of each symbol in buf
    stops: np.ndarray
    first: np.ndarray  # of each segment: the first window, and the last
    last: np.ndarray
    anchor: np.ndarray  # its hash
    key: np.ndarray  # a hash of the whole segment, which only tells where to look

    def seg_row(self) -> np.ndarray:
        return self.row0 + self.row[self.first]


def _chunk_of(win: Windows, buf: np.ndarray, ends: np.ndarray, row0: int) -> Chunk:
    if win.words:
        starts, stops, row = words_of(buf, ends)
        symbols = _spans_hash(_BYTE[buf], starts, stops)
    else:
        starts = stops = np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        symbols = _BYTE[buf]
    n, w = len(symbols), win.width - win.k + 1
    none = np.zeros(0, np.int64)
    if n < win.width:
        return Chunk(row0, len(ends) - 1, ends, buf, row, starts, stops, none, none, none.astype(np.uint64), none.astype(np.uint64))
    mask = np.uint64((1 << n.bit_length()) - 1)
    grams = _kgrams(symbols, win.k)
    least = _sliding_min(grams & ~mask | np.arange(len(grams), dtype=np.uint64), w) & mask
    own = np.flatnonzero(row[: len(least)] == row[win.width - 1 :])
    least = least[own]
    new = np.ones(len(own), bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1] + 1)
    at = np.flatnonzero(new)
    first = own[at]
    last = own[np.append(at[1:], len(own)) - 1] if len(own) else none
    key = _spans_hash(symbols, first, last + win.width)
    return Chunk(row0, len(ends) - 1, ends, buf, row, starts, stops, first, last, grams[least[at].astype(np.int64)], key)


def _chunks_of(win: Windows, ends: np.ndarray, buf: np.ndarray) -> Iterator[Chunk]:
    for a, b in chunks(ends, win.chunk):
        yield _chunk_of(win, buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], a)


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(blob: bytes) -> np.ndarray:
    got = np.zeros((len(blob) // 6, 8), np.uint8)
    got[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return got.view("<u8").ravel()


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(values):
        at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        yield from zip(values[at].tolist(), at.tolist(), np.append(at[1:], len(values)).tolist(), strict=True)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ANCHORS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
SEGMENTS = pa.schema([("shard", pa.int32()), ("g", pa.int32()), ("first", pa.binary()), ("sizes", pa.binary()), ("owners", pa.binary()), ("data", pa.binary())])
ANSWERS = pa.schema([("g", pa.int32()), ("first", pa.binary()), ("runs", pa.binary()), ("length", pa.binary()), ("owner", pa.binary())])


def _in_order(docs: pa.Table) -> pa.Table:
    """A group's rows in an order that their content alone decides; rows come from a shuffle in any order."""
    return docs.take(pc.sort_indices(docs, [("id", "ascending"), ("text", "ascending")])).combine_chunks()


def _spark(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _bucket_and_rest(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a hash goes, and the 48 bits that tell it from others there."""
    return h % np.uint64(buckets), h // np.uint64(buckets) & _LOW48


def _key(bucket: np.ndarray | int, rest: np.ndarray, buckets: int) -> np.ndarray:
    return rest * np.uint64(buckets) + np.asarray(bucket, np.uint64)


def _send_anchors(win: Windows, buckets: int) -> Callable:
    def of_group(key, table):
        ends, buf = utf8(table["text"])
        hashes, rows = [], []
        for c in _chunks_of(win, ends, buf):
            hashes.append(c.anchor)
            rows.append(c.seg_row())
        h, row = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(rows or [np.zeros(0, np.int64)])
        bucket, h = _bucket_and_rest(h, buckets)
        order = np.lexsort((row, h, bucket))
        bucket, h, row = bucket[order], h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        more = row[at] != row[np.append(at[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
        bucket, h = bucket[at], h[at]
        out = []
        for b, i, j in _runs(bucket):
            out.append((b, key[0].as_py(), _pack48(h[i:j][~more[i:j]]), _pack48(h[i:j][more[i:j]])))
        return _table(ANCHORS, out)

    return of_group


def _live_anchors(key, table):
    """Which hashes of a bucket more than one document has: for each group, its own ones."""
    parts, groups, sure = [], [], []
    for g, once, more in zip(table["g"].to_pylist(), table["once"].to_pylist(), table["more"].to_pylist(), strict=True):
        for blob, multi in ((once, False), (more, True)):
            if blob:
                parts.append(_unpack48(blob))
                groups.append(np.full(len(parts[-1]), g, np.int32))
                sure.append(np.full(len(parts[-1]), multi))
    if not parts:
        return _table(ANCHORS, [])
    h, g, multi = np.concatenate(parts), np.concatenate(groups), np.concatenate(sure)
    order = np.argsort(h, kind="stable")
    h, g, multi = h[order], g[order], multi[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    live = same[1:] | same[:-1] | multi
    h, g = h[live], g[live]
    order = np.argsort(g, kind="stable")
    h, g = h[order], g[order]
    return _table(ANCHORS, [(key[0].as_py(), x, _pack48(h[i:j]), b"") for x, i, j in _runs(g)])


def _text_of(win: Windows, c: Chunk, which: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """Bytes, and where in them the segments `which` start and stop. Words are one space apart."""
    first, stop = c.first[which], c.last[which] + win.width
    if not win.words:
        return c.buf.tobytes(), first.tolist(), stop.tolist()
    size = c.stops - c.starts
    begin = np.cumsum(size + 1) - size - 1
    keep = np.zeros(len(c.buf) + 1, np.int32)
    keep[c.starts] += 1
    keep[c.stops] -= 1
    inside = np.cumsum(keep[:-1]) > 0
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    gaps = np.ones(len(out), bool)
    gaps[begin + size] = False
    out[gaps] = c.buf[inside]
    return out.tobytes(), begin[first].tolist(), (begin[stop - 1] + size[stop - 1]).tolist()


def _send_segments(win: Windows, buckets: int, shards: int) -> Callable:
    def of_group(key, docs, live):
        if not docs.num_rows or not live.num_rows:
            return _table(SEGMENTS, [])
        known = np.sort(np.concatenate([_key(b, _unpack48(x), buckets) for b, x in zip(live["bucket"].to_pylist(), live["once"].to_pylist(), strict=True)]))
        docs = _in_order(docs)
        ends, buf = utf8(docs["text"])
        ids = docs["id"].to_numpy()
        # by shard: a segment's smallest identifier and the number of its first occurrence
        found: defaultdict[int, dict[bytes, list[int]]] = defaultdict(dict)
        before = 0
        for c in _chunks_of(win, ends, buf):
            h = _key(*_bucket_and_rest(c.anchor, buckets), buckets)
            at = np.searchsorted(known, h)
            which = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
            data, first, stop = _text_of(win, c, which)
            shard = (c.anchor[which] % np.uint64(shards)).astype(np.int64)
            for s, i, j, own, k in zip(shard.tolist(), first, stop, ids[c.seg_row()[which]].tolist(), (which + before).tolist(), strict=True):
                had = found[s].setdefault(data[i:j], [own, k])
                if own < had[0]:
                    had[0] = own
            before += len(c.anchor)
        out = []
        pack = zstandard.ZstdCompressor(level=3).compress
        for s, segs in found.items():
            sizes = np.fromiter(map(len, segs), np.uint32, len(segs))
            owners, number = zip(*segs.values(), strict=True)
            out.append((s, key[0].as_py(), np.array(number, np.uint32).tobytes(), sizes.tobytes(), np.array(owners, np.int64).tobytes(), pack(b"".join(segs))))
        return _table(SEGMENTS, out)

    return of_group


#: Distinct segments and the smallest identifier of each -> number of windows of each, and all windows' smallest identifiers.
Kernel = Callable[[list[bytes], np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _answer(win: Windows, kernel: Kernel) -> Callable:
    def of_shard(table):
        number: dict[bytes, int] = {}
        owner: list[int] = []
        asked = []
        unpack = zstandard.ZstdDecompressor().decompress
        for g, numbers, sizes, owners, data in zip(*(table[c].to_pylist() for c in ("g", "first", "sizes", "owners", "data")), strict=True):
            stop = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)
            start = stop - np.frombuffer(sizes, np.uint32)
            mine, data = [], unpack(data)
            for i, j, own in zip(start.tolist(), stop.tolist(), np.frombuffer(owners, np.int64).tolist(), strict=True):
                k = number.setdefault(data[i:j], len(owner))
                if k == len(owner):
                    owner.append(own)
                elif own < owner[k]:
                    owner[k] = own
                mine.append(k)
            asked.append((g, numbers, np.array(mine, np.int64)))
        windows, least = kernel(list(number), np.array(owner, np.int64), win.width)
        begin = np.cumsum(windows) - windows
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[begin] = True
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(least))).astype(np.uint32)
        values = least[at]
        first = np.searchsorted(at, begin)
        runs = np.diff(np.append(first, len(at)))
        out = []
        for g, numbers, mine in asked:
            n = runs[mine]
            pick = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((g, numbers, n.astype(np.uint32).tobytes(), length[pick].tobytes(), values[pick].tobytes()))
        return _table(ANSWERS, out)

    return of_shard


def _marks(win: Windows, finish: Callable, schema: pa.Schema) -> Callable:
    def of_group(docs, answers):
        if not docs.num_rows:
            return schema.empty_table()
        docs = _in_order(docs)
        ends, buf = utf8(docs["text"])
        ids = docs["id"].to_numpy()
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in answers[c].to_pylist()] or [np.zeros(0, t)]).astype(np.int64)
        number, runs, length, owner = join("first", np.uint32), join("runs", np.uint32), join("length", np.uint32), join("owner", np.int64)
        begin = np.cumsum(runs) - runs
        order = np.argsort(number)
        number = number[order]
        keys = np.zeros(0, np.uint64)  # of answered segments met so far; the first occurrence comes before all others
        answer: dict[bytes, int] = {}
        before = 0
        out = []
        for c in _chunks_of(win, ends, buf):
            n = len(c.row)
            change = np.zeros(n + 1, np.int32)
            i, j = np.searchsorted(number, [before, before + len(c.key)])
            firsts = number[i:j] - before
            before += len(c.key)
            keys = np.sort(np.concatenate([keys, c.key[firsts]]))
            if len(keys) and len(c.key):
                which = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, c.key), len(keys) - 1)] == c.key)
                data, start, stop = _text_of(win, c, which)
                texts = [data[x:y] for x, y in zip(start, stop, strict=True)]
                for place, seg in zip(np.searchsorted(which, firsts).tolist(), order[i:j].tolist(), strict=True):
                    answer[texts[place]] = seg
                seg = np.array([answer.get(t, -1) for t in texts], np.int64)
                which, seg = which[seg >= 0], seg[seg >= 0]
                m = runs[seg]
                pick = np.repeat(begin[seg] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                covered = np.repeat(owner[pick], length[pick]) < np.repeat(ids[c.seg_row()[which]], c.last[which] - c.first[which] + 1)
                total = c.last[which] - c.first[which] + 1
                places = np.repeat(c.first[which] - (np.cumsum(total) - total), total) + np.arange(total.sum())
                places = places[covered]
                change[places] += 1
                change[places + win.width] -= 1
            out.append(finish(c, np.cumsum(change[:n]) > 0, ids))
        return pa.concat_tables(out)

    return of_group


#: Bytes that a message from a group to a shard should have, about.
MESSAGE = 1000


def sizes_for(size: int, win: Windows) -> tuple[int, int, int]:
    """Groups, buckets and shards for so many bytes of text.

    Messages go from each group to each shard, so both get larger with the root of the input once messages would be
    small, up to 256 and 64 MB (at 100 TB, executors want 4 GB a core).
    """
    grown = max(1.0, (size * MESSAGE / (win.group_mb * win.shard_mb * 1e12)) ** 0.5)
    group_mb, shard_mb = max(win.group_mb, min(win.group_mb * grown, 256.0)), max(win.shard_mb, min(win.shard_mb * grown, 64.0))
    buckets = max(1, round(size * win.density() / (win.bucket_anchors * min(grown, 10.0))))
    return groups_for(size, group_mb), buckets, groups_for(int(size * 0.4), shard_mb)


def shared_spans(docs: DataFrame, win: Windows, kernel: Kernel, finish: Callable, schema: pa.Schema, spark_schema: str, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    groups, buckets, shards = sizes_for(text_bytes(rows), win)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int")).repartition(max(parts, groups), "g")
    anchors = rows.groupBy("g").applyInArrow(_send_anchors(win, buckets), _spark(ANCHORS)).repartition(max(parts, buckets), "bucket")
    live = anchors.groupBy("bucket").applyInArrow(_live_anchors, _spark(ANCHORS))
    segments = rows.groupBy("g").cogroup(live.groupBy("g")).applyInArrow(_send_segments(win, buckets, shards), _spark(SEGMENTS)).repartition(max(parts, shards // 4), "shard")
    answers = segments.groupBy("shard").applyInArrow(_answer(win, kernel), _spark(ANSWERS))
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_marks(win, finish, schema), spark_schema)


def per_row(c: Chunk, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed runs among the symbols: the row of each, its start and stop."""
    start = removed.copy()
    start[1:] &= ~(removed[:-1] & (c.row[1:] == c.row[:-1]))
    stop = removed.copy()
    stop[:-1] &= ~(removed[1:] & (c.row[1:] == c.row[:-1]))
    a = np.flatnonzero(start)
    return c.row[a], a, np.flatnonzero(stop) + 1
