"""Exact duplicates by compressed radix tries.

Each task first inserts its own texts into a trie, so it sends a text once however often it has
it. Partitions by length and content hash then insert the full byte strings of all tasks into
their tries; a terminal node stores the row to keep (most characters, then smallest identifier)
and the number of rows. A trie over its memory limit spills its heaviest subtree to an anonymous
file of the task, which later becomes a trie of its own.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import NO_ID, WHITE, giving_back, groups_for, id_and_text, read, real_id, text_bytes

Value = tuple  # characters (negated), identifier, rows, digest, and what else belongs to the row


def merge(a: Value, b: Value) -> Value:
    """Rows that tie in characters and identifier are told apart by the rest of their values, whichever comes first."""
    best = a if a[:2] < b[:2] or a[:2] == b[:2] and (a[3:] == b[3:] or repr(a[3:]) <= repr(b[3:])) else b
    return (*best[:2], a[2] + b[2], *best[3:])


class PatriciaTrie:
    """Byte strings to values; equal strings merge theirs. weigh: a value's bytes in memory, about."""

    def __init__(self, limit: int, weigh: Callable[[Value], int] = lambda value: 200) -> None:
        self.limit, self.size, self.weigh = limit, 0, weigh
        self.root: list = [{}, None]  # children by first byte: [edge, node]; value
        self.spilled: dict[bytes, object] = {}

    def insert(self, key: bytes, value: Value) -> None:
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, value), file)
                return
        node, at = self.root, 0
        while at < len(key):
            branch = node[0].get(key[at])
            if branch is None:
                node[0][key[at]] = [key[at:], leaf := [{}, None]]
                self.size += len(key) - at + 400
                node, at = leaf, len(key)
            elif key.startswith(edge := branch[0], at):
                node, at = branch[1], at + len(edge)
            else:
                n = len(os.path.commonprefix([edge, key[at : at + len(edge)]]))
                middle = [{edge[n]: [edge[n:], branch[1]]}, None]
                node[0][key[at]] = [edge[:n], middle]
                self.size += 400
                node, at = middle, at + n
        had, node[1] = node[1], value if node[1] is None else merge(node[1], value)
        self.size += self.weigh(node[1]) - (0 if had is None else self.weigh(had))
        if self.size > self.limit:
            self._spill()

    def _walk(self, node: list, prefix: bytes) -> Iterator[tuple[bytes, Value]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node[1] is not None:
                yield prefix, node[1]
            stack.extend((child, prefix + edge) for edge, child in node[0].values())

    def _spill(self) -> None:
        """The heaviest child of the first branching node goes to a file; a single path stays."""
        node, prefix = self.root, b""
        while len(node[0]) == 1 and node[1] is None:
            ((edge, node),) = node[0].values()
            prefix += edge
        if len(node[0]) + (node[1] is not None) < 2:
            return
        weights = {b: sum(len(k) - len(prefix) + 400 + self.weigh(v) for k, v in self._walk(child, prefix + edge)) for b, (edge, child) in node[0].items()}
        b = max(weights, key=weights.__getitem__)
        edge, child = node[0].pop(b)
        file = self.spilled[prefix + bytes([b])] = tempfile.TemporaryFile()
        for entry in self._walk(child, prefix + edge):
            pickle.dump(entry, file)
        self.size = sum(w for k, w in weights.items() if k != b) + len(prefix)

    def items(self) -> Iterator[tuple[bytes, Value]]:
        """All strings with their merged values; the trie is empty afterwards."""
        yield from self._walk(self.root, b"")
        self.root, self.size = [{}, None], 0
        files, self.spilled = self.spilled, {}
        for file in files.values():
            part = PatriciaTrie(self.limit, self.weigh)
            with file:
                file.seek(0)
                while True:
                    try:
                        part.insert(*pickle.load(file))
                    except EOFError:
                        break
            yield from part.items()


def _normal(text: str) -> bytes:
    return text.encode().translate(None, WHITE)


ROWS = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("chars", pa.int64())])
ENTRIES = pa.schema([("size", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("chars", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
OWNERS = pa.schema([("size", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _rows(batches):
    for batch in batches:
        texts = batch["text"].to_pylist()
        normal = [_normal(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(b) for b in normal], pa.int64()), pa.array([hashlib.sha256(b).digest() for b in normal], pa.binary()), pa.array([len(t) for t in texts], pa.int64())], schema=ROWS)


def _collapsed(limit: int):
    def entries(trie):
        out = []
        size = 0
        for key, (chars, own, n, digest) in trie.items():
            out.append((len(key), digest, key, -chars, own, n))
            size += len(key)
            if size > 8_000_000:
                yield _batch(ENTRIES, out)
                out, size = [], 0
        if out:
            yield _batch(ENTRIES, out)

    def run(batches):
        trie = PatriciaTrie(1 << 62)
        for batch in batches:
            for own, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                key = _normal(text)
                trie.insert(key, (-len(text), own, 1, hashlib.sha256(key).digest()))
                if trie.size > limit:
                    yield from entries(trie)
        yield from entries(trie)

    return run


def _owners(limit: int):
    def run(batches):
        trie = PatriciaTrie(limit)
        for batch in batches:
            for digest, key, chars, own, n in zip(*(batch[c].to_pylist() for c in ("digest", "content", "chars", "id", "n")), strict=True):
                trie.insert(key, (-chars, own, n, digest))
        out = []
        for key, (_, own, n, digest) in trie.items():
            out.append((len(key), digest, own, n))
            if len(out) == 20_000:
                yield _batch(OWNERS, out)
                out = []
        yield _batch(OWNERS, out)

    return run


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_mb: float = 96.0, part_mb: float = 24.0) -> DataFrame:
    """For every row: id_col, keep_id, group_size, kept, text_sha256 (of the text without ASCII white space).

    Rows are equal whose texts are identical without the characters of [\\x20\\x09-\\x0D]; null counts as empty.
    The row with the most code points stays, then the one with the smallest identifier (null ranks last). Of rows
    that repeat the identifier to keep, all are marked kept. An empty table gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    limit = int(memory_mb * 1e6)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups_for(text_bytes(rows), part_mb))
    entries = rows.mapInArrow(giving_back(_collapsed(limit)), "size long, digest binary, content binary, chars long, id long, n long")
    owners = entries.repartition(parts, "size", "digest").mapInArrow(giving_back(_owners(limit)), "size long, digest binary, keep_id long, n long")
    out = rows.mapInArrow(giving_back(_rows), "id long, size long, digest binary, chars long").join(owners, ["size", "digest"])
    return out.select(
        real_id().alias(id_col), real_id("keep_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_mb: float = 96.0, part_mb: float = 24.0) -> DataFrame:
    """Of rows that exact_duplicates() finds equal, the one to keep, with all its columns: one row of each group, also where rows repeat.

    Null counts as empty, and a null identifier ranks last; rows with one identifier and as many characters are told apart
    by their content. An empty table gives no rows; columns may have any names; long texts are keys as a whole.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    text, own = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    limit = int(memory_mb * 1e6)
    plain = docs.toDF(*names)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups_for(plain.agg(F.sum(F.octet_length(text))).first()[0], part_mb))

    def values(batch):
        for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
            t = row[names.index(text)] or ""
            i = row[names.index(own)]
            key = _normal(t)
            yield key, (-len(t), NO_ID if i is None else i, 1, len(key), xxhash.xxh64_intdigest(key) >> 1, row)

    def weigh(value):
        return 500 + 2 * -value[0]

    def batches_of(trie, schema, entries):
        out, size = [], 0
        for key, value in trie.items():
            out.append(((*value[3:5], *value[5]) if entries else value[5]))
            size += len(key)
            if size > 8_000_000:
                yield _batch(schema, out)
                out, size = [], 0
        if out:
            yield _batch(schema, out)

    def collapse(batches):
        trie, schema = PatriciaTrie(1 << 62, weigh), None
        for batch in batches:
            schema = pa.schema([("size", pa.int64()), ("hash", pa.int64()), *batch.schema])
            for key, value in values(batch):
                trie.insert(key, value)
                if trie.size > limit:
                    yield from batches_of(trie, schema, True)
        if schema is not None:
            yield from batches_of(trie, schema, True)

    def owners(batches):
        trie, schema = PatriciaTrie(limit, weigh), None
        for batch in batches:
            batch = batch.select(names)
            schema = batch.schema
            for key, value in values(batch):
                trie.insert(key, value)
        if schema is not None:
            yield from batches_of(trie, schema, False)

    entries = plain.mapInArrow(giving_back(collapse), StructType([StructField("size", LongType()), StructField("hash", LongType()), *plain.schema.fields]))
    return entries.repartition(parts, "size", "hash").mapInArrow(giving_back(owners), plain.schema).toDF(*docs.columns)


def op4_patricia_exact_dedup(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir))


SQL = """
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
