"""Removal of byte strings that an earlier document has, by suffix arrays.

Shards of shared_spans get suffix arrays by induced sorting (sais). Suffixes whose permuted
common prefixes reach the width are neighbours in order; the smallest identifier among such
neighbours is the owner of the window that starts each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import real_id
from .sais import _packed, concat, permuted_lcp, suffix_array
from .shared_spans import Chunk, Windows, per_row, shared_spans


def window_owners(segments: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each segment, and the smallest owner of each window's string."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    windows = np.maximum(sizes - width + 1, 0)
    if not len(segments):
        return windows, np.zeros(0, np.int64)
    text, starts = concat(segments)
    packed = _packed(text)
    order = suffix_array(text, packed)
    common = permuted_lcp(text, order, packed)[order]
    own = np.repeat(owners, sizes + 1)
    run = np.flatnonzero(common < width)
    least = np.minimum.reduceat(own[order], run)
    got = np.empty(len(text), np.int64)
    got[order] = np.repeat(least, np.diff(np.append(run, len(text))))
    places = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return windows, got[places]


SCHEMA = pa.schema([("id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])


def _finish(c: Chunk, removed: np.ndarray, ids: np.ndarray) -> pa.Table:
    n = c.rows
    size = np.diff(c.ends)
    row, start, stop = per_row(c, removed)
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    base = c.ends[row]
    left = np.concatenate([[0], np.cumsum(~removed)])[c.ends].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(c.buf[~removed].tobytes())])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x - base, pa.int64()))
    return pa.Table.from_arrays([pa.array(ids[c.row0 : c.row0 + n], pa.int64()), kept, pa.array(size, pa.int64()), lists(start), lists(stop)], schema=SCHEMA)


def remove_shared_bytes(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", k: int = 20, **sizes) -> DataFrame:
    """Every row's bytes without those that a `width`-byte string covers which also starts in a document with a smaller identifier.

    Returns id_col, kept (binary), n_bytes, spans (array of start and stop of removed runs, in bytes).
    Null texts count as empty; shorter texts than the width stay whole. A null identifier ranks last.
    Rows with one identifier don't affect each other. An empty table gives no rows; other columns are ignored.
    """
    out = shared_spans(docs, Windows(width, min(k, width), **sizes), window_owners, _finish, SCHEMA, "id long, kept binary, n_bytes long, starts array<long>, stops array<long>", id_col, text_col)
    return out.select(real_id().alias(id_col), "kept", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("stops").alias("stop")).alias("spans"))


def op6_suffix_array_dedup(spark, sf_dir):
    from .common import read

    out = remove_shared_bytes(read(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as hexadecimal text; those that an earlier document starts, in order, make runs where they touch or overlap.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS own FROM win) WHERE own < doc_id),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, run),
cut AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
left_ AS (SELECT d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, sum(b - a) AS n, count(*) AS spans, max(b) AS stop FROM d JOIN cut USING (r) GROUP BY d.r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)
"""
