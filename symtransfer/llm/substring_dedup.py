"""Removal of word windows that an earlier document has, by suffix automata.

Each shard of shared_spans takes its distinct segments in the order of their smallest identifiers.
A segment streams through the automaton of the reference segments before it for matching
statistics: at each word, the longest suffix that the automaton has, shortened to the window's
width. Windows found there belong to an earlier document; a segment with windows that are not
found becomes a reference itself. The automata grow with the corpus, so segments are routed to
their shard's automaton rather than every automaton broadcast to all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import real_id
from .shared_spans import Chunk, Windows, per_row, shared_spans


class SuffixAutomaton:
    """Of several sequences, added in ascending order of their owners. link, length and owner by state; owner: of the first sequence that has its strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [0]

    def add(self, sequence: list[int], owner: int) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self._clone(last, q, c)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                owners.append(owner)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        r = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        owners.append(owners[q])
        link.append(link[q])
        link[q] = r
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = r
            p = link[p]
        return r

    def owners_of_windows(self, sequence: list[int], width: int) -> list[int | None]:
        """By matching statistics: the owner of each window of `width` symbols (None: the automaton doesn't have it)."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        state, size, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            q = nxt[state].get(c)
            if q is not None:
                state, size = q, size + 1
                while length[link[state]] >= width:
                    state = link[state]
                    size = length[state]
            if i >= width - 1:
                out.append(owners[state] if size >= width else None)
        return out


def window_owners(segments: list[bytes], owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each segment (words one space apart), and the smallest owner of each window."""
    number: dict[bytes, int] = {}
    windows = np.zeros(len(segments), np.int64)
    least: list[list[int]] = [[]] * len(segments)
    references = SuffixAutomaton()
    for i in np.argsort(owners, kind="stable").tolist():
        own = int(owners[i])
        sequence = [number.setdefault(w, len(number)) for w in segments[i].split(b" ")]
        found = references.owners_of_windows(sequence, width)
        if None in found:
            references.add(sequence, own)
        windows[i], least[i] = len(found), [own if x is None else x for x in found]
    return windows, np.array([x for w in least for x in w], np.int64)


SCHEMA = pa.schema([("id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])


def _finish(c: Chunk, removed: np.ndarray, ids: np.ndarray) -> pa.Table:
    n = c.rows
    first = np.searchsorted(c.row, np.arange(n + 1))
    row, start, stop = per_row(c, removed)
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x - first[row], pa.int64()))
    left = np.flatnonzero(~removed)
    size = c.stops[left] - c.starts[left]
    edge = np.zeros(len(c.buf) + 1, np.int32)
    edge[c.starts[left]] += 1
    edge[c.stops[left]] -= 1
    letters = c.buf[np.cumsum(edge[:-1]) > 0]
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    stops = np.cumsum(size + 1)
    gaps = np.ones(len(out), bool)
    gaps[stops - 1] = False
    out[gaps] = letters
    raw, ends = out.tobytes(), np.concatenate([[0], stops])
    cut = np.searchsorted(c.row[left], np.arange(n + 1))
    a, b = ends[cut[:-1]].tolist(), ends[cut[1:]].tolist()
    kept = [raw[i : max(i, j - 1)].decode("utf-8", "surrogatepass") for i, j in zip(a, b, strict=True)]
    return pa.Table.from_arrays([pa.array(ids[c.row0 : c.row0 + n], pa.int64()), pa.array(kept, pa.string()), pa.array(np.diff(first), pa.int64()), lists(start), lists(stop)], schema=SCHEMA)


def remove_shared_windows(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", k: int = 5, **sizes) -> DataFrame:
    """Every row's words without those that a window covers whose words also start in a document with a smaller identifier.

    Returns id_col, kept (the words left, one space apart), n_words, spans (array of start and stop of removed runs, in words).
    Null texts have no words. A null identifier ranks last; rows with one identifier don't affect each other.
    An empty table gives no rows; other columns are ignored.
    """
    sizes = {"shard_mb": 0.6} | sizes
    out = shared_spans(docs, Windows(width, min(k, width), words=True, **sizes), window_owners, _finish, SCHEMA, "id long, kept string, n_words long, starts array<long>, stops array<long>", id_col, text_col)
    return out.select(real_id().alias(id_col), "kept", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("stops").alias("stop")).alias("spans"))


def op10_suffix_automaton_dedup(spark, sf_dir):
    from .common import read

    out = remove_shared_windows(read(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows of 13 words that an earlier document starts, in order, make runs where they touch or overlap.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS own FROM win) WHERE own < doc_id),
runs AS (SELECT r, min(i) AS a, max(i) + 13 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 13 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY r, run),
cut AS (SELECT r, a, b, lag(b, 1, 1) OVER (PARTITION BY r ORDER BY a) AS before FROM runs),
left_ AS (SELECT d.r, flatten(list(list_slice(w, before, a - 1) ORDER BY a)) AS kept, sum(b - a) AS n, max(b) AS stop FROM d JOIN cut USING (r) GROUP BY d.r)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_concat(coalesce(kept, []), list_slice(w, coalesce(stop, 1), len(w))), ' '), '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)
"""
