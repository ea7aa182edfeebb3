"""Quality rules: counts of words, symbols and repeated lines, and suffix-array repetition.

For repetition, a suffix array over words orders the places whose first words occur twice in their
document. Its longest-common-prefix intervals are the repeated substrings: an interval whose places
follow different words is a maximal repeat. The spans of maximal repeats of some length on are laid
over the document; the share of words under their union, and the longest of them, are limited.
Words and lines are told apart by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_WHITE, chunks, giving_back, id_and_text, interned, pair_numbers, read, real_id, utf8, words_of
from .sais import _by_doubling
from .shared_spans import _BYTE, _spans_hash

_CHAR = np.array([not IS_WHITE[b] and (b & 0xC0) != 0x80 for b in range(256)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeat_words: int = 50  # percent of words in repeated windows
    window: int = 3
    repeat_from: int = 8  # words; shorter repeats are ordinary prose
    most_covered: float = 0.3
    longest_share: float = 0.2  # longest repeat to words
    longest_from: int = 60  # words; shorter repeats pass whatever their share


def _count(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def innermost(text: np.ndarray, order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """By place, the depth of the innermost maximal interval of `least` or more that has it; 0 if none has.

    common: by rank, the common prefix with the rank before. An interval is a run of ranks that share `depth` symbols and
    no more; it is maximal if its places don't all follow the same symbol. Longer repeats from a place hide shorter ones,
    whose spans lie within theirs. Each rank is taken by the first maximal interval that closes around it.
    """
    ranks = np.flatnonzero(common >= least)
    got = np.zeros(len(order), np.int64)
    if not len(ranks):
        return got
    place = order.astype(np.int64)
    before = np.where(place > 0, text[place - 1], -1)
    changes = np.zeros(len(order), np.int64)
    changes[1:] = np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))
    cuts = np.flatnonzero(np.diff(ranks) > 1) + 1
    depths, changed = common.tolist(), changes.tolist()
    for part in np.split(ranks, cuts):
        first, last = int(part[0]) - 1, int(part[-1])
        open_: list[tuple[int, int]] = []  # depth and first rank of the intervals open, the innermost last
        free: list[int] = [first]
        for r in range(first + 1, last + 2):
            depth = depths[r] if r <= last else 0
            left = r - 1
            while open_ and open_[-1][0] > depth:
                d, left = open_.pop()
                if changed[r - 1] > changed[left]:
                    while free and free[-1] >= left:
                        got[place[free.pop()]] = d
            if depth and (not open_ or open_[-1][0] < depth):
                open_.append((depth, left))
            free.append(r)
    return got


def repeats(names: np.ndarray, run: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """From each place, the longest repeat and the longest maximal repeat of `least` or more, in symbols (0: none).

    names: dense from 0; run: numbers of stretches, sorted.
    """
    n = len(names)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.ones(n, bool)
    last[:-1] = run[1:] != run[:-1]
    place = np.arange(n) + np.cumsum(last) - last  # one end symbol after each stretch
    stops = place[last] + 1
    text = np.empty(n + len(stops), np.int64)
    text[place] = names + len(stops)
    text[stops] = np.arange(len(stops))
    _, dense = np.unique(text, return_inverse=True)
    order = _by_doubling(dense.astype(np.int64))
    m = len(text)
    phi = np.full(m, -1, np.int64)
    phi[order[1:]] = order[:-1]
    own = np.ones(m, bool)
    own[1:] = (phi[1:] < 1) | (text[:-1] != text[phi[1:] - 1])
    own = np.flatnonzero(own & (phi >= 0))
    got = np.zeros(len(own), np.int64)
    live = np.arange(len(own))
    depth = 0
    while len(live):  # ends are distinct, so a comparison stops before the text does
        live = live[text[own[live] + depth] == text[phi[own[live]] + depth]]
        depth += 1
        got[live] = depth
    value = np.zeros(m, np.int64)
    value[own] = got + own
    common = np.maximum(np.maximum.accumulate(value) - np.arange(m), 0)
    best = common.copy()
    best[order[:-1]] = np.maximum(best[order[:-1]], common[order[1:]])
    return best[place], innermost(text, order, common[order], least)[place]


SCHEMA = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_covered"))])


def measures(buf: np.ndarray, ends: np.ndarray, rules: Rules) -> list[np.ndarray]:
    """The columns of SCHEMA after the identifier, for each row."""
    n = len(ends) - 1
    starts, stops, row = words_of(buf, ends)
    n_words = np.bincount(row, minlength=n)
    cuts = np.zeros(len(buf) + 1, bool)
    cuts[ends] = True
    cuts[1:] |= (buf == 10)
    line_starts = np.flatnonzero(cuts[:-1])
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~IS_WHITE[buf], out=letters[1:])
    line_stops = np.append(line_starts[1:], len(buf))
    some = letters[line_stops] > letters[line_starts]
    line_starts, line_stops = line_starts[some], line_stops[some]
    line_stops = line_stops - (buf[line_stops - 1] == 10)
    symbols = _BYTE[buf]
    line_row = np.searchsorted(ends, line_starts, "right") - 1
    kinds = pair_numbers(line_row, interned(buf, line_starts, line_stops, _spans_hash(symbols, line_starts, line_stops)))
    new = np.zeros(len(kinds), bool)
    new[np.unique(kinds, return_index=True)[1]] = True
    n_dup = np.bincount(line_row[~new], minlength=n)
    n_repeat, longest, covered = (np.zeros(n, np.int64) for _ in range(3))
    w = rules.window
    if len(starts) >= w:
        words = interned(buf, starts, stops, _spans_hash(symbols, starts, stops))
        at = np.flatnonzero(row[: len(row) - w + 1] == row[w - 1 :])
        names = row[at]
        for i in range(w):
            names = pair_numbers(names, words[at + i])
        often = np.bincount(names)[names] > 1 if len(at) else np.zeros(0, bool)
        at, names = at[often], names[often]
        under = lambda a, size: np.cumsum(np.bincount(a, minlength=len(row) + 1) - np.bincount(a + size, minlength=len(row) + 1))[:-1] > 0
        if len(at):
            n_repeat = np.bincount(row[under(at, w)], minlength=n)
            run = np.cumsum(np.r_[False, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
            size, maximal = repeats(np.unique(names, return_inverse=True)[1], run, max(1, rules.repeat_from - w + 1))
            np.maximum.at(longest, row[at], size + w - 1)
            long = maximal > 0
            if long.any():
                covered = np.bincount(row[under(at[long], maximal[long] + w - 1)], minlength=n)
    return [n_words, _count(_CHAR[buf], ends), _count(_SYMBOL[buf], ends), n_dup, n_repeat, longest, covered]


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row: id_col, the measures, base_failed, kept (and the columns `keep`).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier one),
    n_repeat_words (words in windows found twice or more), longest_repeat and n_covered (words). base_failed: too few
    words or too many of them in repeated windows. kept: not so, and neither the words under maximal repeats nor the
    longest repeat go beyond the rules. Null is a text without words. Rows may repeat; an empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col, keep)
    names = [f"_{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), *(f"{f.name} long" for f in SCHEMA)])

    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch["text"])
            parts = [measures(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], rules) for a, b in chunks(ends, 1 << 20)]
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), batch["id"], *map(pa.array, columns)], names=[*names, *SCHEMA.names])

    out = rows.mapInArrow(giving_back(run), schema)
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_words * F.col("n_words"))
    covered = F.col("n_covered") > rules.most_covered * F.col("n_words")
    longest = (F.col("longest_repeat") >= rules.longest_from) & (F.col("longest_repeat") > rules.longest_share * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~covered & ~longest)
    kept = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]
    return out.select(*kept, *[real_id().alias(id_col)] * (id_col not in keep), *SCHEMA.names[1:], "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that quality() keeps, with all their columns; other rows go."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    rows = docs.toDF(*names)

    def run(batches):
        for batch in batches:
            ends, buf = utf8(batch[text])
            keep = [verdict(measures(buf[ends[a] : ends[b]], ends[a : b + 1] - ends[a], rules), rules) for a, b in chunks(ends, 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return rows.mapInArrow(giving_back(run), rows.schema).toDF(*docs.columns)


def verdict(m: list[np.ndarray], rules: Rules) -> np.ndarray:
    n_words, _, _, _, n_repeat, longest, covered = m
    base = (n_words < rules.least_words) | (100 * n_repeat > rules.most_repeat_words * n_words)
    return ~base & ~(covered > rules.most_covered * n_words) & ~((longest >= rules.longest_from) & (longest > rules.longest_share * n_words))


def op1_suffix_array_quality(spark, sf_dir):
    return quality(read(spark, sf_dir)).drop("longest_repeat")


#: By windows: words under repeats of 8 words or more are those under 8-word windows found twice, and a longest repeat
#: beyond both limits is a window of so many words found twice.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
grams AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (3), (8)) AS s(k))),
twice AS (SELECT r, k, i, lead(i) OVER (PARTITION BY r, k ORDER BY i) AS j FROM (SELECT r, k, i, count(*) OVER (PARTITION BY r, k, g) AS n FROM grams) WHERE n > 1),
under AS (SELECT r, k, sum(least(k, coalesce(j - i, k))) AS n FROM twice GROUP BY r, k),
m AS (SELECT d.r, doc_id, len(w) AS n_words, w, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_covered
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN under a ON a.r = d.r AND a.k = 3 LEFT JOIN under b ON b.r = d.r AND b.k = 8),
long AS (SELECT DISTINCT r FROM (SELECT m.r, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g FROM (SELECT *, greatest(60, CAST(floor(0.2 * n_words) AS BIGINT) + 1) AS size FROM m) m
  JOIN twice ON twice.r = m.r AND k = 8 WHERE n_covered >= size AND i + size - 1 <= n_words) GROUP BY r, g HAVING count(*) > 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= 0.3 * n_words AND long.r IS NULL AS kept
FROM m LEFT JOIN long ON long.r = m.r
"""
