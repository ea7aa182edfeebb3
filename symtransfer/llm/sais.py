"""Suffix arrays by induced sorting, with permuted common prefixes, on numpy arrays.

A text is an array of uint16 symbols in which 0 ends each string; these ends count as
distinct symbols, in order of place, so no common prefix crosses one. The induction runs
bucket by bucket: all suffixes that one bucket induces are dealt out by a stable radix
sort at once, so its cost is linear in the text and there is no loop over characters.
Names of leftmost-smaller substrings make a reduced text, in which names that occur once decide
every comparison, so what lies between two of them goes. The rest, each name written as two
digits, is a text of few symbols again and is sorted by recursion. Doubling of ranks sorts a small
rest, and one that two digits a name would not make shorter (long runs of one pattern).
"""

from __future__ import annotations

import numpy as np


def concat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols (byte + 1, and 0 after each string) and each string's start."""
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    starts = np.cumsum(sizes) - sizes
    text = raw.astype(np.uint16) + np.uint16(1)
    text[starts + sizes - 1] = 0
    return text, starts


def _packed(text: np.ndarray) -> tuple[np.ndarray, int]:
    """As many symbols from each place on as an integer holds (the first in the lowest bits), and a symbol's bits, 8 or 16."""
    bits = 8 if len(text) and text.max() < 256 else 16
    x, step = text.astype(np.uint64), 1
    while step * bits < 64:
        x[:-step] |= x[step:] << np.uint64(step * bits)
        step *= 2
    return x, bits


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(text)
    up = np.ones(n, bool)
    up[:-1] = text[:-1] < text[1:]
    place = np.full(n, n - 1, np.int32)
    place[:-1] = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), n - 1)
    return up[np.minimum.accumulate(place[::-1])[::-1]]


def _deal(chars: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by character, how many there are of each, and each one's place in that order less its character's first."""
    order = np.argsort(chars, kind="stable")
    counts = np.bincount(chars, minlength=size)
    return order, counts, np.arange(len(chars)) - np.repeat(np.cumsum(counts) - counts, counts)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from leftmost-smaller ones in the order given."""
    n = len(text)
    size = int(text.max()) + 1
    if size <= 256:  # in one byte they are dealt out in one pass
        text = text.astype(np.uint8)
    counts = np.bincount(text, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    large = np.bincount(text[~small], minlength=size)
    sa = np.full(n, -1, np.int32)
    seeds = lms[text[lms] != 0]
    order, seeded, number = _deal(text[seeds], size)
    sa[np.repeat(tails - seeded, seeded) + number] = seeds[order]
    sa[: len(ends)] = ends
    present = np.flatnonzero(counts).tolist()
    at = heads.copy()
    for c in present:
        parts = []  # what a suffix of this bucket has before it, and its character
        if c:
            seen = heads[c]
            while at[c] > seen:
                before = sa[seen : at[c]] - 1
                seen = at[c]
                before = before[before >= 0]
                chars = text[before]
                parts.append((before, chars))
                before = before[chars == c]
                sa[seen : seen + len(before)] = before
                at[c] += len(before)
            found = sa[tails[c] - seeded[c] : tails[c]]
        else:
            found = sa[: len(ends)]
        before = found - 1
        before = before[before >= 0]
        parts.append((before, text[before]))
        before, chars = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        up = chars > c
        before, chars = before[up], chars[up]
        if len(before):
            order, more, number = _deal(chars, size)
            sa[np.repeat(at, more) + number] = before[order]
            at += more
    at = tails.copy()
    for c in present[:0:-1]:
        parts = []
        seen = tails[c]
        while at[c] < seen:
            before = sa[at[c] : seen][::-1] - 1
            seen = at[c]
            before = before[before >= 0]
            chars = text[before]
            parts.append((before, chars))
            before = before[chars == c]
            sa[seen - len(before) : seen] = before[::-1]
            at[c] -= len(before)
        before = sa[heads[c] : heads[c] + large[c]][::-1] - 1
        before = before[before >= 0]
        parts.append((before, text[before]))
        before, chars = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        down = (chars < c) & (chars > 0)
        before, chars = before[down], chars[down]
        if len(before):
            order, more, number = _deal(chars, size)
            sa[np.repeat(at, more) - 1 - number] = before[order]
            at -= more
    return sa


def _same(packed: tuple[np.ndarray, int], a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` symbols are the same at a and at b."""
    packed, bits = packed
    most = 64 // bits
    same = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    masks = np.array([(1 << k * bits) - 1 for k in range(most + 1)], np.uint64)
    while len(live):
        left = size[live] - done
        differs = ((packed[a[live] + done] ^ packed[b[live] + done]) & masks[np.minimum(left, most)]) != 0
        same[live[differs]] = False
        live = live[~differs & (left > most)]
        done += most
    return same


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a reduced text, in which the last name is unique and smallest or an end.

    Suffixes that are told apart have their place; each round sorts the others alone.
    """
    n, h = len(names), 1
    order, place = np.arange(n), np.arange(n)
    rank = names.astype(np.int64)
    while len(place):
        left = order[place]
        key = rank[left] * (n + 1)
        more = left + h < n
        key[more] += rank[left[more] + h] + 1
        by = np.argsort(key)
        left, key = left[by], key[by]
        order[place] = left
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        # a rank is the place of the first suffix that is not told apart
        rank[left] = np.repeat(place[first[:-1]], np.diff(first))
        place = place[~(new[:-1] & new[1:])]
        h *= 2
    return order


#: A reduced text of so many names is sorted by doubling, in about half the time that a recursion takes.
SMALL = 1 << 19


def _reduced_order(names: np.ndarray, n: int) -> np.ndarray:
    """Order of the suffixes of the reduced text, in which the last name is unique, of a text of n symbols."""
    if len(names) <= SMALL:
        return _by_doubling(names)
    alone = np.bincount(names)[names] == 1
    kept = ~alone
    kept[1:] |= ~alone[:-1]
    kept = np.flatnonzero(kept)
    left = names[kept]
    if 8 * len(left) > 3 * n:
        return _by_doubling(names)
    base = int(np.ceil(np.sqrt(int(left.max()) + 1)))
    digits = np.zeros(2 * len(left) + 1, np.uint16)
    digits[0:-1:2] = left // base + 1
    digits[1:-1:2] = left % base + 1
    order = suffix_array(digits)
    order = kept[order[(order & 1 == 0) & (order < 2 * len(left))] >> 1]
    order = np.concatenate([order[~alone[order]], np.flatnonzero(alone)])
    return order[np.argsort(names[order], kind="stable")]


def suffix_array(text: np.ndarray, packed: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """text: uint16 symbols, the last one 0."""
    n = len(text)
    if n <= 1:
        return np.zeros(n, np.int32)
    packed = _packed(text) if packed is None else packed
    small = _smaller(text)
    leftmost = np.zeros(n, bool)
    leftmost[1:] = small[1:] & ~small[:-1]
    ends = np.flatnonzero(text == 0).astype(np.int32)
    lms = np.flatnonzero(leftmost).astype(np.int32)
    sa = _induce(text, small, lms, ends)
    if len(lms) < 2:
        return sa
    ordered = sa[leftmost[sa]]
    size = np.zeros(n, np.int32)
    size[lms[:-1]] = lms[1:] - lms[:-1] + 1
    size[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = np.zeros(len(a), bool)
    maybe = np.flatnonzero((size[a] == size[b]) & (text[a] == text[b]) & (text[a] != 0))
    same[maybe] = _same(packed, a[maybe], b[maybe], size[a[maybe]])
    if not same.any():
        return _induce(text, small, ordered, ends)
    names = np.zeros(n, np.int32)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return _induce(text, small, lms[_reduced_order(names[lms], n)], ends)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, packed: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """By place, the common prefix of a suffix with the one before it in order.

    Only irreducible values are found by comparing; each other one is its left neighbour's less one.
    """
    n = len(text)
    packed, bits = _packed(text) if packed is None else packed
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=np.int32)
    stop = np.minimum.accumulate(np.where(text == 0, place, n)[::-1])[::-1]
    own = np.ones(n, bool)
    own[1:] = (phi[1:] < 1) | (text[:-1] == 0) | (text[:-1] != text[phi[1:] - 1])
    own = np.flatnonzero(own & (phi >= 0))
    most = np.minimum(stop[own] - own, stop[phi[own]] - phi[own])
    got = np.zeros(len(own), np.int64)
    live, done = np.flatnonzero(most > 0), 0
    a, b = own[live], phi[own[live]].astype(np.int64)
    while len(live):
        x = packed[a + done] ^ packed[b + done]
        differs = x != 0
        # its lowest bit is in the first symbol that differs
        y = x[differs]
        got[live[differs]] = done + (np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)) // bits).astype(np.int64)
        done += 64 // bits
        same = np.flatnonzero(~differs)
        got[live[same]] = done
        same = same[most[live[same]] > done]
        live, a, b = live[same], a[same], b[same]
    value = np.zeros(n, np.int64)
    value[own] = np.minimum(got, most) + own
    return (np.maximum(np.maximum.accumulate(value) - place, 0)).astype(np.int32)
