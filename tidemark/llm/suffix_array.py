"""Suffix arrays in numpy: refinement of sorted groups, common prefixes, and binary search in another array."""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts as they do; `data` has eight bytes of padding."""
    out = np.zeros(len(at), np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def dense(changed: np.ndarray) -> np.ndarray:
    """For sorted values, each one's group as the place of the group's first member."""
    starts = np.where(changed, np.arange(len(changed)), 0)
    return np.maximum.accumulate(starts)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes of `data` sorted by their first `depth` bytes at least, equal ones share a rank.

    Larsson and Sadakane's refinement: suffixes are grouped by their first bytes; each round sorts only the groups
    that hold more than one suffix, by the rank of the suffix as many bytes further on, so that the compared length
    doubles; it stops when all groups are single or the depth is reached. The end sorts first.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    first = words_at(padded, np.arange(n))
    order = np.argsort(first, kind="stable")
    sorted_words = first[order]
    changed = np.ones(n, bool)
    changed[1:] = sorted_words[1:] != sorted_words[:-1]
    # Zero bytes and the padding look alike: suffixes shorter than a word come first, each in a group of its own.
    tail = np.arange(n - 1, max(n - WORD, -1), -1)
    if n and not data.all():
        is_tail = np.zeros(n, bool)
        is_tail[tail] = True
        key = np.lexsort((np.where(is_tail, n - np.arange(n), n + 1), first))
        order = key
        sorted_words, lengths = first[order], np.where(is_tail, n - np.arange(n), n + 1)[order]
        changed[1:] = (sorted_words[1:] != sorted_words[:-1]) | (lengths[1:] != lengths[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = dense(changed)
    length = WORD
    while length < depth:
        heads = np.flatnonzero(changed)
        sizes = np.diff(np.append(heads, n))
        loose = np.repeat(sizes > 1, sizes)
        if not loose.any():
            break
        at = np.flatnonzero(loose)
        members = order[at]
        further = members + length
        next_rank = np.where(further < n, rank[np.minimum(further, n - 1)], -1)
        group = rank[members]
        by = np.argsort(group * (n + 1) + next_rank + 1, kind="stable")
        order[at] = members[by]
        g, x = group[by], next_rank[by]
        inner = np.ones(len(at), bool)
        inner[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        changed[at] = inner
        rank[order] = dense(changed)
        length *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` with the one before it (0 for the first).

    Kasai's observation, in text order: if the suffixes one byte earlier are neighbours too and begin alike, the
    common prefix is one shorter than theirs. Only the others are compared, word by word. `order` need not be sorted
    beyond a depth.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    shifted = np.zeros(n, bool)
    shifted[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1) & (data[:-1] == data[before[1:] - 1])
    start = np.flatnonzero(~shifted)
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    found = np.zeros(len(start), np.int64)
    going = np.flatnonzero(before[start] >= 0)
    while len(going):
        i, j = start[going] + found[going], before[start[going]] + found[going]
        ok = (i + WORD <= n) & (j + WORD <= n)
        same = np.zeros(len(going), bool)
        same[ok] = words_at(padded, i[ok]) == words_at(padded, j[ok])
        found[going[same]] += WORD
        for k in going[~same & ~ok]:  # near the end, at most once for each of the last suffixes
            while max(start[k], before[start[k]]) + found[k] < n and data[start[k] + found[k]] == data[before[start[k]] + found[k]]:
                found[k] += 1
        left = going[~same & ok]
        if len(left):
            a, b = words_at(padded, start[left] + found[left]), words_at(padded, before[start[left]] + found[left])
            found[left] += leading_zero_bytes(a ^ b)
        going = going[same]
    by_place = found[np.cumsum(~shifted) - 1] - (at - start[np.cumsum(~shifted) - 1])
    return by_place[order]


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(WORD - 1):
        out += (x >> np.uint64(8 * (WORD - 1 - k))) == 0
    return out


def compare(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for each pair of strings of `length` bytes (a multiple of eight), which lie within a and b."""
    out = np.zeros(len(at_a), np.int8)
    going = np.arange(len(at_a))
    for k in range(0, length, WORD):
        x, y = words_at(a, at_a[going] + k), words_at(b, at_b[going] + k)
        differ = x != y
        out[going[differ]] = np.where(x[differ] < y[differ], -1, 1)
        going = going[~differ]
        if not len(going):
            break
    return out


def find(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, sorted_b: np.ndarray, length: int) -> np.ndarray:
    """For each string of `a`, the index in `sorted_b` (places in b, in the strings' order) of an equal one, or -1: binary search, all at once."""
    low, high = np.zeros(len(at_a), np.int64), np.full(len(at_a), len(sorted_b), np.int64)
    found = np.full(len(at_a), -1, np.int64)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        sign = compare(a, at_a[going], b, sorted_b[middle], length)
        found[going[sign == 0]] = middle[sign == 0]
        low[going[sign > 0]] = middle[sign > 0] + 1
        high[going[sign < 0]] = middle[sign < 0]
        going = going[(sign != 0)]
        going = going[low[going] < high[going]]
    return found
