"""Suffix arrays of integer sequences in numpy, many short sequences at a time."""

from __future__ import annotations

import numpy as np


def suffix_order(keys: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """Starts of suffixes in order, by prefix doubling over those not told apart yet; the last key must be unique.

    levels: gets, for k = 0, 1, ..., numbers that are equal just for starts whose first 2**k keys are equal.
    """
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], np.diff(keys[order]) != 0])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    live = order[~(first & np.append(first[1:], True))]
    step = 1
    while len(live):
        if levels is not None:
            levels.append(rank.astype(np.int32))
        key = rank[live] * (len(keys) + 1) + rank[live + step]
        live = live[np.argsort(key, kind="stable")]
        old, nxt = rank[live], rank[live + step]
        head = np.concatenate([[True], np.diff(old) != 0])
        first = head | np.concatenate([[True], np.diff(nxt) != 0])
        index = np.arange(len(live))
        place = old + index - np.maximum.accumulate(np.where(head, index, 0))
        rank[live] = np.maximum.accumulate(np.where(first, place, 0))
        live = live[~(first & np.append(first[1:], True))]
        step *= 2
    order[rank] = np.arange(len(keys))
    return order


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix in order the length of what it shares with the one before (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    if not levels:
        return out
    pair = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pair - 1], order[pair]
    shared = np.zeros(len(pair), np.int64)
    for k in reversed(range(len(levels))):
        same = levels[k][a + shared] == levels[k][b + shared]
        shared[same] += 1 << k
    out[pair] = shared
    return out


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place the length of the longest string starting there that starts elsewhere too.

    symbols: 0 ends a sequence and is unlike every other 0; others are positive; the last is 0. Sequences of
    disjoint symbols share nothing, so many texts go in one call.
    """
    gaps = symbols == 0
    count = int(gaps.sum())
    levels: list[np.ndarray] = []
    order = suffix_order(np.where(gaps, np.cumsum(gaps) - 1, count + symbols), levels)
    shared = common_prefixes(order, levels)
    out = np.zeros(len(symbols), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """True for each of size places that lies in one of the spans."""
    edge = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(starts + lengths, minlength=size + 1)[: size + 1]
    return np.cumsum(edge[:-1]) > 0
