"""Recursive graph bisection: documents that share terms come next to each other.

A set of documents is halved so that the terms' neighbours lie close: in each
round every document's gain of changing sides is taken from the terms' degrees on
both sides, and the documents with the highest gains are swapped in pairs while
that pays. The halves are halved in turn.
"""

from __future__ import annotations

import numpy as np

FEATURES = 1 << 14  # terms fold to so many features; folding costs order, never results
ROUNDS = 6


def features(terms: np.ndarray) -> np.ndarray:
    return (terms.astype(np.uint64) >> np.uint64(50)).astype(np.uint16)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    degree = np.maximum(degree, 0)
    return degree * np.log2(n / (degree + 1))


def halves(begins: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each document (its features are ``flat[begins[i]:begins[i + 1]]``) goes right, and both sides' degrees.

    Documents need at least one feature each. Both sides get as many documents, the right one more if the number is odd.
    """
    n = len(begins) - 1
    side = np.arange(n) >= n // 2
    sizes = np.diff(begins)
    n_left, n_right = max(1, n // 2), n - n // 2
    for _ in range(ROUNDS):
        over = np.repeat(side, sizes)
        left, right = (np.bincount(flat[x], minlength=FEATURES) for x in (~over, over))
        now = _cost(left, n_left) + _cost(right, n_right)
        to_right = now - _cost(left - 1, n_left) - _cost(right + 1, n_right)
        to_left = now - _cost(left + 1, n_left) - _cost(right - 1, n_right)
        gains = np.add.reduceat(np.where(over, to_left[flat], to_right[flat]), begins[:-1])
        ours, theirs = (x[np.argsort(-gains[x], kind="stable")] for x in (np.flatnonzero(~side), np.flatnonzero(side)))
        k = min(len(ours), len(theirs))
        pays = int(np.argmin(np.append(gains[ours[:k]] + gains[theirs[:k]] > 0, False)))
        if not pays:
            break
        side[ours[:pays]], side[theirs[:pays]] = True, False
    over = np.repeat(side, sizes)
    return side, np.bincount(flat[~over], minlength=FEATURES), np.bincount(flat[over], minlength=FEATURES)


def _taken(begins: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(begins)[rows]
    new = np.concatenate([[0], np.cumsum(sizes)])
    return new, flat[np.arange(new[-1]) + np.repeat(begins[rows] - new[:-1], sizes)]


def ordered(begins: np.ndarray, flat: np.ndarray, most: int) -> np.ndarray:
    """The documents' numbers in the order of a bisection down to runs of at most ``most``."""
    n = len(begins) - 1
    if n <= most:
        return np.arange(n)
    side, _, _ = halves(begins, flat)
    parts = [np.flatnonzero(~side), np.flatnonzero(side)]
    return np.concatenate([rows[ordered(*_taken(begins, flat, rows), most)] for rows in parts])


class Tree:
    """The upper halvings, learnt on a sample; other documents go to the side whose terms are theirs."""

    def __init__(self, sample: list[np.ndarray], depth: int):
        self.depth = depth
        self.weights = np.zeros((max(1, (1 << depth) - 1), FEATURES), np.float16)
        sample = [x for x in sample if len(x)]
        begins = np.concatenate([[0], np.cumsum([len(x) for x in sample], dtype=np.int64)]).astype(np.int64)
        flat = np.concatenate(sample) if sample else np.zeros(0, np.uint16)
        self._grow(0, begins, flat, depth)

    def _grow(self, node: int, begins: np.ndarray, flat: np.ndarray, depth: int) -> None:
        n = len(begins) - 1
        if not depth or n < 2:
            return
        side, left, right = halves(begins, flat)
        self.weights[node] = np.log2((right + 1) / (n - n // 2)) - np.log2((left + 1) / (n // 2))
        for k, rows in enumerate((np.flatnonzero(~side), np.flatnonzero(side))):
            self._grow(2 * node + 1 + k, *_taken(begins, flat, rows), depth - 1)

    def leaves(self, begins: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The leaf of each document, from 0; documents need at least one feature each."""
        node = np.zeros(len(begins) - 1, np.int64)
        sizes = np.diff(begins)
        for _ in range(self.depth if len(node) else 0):
            weights = self.weights[np.repeat(node, sizes), flat].astype(np.float32)
            node = 2 * node + 1 + (np.add.reduceat(weights, begins[:-1]) > 0)
        return node - ((1 << self.depth) - 1)
