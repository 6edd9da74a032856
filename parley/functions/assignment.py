"""Optimal assignment on small matrices, and word alignment."""

from __future__ import annotations

from collections import Counter
from math import isqrt

import numpy as np


def solve(cost: np.ndarray) -> list[int]:
    """The column of each row in a square matrix at least total cost (Kuhn-Munkres with potentials).

    Among equal totals the rows' columns are the smallest in order.
    """
    best = _least(cost)
    n, total = len(cost), sum(cost[i, j] for i, j in enumerate(best))
    fixed: list[int] = []
    for i in range(n):  # the least column that still allows the total
        for j in range(best[i]):
            if j in fixed:
                continue
            rows, cols = list(range(i + 1, n)), [c for c in range(n) if c not in fixed and c != j]
            rest = _least(cost[np.ix_(rows, cols)]) if rows else []
            if sum(cost[r, c] for r, c in enumerate([*fixed, j])) + sum(cost[rows[a], cols[b]] for a, b in enumerate(rest)) <= total + 1e-9:
                best = [*fixed, j, *(cols[b] for b in rest)]
                break
        fixed.append(best[i])
    return best


def _least(cost: np.ndarray) -> list[int]:
    n = len(cost)
    row_p, col_p = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(n):
        slack, back = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, bool)
        row, last = start, -1
        while True:
            reduced = cost[row] - row_p[row] - col_p
            better = ~done & (reduced < slack)
            slack[better], back[better] = reduced[better], last
            col = int(np.where(done, np.inf, slack).argmin())
            delta = slack[col]
            row_p[start] += delta
            seen = np.flatnonzero(done)
            row_p[owner[seen]] += delta
            col_p[seen] -= delta
            slack[~done] -= delta
            done[col] = True
            if owner[col] < 0:
                break
            row, last = owner[col], col
        while col >= 0:  # flip the path
            before = back[col]
            owner[col] = start if before < 0 else owner[before]
            col = before
    out = [0] * n
    for c, r in enumerate(owner):
        out[r] = c
    return out


def best_pairs(matrix: np.ndarray, maximize: bool) -> tuple[float, list[tuple[int, int]]]:
    """Total and pairs of the best assignment of a rectangular matrix; min(m, n) pairs, zero weights included."""
    m, n = matrix.shape
    k = max(m, n)
    square = np.zeros((k, k))
    square[:m, :n] = -matrix if maximize else matrix
    if not maximize and m != n:  # unmatched rows or columns cost nothing here; pad a cost matrix before the call
        square[m:, :] = square[:, n:] = 0
    pairs = [(i, j) for i, j in enumerate(solve(square)) if i < m and j < n]
    return float(sum(matrix[i, j] for i, j in pairs)), pairs


def _column(same: int, up: int, down: int, every: int) -> tuple[int, int, int]:
    """The next column of an edit table as bits of whole numbers, one for each row.

    ``up`` and ``down`` mark the rows that lie one above and one below the row before them, ``same`` the rows whose word
    is the column's. The third result marks the rows that equal their neighbour up and to the left.
    """
    level = ((((same & up) + up) ^ up) | same | down) & every
    more, less = down | (every ^ (level | up)), level & up
    more, less = (more << 1 | 1) & every, less << 1 & every
    return less | (every ^ (level | more)), more & level, level


def _contained(ref: list, hyp: list) -> list[tuple[int, int]] | None:
    """The position pairs of the shorter side's last place within the longer one, if that has all of it in order."""
    swap = len(hyp) > len(ref)
    long, short = (hyp, ref) if swap else (ref, hyp)
    out, at = [], len(short)
    for i in range(len(long) - 1, -1, -1):
        if long[i] == short[at - 1]:
            at -= 1
            out.append((at, i) if swap else (i, at))
            if not at:
                return out[::-1]
    return None


def align(ref: list, hyp: list) -> list[tuple[int, int]]:
    """Equal and substituted position pairs of one minimal alignment.

    Traced from the end; where several moves are minimal, a match or substitution goes before a deletion, and a
    deletion before an insertion. A column of the edit table is held as bits, so it is made in a few operations on whole
    numbers. Only every sqrt(m)-th column is kept, and those between two of them are made again when the trace gets
    there, so memory is n times sqrt(m) bits. Where one side has all of the other in order, no other move than leaving out
    the rest is minimal, and the trace is the last such place of each word: no table is needed.
    """
    n, m = len(ref), len(hyp)
    if not n or not m:
        return []
    if found := _contained(ref, hyp):
        return found
    where: dict = {}
    for i, w in enumerate(ref):
        where[w] = where.get(w, 0) | 1 << i
    same = [where.get(w, 0) for w in hyp]
    every, stride = (1 << n) - 1, max(1, isqrt(m))
    up, down, kept = every, 0, []
    for j in range(m):
        if j % stride == 0:
            kept.append((up, down))
        up, down, _ = _column(same[j], up, down, every)
    out, i, j, size = [], n, m, (n + 7) // 8
    while i and j:
        first = (j - 1) // stride * stride
        (up, down), made = kept[first // stride], []
        for c in range(first, j):
            up, down, level = _column(same[c], up, down, every)
            made.append((up.to_bytes(size, "little"), level.to_bytes(size, "little")))
        while i and j > first:
            ups, levels = made[j - 1 - first]
            at, bit = (i - 1) >> 3, 1 << ((i - 1) & 7)
            if ref[i - 1] == hyp[j - 1] or not levels[at] & bit:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif ups[at] & bit:
                i -= 1
            else:
                j -= 1
    return out[::-1]


def matched_speakers(ref: list, hyp: list, ref_speakers: list, hyp_speakers: list) -> dict[tuple, int]:
    """Aligned words by reference and hypothesis speaker; the speakers are those of each word."""
    pairs = zip(range(len(ref)), range(len(ref)), strict=True) if ref == hyp else align(ref, hyp)
    return Counter((ref_speakers[i], hyp_speakers[j]) for i, j in pairs)
