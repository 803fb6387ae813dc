"""Longest common subsequences and edit distances."""

from __future__ import annotations

import numpy as np


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions of a longest common subsequence, by the bit-parallel recurrence; of its rows one in a square root of their number is kept and those between are made again when the path comes by."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    # lines that the other side does not have are in no common subsequence
    there = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    xs, ys = ([k for k in range(lo, len(s) - hi) if s[k] in there] for s in (a, b))
    where: dict[int, int] = {}
    for j, k in enumerate(ys):
        where[b[k]] = where.get(b[k], 0) | 1 << j
    full = (1 << len(ys)) - 1

    def after(row: int, i: int) -> int:
        u = row & where[a[xs[i]]]
        return ((row + u) | (row - u)) & full

    every = max(64, int(len(xs) ** 0.5))
    row, marks = full, []
    for i in range(len(xs)):
        if i % every == 0:
            marks.append(row)
        row = after(row, i)
    rows: list[int] = []  # rows[k] stands before item k of the stretch that begins at ``start``
    start = len(xs)

    def before(i: int) -> int:
        """The row before item i; only rows of one stretch between two marks are held."""
        nonlocal rows, start
        if not start <= i < start + len(rows):
            start = i // every * every
            rows = [marks[i // every]]
            for k in range(start, min(start + every, len(xs)) - 1):
                rows.append(after(rows[-1], k))
        return rows[i - start]

    i, j, pairs, now = len(xs), len(ys), [], row
    while i and j:
        if now >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        now = before(i)
        if now >> (j - 1) & 1:
            j -= 1
            pairs.append((xs[i], ys[j]))
    pairs.reverse()
    one = [*range(lo), *(p for p, _ in pairs), *range(len(a) - hi, len(a))]
    two = [*range(lo), *(q for _, q in pairs), *range(len(b) - hi, len(b))]
    return one, two


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Two texts without their longest common prefix and, of what is left, suffix; each found by bisection."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    return a[: len(a) - lo], b[: len(b) - lo]


def edit_distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance, or some number over limit if it is over: what both ends share is left out, the rest is
    one bit-parallel recurrence (a bit a character of a, all of a column at once)."""
    a, b = trimmed(a, b)
    if not a or not b or abs(len(a) - len(b)) > limit:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b), 0, -1), b, strict=True):
        if distance - left > limit:  # each column that is left takes away one at most
            return distance - left
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more, less = more << 1 & full | 1, less << 1 & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return distance


def likely_distance(a: str, b: str) -> int:
    """The cost of the edit that keeps a longest common subsequence of words and rewrites what lies between: never under the Levenshtein distance."""
    x, y = a.split(" "), b.split(" ")
    words: dict[str, int] = {}
    one, two = common([words.setdefault(w, len(words)) for w in x], [words.setdefault(w, len(words)) for w in y])
    cost = i = j = 0
    for p, q in zip([*one, len(x)], [*two, len(y)], strict=True):
        cost += max(sum(map(len, x[i:p])) + p - i, sum(map(len, y[j:q])) + q - j)
        i, j = p + 1, q + 1
    return cost


#: Up to this length the recurrence is quicker than a look at the words.
BRIEF = 64


def within(pairs: list[tuple[str, str]], limits: list[int]) -> np.ndarray:
    """Whether the Levenshtein distance of each pair is at most its limit."""
    out = np.zeros(len(pairs), dtype=bool)
    for n, ((a, b), limit) in enumerate(zip(pairs, limits, strict=True)):
        if abs(len(a) - len(b)) > limit:
            continue
        a, b = trimmed(a, b) if len(a) <= len(b) else trimmed(b, a)
        out[n] = len(b) <= limit or len(b) > BRIEF and likely_distance(a, b) <= limit or edit_distance(a, b, limit) <= limit
    return out
