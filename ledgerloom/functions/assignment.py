"""Maximum-weight bipartite assignment for small score matrices."""

from __future__ import annotations

from collections.abc import Sequence


def assign(scores: Sequence[Sequence[float]]) -> list[int]:
    """Column given to each row, or -1, so that the sum of positive scores is greatest.

    Shortest augmenting paths with potentials, O(rows^2 * columns).  Scores of zero or
    less mean "may not be matched".  Among equal sums the assignment is the one the
    given row and column order leads to.
    """
    n = len(scores)
    m = len(scores[0]) if n else 0
    if not n or not m:
        return [-1] * n
    if n > m:
        back = assign([[scores[i][j] for i in range(n)] for j in range(m)])
        out = [-1] * n
        for j, i in enumerate(back):
            if i >= 0:
                out[i] = j
        return out
    cost = [[-max(0.0, s) for s in row] for row in scores]
    row_pot, col_pot = [0.0] * n, [0.0] * m
    owner = [-1] * m  # row that holds each column
    for start in range(n):
        dist, prev, done = [float("inf")] * m, [-1] * m, [False] * m
        row, last, reach = start, -1, 0.0
        while True:
            best = -1
            for j in range(m):
                if not done[j]:
                    d = reach + cost[row][j] - row_pot[row] - col_pot[j]
                    if d < dist[j]:
                        dist[j], prev[j] = d, last
                    if best < 0 or dist[j] < dist[best]:
                        best = j
            done[best], reach, last = True, dist[best], best
            if owner[best] < 0:
                break
            row = owner[best]
        row_pot[start] += reach
        for j in range(m):
            if done[j] and j != last:
                row_pot[owner[j]] += reach - dist[j]
                col_pot[j] -= reach - dist[j]
        j = last
        while j >= 0:
            p = prev[j]
            owner[j] = owner[p] if p >= 0 else start
            j = p
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0 and scores[i][j] > 0:
            out[i] = j
    return out
