"""Min-cost flow on a small bipartite graph with convex arc costs (driver side, a few hundred nodes)."""

from __future__ import annotations

import heapq
from collections import defaultdict


def route(capacity: list[int], quota: list[int], members: list[list[int]], copies: int) -> list[dict[int, list[int]]]:
    """Tokens from pattern p to source s for each copy: ``out[p][s][c]``, 0 for sources that are not in ``out[p]``.

    A pattern holds ``capacity[p]`` tokens and can give each of them ``copies`` times; copy c costs c a token (convex: a
    first use is free, each repetition dearer). Source s takes up to ``quota[s]`` from the patterns in which it is. The flow
    is as large as possible, and of these the cheapest: shortest augmenting paths with potentials.
    """
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, r: int, c: int) -> int:
        for x, y, q, w in ((a, b, r, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y), room.append(q), cost.append(w)
        return len(to) - 2

    for p in range(n):
        for c in range(copies):
            arc(start, p, capacity[p], c)
    links = {(p, s): arc(p, n + s, sum(capacity) * copies, 0) for p in range(n) for s in sorted(set(members[p]))}
    for s in range(m):
        arc(n + s, end, quota[s], 0)
    level = [0] * len(graph)
    while True:
        dist, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in graph[x]:
                if room[e] and (nd := d + cost[e] + level[x] - level[to[e]]) < dist.get(to[e], nd + 1):
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if end not in dist:
            break
        for x in range(len(graph)):
            level[x] += dist.get(x, dist[end])
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    out = [defaultdict(lambda: [0] * copies) for _ in range(n)]
    for p in range(n):  # fill the copies in order
        c, left = 0, capacity[p]
        for s in sorted(set(members[p])):
            flow = room[links[p, s] ^ 1]
            while flow:
                if not left:
                    c, left = c + 1, capacity[p]
                use = min(flow, left)
                out[p][s][c] += use
                flow, left = flow - use, left - use
    return out
