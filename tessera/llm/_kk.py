"""Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np


def kk_states(states: list[np.ndarray], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Merge partial partitions into one; returns its ``k`` sums (descending) and, for each state, the final part of each of its slots.

    A state is an array of up to ``k`` non-negative sums (missing ones are zero). The two states with the largest spread are merged again
    and again, the one's largest sums with the other's smallest. Ties go to the state that came first, so the result is
    determined by the order of ``states``.
    """
    n = len(states)
    if n == 0:
        return np.zeros(k, np.int64), []
    sums: list[np.ndarray | None] = []
    perms: list[np.ndarray] = []  # of a leaf: its slots, in descending order of sums
    heap = []
    for i, s in enumerate(states):
        s = np.asarray(s, np.int64)
        order = np.argsort(-s, kind="stable")
        s = s[order]
        sums.append(s)
        perms.append(order)
        heap.append((-int(s[0] - (s[-1] if len(s) == k else 0)) if len(s) else 0, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        nx, ny = len(x), len(y)
        size = min(k, nx + ny)
        both = np.zeros(size, np.int64)
        both[:nx] = x
        both[size - ny :] += y[::-1]
        order = np.argsort(-both, kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        merges.append((a, b, rank[:nx], rank[size - ny :][::-1]))
        s = both[order]
        sums[a] = sums[b] = None
        sums.append(s)
        heapq.heappush(heap, (-int(s[0] - (s[-1] if size == k else 0)), len(sums) - 1))
    root = sums[-1] if merges else sums[0]
    place: list[np.ndarray | None] = [None] * (n + len(merges))
    place[n + len(merges) - 1] = np.arange(len(root))
    for j in range(len(merges) - 1, -1, -1):
        a, b, ra, rb = merges[j]
        up = place[n + j]
        place[a], place[b] = up[ra], up[rb]
        place[n + j] = None
    out = []
    for i in range(n):
        slots = np.empty(len(perms[i]), np.int64)
        slots[perms[i]] = place[i]
        out.append(slots)
    full = np.zeros(k, np.int64)
    full[: len(root)] = root
    return full, out


def kk_partition(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Part (0 to k-1) of each size, and the parts' sums (descending)."""
    sizes = np.asarray(sizes, np.int64)
    sums, slots = kk_states([sizes[i : i + 1] for i in range(len(sizes))], k)
    return np.fromiter((int(s[0]) for s in slots), np.int64, len(sizes)), sums
