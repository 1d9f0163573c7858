"""Karmarkar-Karp multiway differencing.

Every item starts as a partial partition of ``k`` windows with one occupied
window.  The two partial partitions with the largest spread are merged with
opposing order, the fullest window of one over the emptiest window of the
other, until one partition is left.  Sums are kept relative to the smallest
window, so the largest spread is the largest last entry.
"""

from __future__ import annotations

import heapq

import numpy as np


def difference(sizes, k: int) -> np.ndarray:
    """Window index in ``0..k-1`` of every item.

    Ties are broken by item order, so equal input gives equal output.  No item
    returns an empty array; ``k`` of 1 puts all items into window 0.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    n = len(sizes)
    if n == 0 or k <= 1:
        return np.zeros(n, dtype=np.int64)
    heap = []
    for i in range(n):
        sums = np.zeros(k, dtype=np.int64)
        sums[-1] = sizes[i]
        heap.append((-int(sizes[i]), i, sums))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        total = left + right[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order] - total[order[0]]
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(total[-1]), n + len(merges) - 1, total))
    label: dict[int, np.ndarray] = {n + len(merges) - 1 if merges else 0: np.arange(k)}
    for m in range(len(merges) - 1, -1, -1):
        a, b, order = merges[m]
        mine = label.pop(n + m)
        by_pair = np.empty(k, dtype=np.int64)
        by_pair[order] = mine
        label[a], label[b] = by_pair, by_pair[::-1]
    return np.array([label[i][-1] for i in range(n)], dtype=np.int64)


def pack(sizes, capacity: int) -> np.ndarray:
    """Window of every item so that no window exceeds ``capacity``.

    Starts from the least possible number of windows and adds windows while a
    differenced partition still overflows.  Sizes must not exceed ``capacity``.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("an item is larger than a window")
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        most = int(np.bincount(window, weights=sizes, minlength=k).max()) if len(sizes) else 0
        if most <= capacity:
            return window
        k += max(1, (most - capacity) * k // (4 * capacity))
