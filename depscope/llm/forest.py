"""Union-find over array indexes, fed with blocks of links."""

from __future__ import annotations

import numpy as np


class Forest:
    """Sets of 0..n-1 under union; ``root`` gives the representative of every element."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] with b[i] for every i. Links inside a set cost one comparison each."""
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], 1), axis=0)
        up = {}

        def find(x):
            top = x
            while up.get(top, top) != top:
                top = up[top]
            while up.get(x, x) != x:
                up[x], x = top, up[x]
            return top

        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        moved = self.root.copy()
        for x in up:
            moved[x] = find(x)
        self.root = moved[self.root]
