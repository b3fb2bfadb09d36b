"""Voronoi cells of sets under the Jaccard distance, joined recursively and exactly in memory.

Pivots are members.  Every set goes to the cell of its nearest pivot, its home.  If x of cell
i and y of cell j are linked, d(y, p_i) <= d(x, p_i) + r <= d(x, p_j) + r <= d(y, p_j) + 2 r, so
y is copied into every cell whose pivot is at most 2 r farther than its home; it is
left out where even the cell's farthest home member is more than r nearer.  Sets far
from every pivot form an outer cell, into which those near its border are copied.  Cells are
split by new pivots in turn.  A cell that is small, or that the inequality can't part, is
compared exactly, tile by tile; pairs already in one component are settled.
"""

from __future__ import annotations

import numpy as np

#: Sets compared at once, pivots of a split, distance from which a set is outer.
TILE, PIVOTS, OUTER = 512, 8, 0.7
#: A split is taken if its cells hold at most so many times the members.
GROWTH = 1.4
#: Pairs of places expanded at once; shingles that make more pairs in a tile are multiplied as matrix columns, so many at once.
PLACES, DENSE, COLUMNS = 4_000_000, 2048, 4096


class Cells:
    """The sets of one window, numbered 0, 1, ..., with the links found so far."""

    def __init__(self, sets: list[np.ndarray], components: np.ndarray, percent: int):
        self.percent, self.radius = percent, 1 - percent / 100
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = times > 1  # a shingle of one set meets no other
        keep = often[code]
        self.code = (np.cumsum(often) - 1)[code[keep]]
        self.width = int(often.sum())
        self.owner = owner[keep]
        self.first = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        _, self.root = np.unique(components, return_inverse=True)  # roots are numbers of components
        self.parent = np.arange(len(sets) + 1)
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def _roots(self, members: np.ndarray) -> np.ndarray:
        names, at = np.unique(self.root[members], return_inverse=True)
        return np.array([self._find(x) for x in names.tolist()])[at]

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[k] with b[k]; keeps one link for each merge of two components."""
        roots = np.stack((self._roots(a), self._roots(b)))
        apart = np.flatnonzero(roots[0] != roots[1])
        _, once = np.unique(roots[:, apart], axis=1, return_index=True)
        for k in apart[once].tolist():
            x, y = self._find(roots[0][k]), self._find(roots[1][k])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((int(a[k]), int(b[k])))

    def _places(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, position in members) of all shared shingles of the members, by code."""
        counts = self.first[members + 1] - self.first[members]
        at = np.repeat(self.first[members] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        position = np.repeat(np.arange(len(members)), counts)
        order = np.argsort(self.code[at], kind="stable")
        return self.code[at][order], position[order]

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of all of ``a`` with all of ``b``."""
        (code_a, row_a), (code_b, row_b) = self._places(a), self._places(b)
        low, high = np.searchsorted(code_b, code_a), np.searchsorted(code_b, code_a, side="right")
        met = high > low
        code_a, row_a, low, times = code_a[met], row_a[met], low[met], (high - low)[met]
        out = np.zeros(len(a) * len(b), dtype=np.int64)
        if not len(code_a):
            return out.reshape(len(a), len(b))
        names, column, in_a = np.unique(code_a, return_inverse=True, return_counts=True)
        dense = in_a[column] * times > DENSE
        some = np.flatnonzero(~dense)
        ends = np.cumsum(times[some])
        k = 0
        while k < len(some):
            done = ends[k - 1] if k else 0
            end = max(k + 1, int(np.searchsorted(ends, done + PLACES, side="right")))
            part = some[k:end]
            reps = times[part]
            inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            out += np.bincount(np.repeat(row_a[part], reps) * len(b) + row_b[np.repeat(low[part], reps) + inner], minlength=len(out))
            k = end
        out = out.reshape(len(a), len(b))
        wide = np.unique(column[dense])
        if len(wide):
            place_b = np.searchsorted(names, code_b)
            place_b[place_b == len(names)] = 0
            hit_b = names[place_b] == code_b
            for k in range(0, len(wide), COLUMNS):
                names_at = np.full(len(names), -1)
                names_at[wide[k : k + COLUMNS]] = np.arange(len(wide[k : k + COLUMNS]))
                sides = []
                for rows, columns, size in ((row_a, names_at[column], len(a)), (row_b[hit_b], names_at[place_b[hit_b]], len(b))):
                    matrix = np.zeros((size, min(COLUMNS, len(wide) - k)), dtype=np.float32)
                    matrix[rows[columns >= 0], columns[columns >= 0]] = 1
                    sides.append(matrix)
                out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
        return out

    def _tile(self, a: np.ndarray, b: np.ndarray) -> None:
        shared = self.overlaps(a, b)
        i, j = np.nonzero(100 * shared >= self.percent * (self.sizes[a][:, None] + self.sizes[b][None] - shared))
        if len(i):
            self._link(a[i], b[j])

    def _tiles(self, members: np.ndarray) -> None:
        """All pairs, by size: of tiles whose sizes are too far apart none can be linked."""
        members = members[np.argsort(self.sizes[members], kind="stable")]
        parts = [members[k : k + TILE] for k in range(0, len(members), TILE)]
        for k, a in enumerate(parts):
            for b in parts[k:]:
                if 100 * self.sizes[a[-1]] < self.percent * self.sizes[b[0]]:
                    break
                if len(np.unique(self._roots(np.concatenate((a, b))))) > 1:
                    self._tile(a, b)

    def distances(self, members: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        counts = self.first[members + 1] - self.first[members]
        at = np.repeat(self.first[members] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        code, ends = self.code[at], np.cumsum(counts)
        out = np.empty((len(members), len(pivots)))
        for k, p in enumerate(pivots.tolist()):
            marks = np.zeros(self.width, dtype=np.int64)
            marks[self.code[self.first[p] : self.first[p + 1]]] = 1
            sums = np.concatenate(([0], np.cumsum(marks[code])))
            shared = sums[ends] - sums[ends - counts]
            linked = 100 * shared >= self.percent * (self.sizes[members] + self.sizes[p] - shared)
            self._link(members[linked], np.full(int(linked.sum()), p))
            out[:, k] = 1 - shared / (self.sizes[members] + self.sizes[p] - shared)
        return out

    def split(self, members: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
        """The members of each cell, copies included; the last is the outer cell."""
        d = self.distances(members, pivots)
        r = self.radius + 1e-9
        home, near = d.argmin(axis=1), d.min(axis=1)
        outer = near > OUTER
        cells = []
        for k in range(len(pivots)):
            own = (home == k) & ~outer
            if own.any():
                cells.append(members[own | (d[:, k] <= np.minimum(near + 2 * r, d[own, k].max() + r))])
        if outer.any():
            cells.append(members[near > OUTER - r])
        return cells

    def join(self, members: np.ndarray, seed: int = 0) -> None:
        """Finds the links that connect the members."""
        todo = [(members, seed)]
        while todo:
            members, seed = todo.pop()
            if len(np.unique(self._roots(members))) < 2:
                continue
            if len(members) <= TILE:
                self._tile(members, members)
                continue
            pivots = np.random.Generator(np.random.PCG64(seed)).choice(members, PIVOTS, replace=False)
            cells = self.split(members, pivots)
            if sum(map(len, cells)) <= GROWTH * len(members) and max(map(len, cells)) < len(members):
                todo += [(cell, seed + 1) for cell in cells]
            else:
                self._tiles(members)


def links(sets: list[np.ndarray], components: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links, as pairs of positions, that connect whatever components the linked ones of ``sets`` belong to.

    ``components`` names what is known to be connected; no link within a component is given.
    """
    cells = Cells(sets, components, percent)
    cells.join(np.arange(len(sets)))
    return cells.links


def partnered(lists: list[np.ndarray], sizes: np.ndarray, lasts: list[tuple[int, int]], components: np.ndarray, percent: int) -> np.ndarray:
    """Which sets, known by their rarest shingles (all up to the last listed, ``lasts`` its place in the order), may have a link with one of another component.

    Of two sets, all that both have up to the end of the list that ends first is in both
    lists, and beyond it that list's set has no more than what it doesn't list.
    """
    cells = Cells(lists, components, percent)
    ranks = {key: k for k, key in enumerate(sorted(set(lasts)))}
    place = np.array([ranks[key] for key in lasts])
    rest = sizes - cells.sizes
    keep = np.zeros(len(lists), dtype=bool)
    by_size = np.argsort(sizes, kind="stable")
    parts = [by_size[k : k + TILE] for k in range(0, len(lists), TILE)]
    for k, a in enumerate(parts):
        for b in parts[k:]:
            if 100 * sizes[a[-1]] < percent * sizes[b[0]]:
                break
            both = cells.overlaps(a, b)
            by_a, by_b = np.minimum(rest[a][:, None], sizes[b][None] - both), np.minimum(rest[b][None], sizes[a][:, None] - both)
            turn = place[a][:, None] - place[b][None]
            shared = both + np.where(turn < 0, by_a, np.where(turn > 0, by_b, np.maximum(by_a, by_b)))
            may = (100 * shared >= percent * (sizes[a][:, None] + sizes[b][None] - shared)) & (components[a][:, None] != components[b][None])
            may &= 100 * np.minimum(sizes[a][:, None], sizes[b][None]) >= percent * np.maximum(sizes[a][:, None], sizes[b][None])
            keep[a[may.any(axis=1)]] = True
            keep[b[may.any(axis=0)]] = True
    return keep
