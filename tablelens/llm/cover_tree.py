"""Cover trees over unit vectors and their dual traversal, in numpy.

A tree covers one block of vectors.  Levels halve the radius: a node's points
are split by a net (every point within half the radius of a chosen centre,
the node's own centre first).  Every node keeps its true covering radius.
"""

from __future__ import annotations

import numpy as np

SLACK = 1e-9
LEAF = 0.02


class Tree:
    """points: unit vectors in node order; place: their original rows; node
    arrays: centre, start, end, radius, child (first), children (number)."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        distance = np.sqrt(np.maximum(2.0 - 2.0 * (unit @ unit.T), 0.0))
        first = int(distance.max(axis=1).argmin()) if n else 0
        centre, members, level = [first], [np.arange(n)], [1.0]
        radius, child, children = [], [], []
        at = 0
        while at < len(centre):
            points, c, r = members[at], centre[at], level[at]
            far = distance[c, points]
            reach = float(far.max()) if len(points) else 0.0
            radius.append(reach)
            child.append(len(centre))
            if len(points) > 1 and reach > LEAF:
                while r >= reach:
                    r /= 2
                left, heart, made = points, c, 0
                while len(left):
                    near = distance[heart, left] <= r
                    near |= left == heart
                    centre.append(heart)
                    members.append(left[near])
                    level.append(r)
                    made += 1
                    left = left[~near]
                    heart = int(left[0]) if len(left) else -1
                children.append(made)
            else:
                children.append(0)
            at += 1
        # points in the order of the leaves; every node is a run of them
        size = np.array([len(m) for m in members], np.int64)
        start = np.zeros(len(centre), np.int64)
        for i, (k, m) in enumerate(zip(child, children)):
            if m:
                start[k:k + m] = start[i] + np.concatenate(([0], np.cumsum(size[k:k + m])[:-1]))
        order = np.zeros(n, np.int64)
        for i, m in enumerate(children):
            if not m:
                order[start[i]:start[i] + size[i]] = members[i]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.points, self.place = unit[order], order
        self.centre, self.start, self.end = back[np.array(centre, np.int64)] if n else np.zeros(0, int), start, start + size
        self.radius = np.array(radius) + SLACK
        self.child, self.children = np.array(child, np.int64), np.array(children, np.int64)


def _spread(first: np.ndarray, count: np.ndarray):
    """Row numbers repeated ``count`` times, and first, first + 1, ... of each."""
    row = np.repeat(np.arange(len(first)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, first[row] + step


def _centre_distance(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    ui, ii = np.unique(a.centre[i], return_inverse=True)
    uj, jj = np.unique(b.centre[j], return_inverse=True)
    if len(ui) * len(uj) <= 4 * len(i) + 1024:
        cosine = (a.points[ui] @ b.points[uj].T)[ii, jj]
    else:
        cosine = np.einsum("ij,ij->i", a.points[a.centre[i]], b.points[b.centre[j]])
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def linked_points(a: Tree, b: Tree, least: float):
    """All pairs (point of a, point of b) with cosine >= ``least``, in slices."""
    tau = float(np.sqrt(2.0 - 2.0 * least))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    if not len(a.points) or not len(b.points):
        return
    while len(i):
        d = _centre_distance(a, b, i, j)
        keep = d - a.radius[i] - b.radius[j] <= tau + SLACK
        i, j, d = i[keep], j[keep], d[keep]
        sure = d + a.radius[i] + b.radius[j] <= tau - SLACK
        end = ~sure & (a.children[i] == 0) & (b.children[j] == 0)
        for these, known in ((sure, True), (end, False)):
            x, y = i[these], j[these]
            wide = (a.end[x] - a.start[x]) * (b.end[y] - b.start[y])
            cut = np.searchsorted(np.cumsum(wide), np.arange(0, wide.sum() + 1, 1 << 18), side="left")
            for lo, hi in zip(cut, [*cut[1:], len(x)]):
                row, p = _spread(a.start[x[lo:hi]], (a.end - a.start)[x[lo:hi]])
                row2, q = _spread(b.start[y[lo:hi]][row], (b.end - b.start)[y[lo:hi]][row])
                p = p[row2]
                if not known and len(p):
                    cosine = np.einsum("ij,ij->i", a.points[p], b.points[q])
                    p, q = p[cosine >= least], q[cosine >= least]
                if len(p):
                    yield p, q
        rest = ~sure & ~end
        i, j = i[rest], j[rest]
        # open the node that reaches further
        open_a = (a.children[i] > 0) & ((b.children[j] == 0) | (a.radius[i] >= b.radius[j]))
        row, x = _spread(a.child[i[open_a]], a.children[i[open_a]])
        row2, y = _spread(b.child[j[~open_a]], b.children[j[~open_a]])
        i, j = np.concatenate((x, i[~open_a][row2])), np.concatenate((j[open_a][row], y))


def join(a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, least: float, same: bool):
    """Weighted numbers of links of a's and b's rows, and a component number
    for each (a's rows first); ``same`` joins a tree with itself."""
    na, nb = len(a.points), len(b.points)
    counts = np.zeros(na + nb, np.int64)
    label = np.arange(na + nb)
    if same:
        label[na:] = label[:nb]
    wa, wb = weight_a[a.place], weight_b[b.place]
    for p, q in linked_points(a, b, least):
        if same:
            other = p != q
            p, q = p[other], q[other]
        np.add.at(counts, p, wb[q])
        if not same:
            np.add.at(counts, na + q, wa[p])
        q = q if same else na + q
        while True:
            low = np.minimum(label[p], label[q])
            if (label[p] == low).all() and (label[q] == low).all():
                break
            np.minimum.at(label, label[p], low)
            np.minimum.at(label, label[q], low)
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    while not (label[label] == label).all():
        label = label[label]
    return counts, label
