"""Suffix order by linear grouping over Lyndon prefixes.

Suffixes are grouped by their first symbol; groups are then taken in
descending order.  A group taken is final: its members share their longest
Lyndon prefix, and each member's previous smaller suffix is found by following
the pointers of the suffixes between.  The groups of these previous smaller
suffixes are split by how many members point to them, more pointers later.
After that the order is emitted from the groups in one ascending pass: every
suffix puts its predecessor, and the predecessor's chain of previous smaller
suffixes, next into their groups.  No alphabet is renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """(first place of each suffix's group, previous smaller suffix or -1)."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n
    ends = [0] * (n + 1)
    first = 0
    for i, s in enumerate(order):
        place[s] = i
        if i and text[s] != text[order[i - 1]]:
            ends[first] = i
            first = i
        group[s] = first
    ends[first] = n
    smaller = [-1] * n
    top = n
    while top > 0:
        low = group[order[top - 1]]
        if top - low == 1:
            s = order[low]
            p = s - 1
            while p >= 0 and group[p] > low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                q = group[p]
                end = ends[q] - 1
                if end > q:  # p leaves for a group of its own behind the others
                    x, at = order[end], place[p]
                    order[at], place[x] = x, at
                    order[end], place[p] = p, end
                    ends[q] = end
                    ends[end] = end + 1
                    group[p] = end
        else:
            pointers: dict[int, int] = {}
            for s in sorted(order[low:top]):
                p = s - 1
                while p >= 0 and group[p] > low:
                    p = smaller[p]
                if p >= 0 and group[p] == low:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    pointers[p] = pointers.get(p, 0) + 1
            classes: dict[tuple[int, int], list[int]] = {}
            for p, k in pointers.items():
                classes.setdefault((k, group[p]), []).append(p)
            for k, q in sorted(classes, reverse=True):
                moved = classes[k, q]
                end = ends[q]
                start = end - len(moved)
                if start == q:
                    continue
                for p in moved:
                    end -= 1
                    x, at = order[end], place[p]
                    order[at], place[x] = x, at
                    order[end], place[p] = p, end
                    group[p] = start
                ends[start] = ends[q]
                ends[q] = start
        top = low
    return group, smaller


def suffix_order(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a suffix that is
    a prefix of another comes first."""
    n = len(text)
    group, smaller = lyndon_groups(text)
    following = list(range(n))
    out = [0] * n
    done = [False] * n
    j = n - 1
    for i in range(-1, n):
        if i >= 0:
            j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[following[g]] = j
            following[g] += 1
            done[j] = True
            j = smaller[j]
    return out
