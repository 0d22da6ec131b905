"""Suffix array by grouping on Lyndon prefixes, and common prefixes.

First phase: suffixes are grouped by first symbol; groups are taken from the
largest down.  Each member points to its previous smaller suffix (the
nearest one to the left in a lower group); suffixes pointed to are one
Lyndon word longer than known so far, and move to new groups just above
their old one, ordered by how many members point to them.  Second phase:
suffixes are emitted in ascending order; an emitted suffix lets the suffixes
that end their Lyndon prefix right before it take the next place of their
group, along the same pointers.  Nothing is renamed or sorted recursively.
"""
from __future__ import annotations


class _Group:
    __slots__ = ("members", "down", "up", "at")

    def __init__(self, members: list[int]):
        self.members = members
        self.down: _Group | None = None
        self.up: _Group | None = None
        self.at = 0


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of ``s``, whose last symbol must be smaller than
    all others."""
    n = len(s)
    if n == 0:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        first.setdefault(c, []).append(i)
    own: list[_Group] = [None] * n  # type: ignore[list-item]
    below = None
    for c in sorted(first):
        g = _Group(first[c])
        g.down = below
        if below is not None:
            below.up = g
        for i in g.members:
            own[i] = g
        below = g
    top = below
    done = bytearray(n)
    prev = [-1] * n
    g = top
    while g is not None:
        members = [i for i in g.members if own[i] is g]
        members.sort()
        g.members = members
        for i in members:
            done[i] = 1
        hits: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            moved: dict[tuple[int, int], list[int]] = {}
            old: dict[int, _Group] = {}
            for j, c in hits.items():
                h = own[j]
                old[id(h)] = h
                moved.setdefault((id(h), c), []).append(j)
            # fewer pointers, smaller word: insert the largest first
            for (at, _), js in sorted(moved.items(), key=lambda x: -x[0][1]):
                h = old[at]
                new = _Group(js)
                new.down, new.up = h, h.up
                if h.up is not None:
                    h.up.down = new
                h.up = new
                for j in js:
                    own[j] = new
        if g.down is None:
            bottom = g
        g = g.down
    at = 0
    g = bottom
    while g is not None:
        g.at = at
        at += len(g.members)
        g = g.up
    sa = [-1] * n
    sa[0] = n - 1
    own[n - 1].at = 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        i = sa[k] - 1
        while i >= 0 and not placed[i]:
            g = own[i]
            sa[g.at] = i
            g.at += 1
            placed[i] = 1
            i = prev[i]
    return sa


def common_prefixes(s: list[int], sa: list[int], stop: int) -> list[int]:
    """``out[k]``: symbols that the suffixes ``sa[k-1]`` and ``sa[k]`` share
    before either reaches a symbol of at most ``stop`` (``out[0]`` is 0)."""
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(sa):
        rank[i] = k
    out = [0] * n
    l = 0
    for i in range(n):
        k = rank[i]
        if k == 0:
            l = 0
            continue
        j = sa[k - 1]
        while s[i + l] == s[j + l] and s[i + l] > stop:
            l += 1
        out[k] = l
        if l:
            l -= 1
    return out
