"""Suffix grouping in the order of Lyndon prefixes, without recursion or renaming.

Phase 1 puts suffixes into groups that share their longest Lyndon prefix, ordered
by it. It goes through the groups from the largest down. For a suffix i of the
current group, whose prefix ends before j = i + its length, the pointer prev(i)
is the nearest suffix to the left that is in a smaller group; that one's prefix is
extended by the current group's. Suffixes whose prefix is extended by the same
number of copies of the current group's prefix move together into a new group
directly after their old one. Phase 2 emits the suffixes: from the smallest
suffix on, each emitted suffix j puts the suffixes that j's chain of pointers
reaches at the front of what is left of their groups.

The last symbol of the input must be smaller than all others.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in their order. ``s`` ends with its unique smallest symbol."""
    n = len(s)
    if n <= 1:
        return list(range(n))
    group_of, members = _lyndon_groups(s)
    return _emit(s, group_of, members)


def _lyndon_groups(s: list[int]) -> tuple[list[int], list[list[int]]]:
    """Per suffix the rank of its group, and the groups' members in ascending order of the groups.

    The longest Lyndon prefix at i ends where the next smaller suffix starts, so a
    suffix's prefix is its symbol followed by the prefixes of the larger suffixes
    that it takes in, the nearest first. Taking in is done from the largest group
    down; within one step, those that take in the group once more than others split
    off into a larger group.
    """
    n = len(s)
    # groups in a doubly linked list by rank; a group is a list of suffixes sharing its current prefix
    buckets: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        buckets.setdefault(x, []).append(i)
    order = sorted(buckets)
    members = [buckets[x] for x in order]
    below = list(range(-1, len(order) - 1))
    above = [*range(1, len(order)), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    done = [False] * len(order)
    size = [len(own) for own in members]  # a group's list may still hold suffixes that have moved on
    # left[i]: nearest position to the left whose suffix isn't finished in a larger or equal group
    left = list(range(-1, n - 1))
    g = len(order) - 1
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]
        done[g] = True
        # nearest unfinished suffix to the left, over finished ones with shortened pointers
        takes: dict[int, int] = {}
        for i in sorted(own):
            p = left[i]
            while p >= 0 and done[group[p]]:
                p = left[p]
            left[i] = p
            if p >= 0:
                takes[p] = takes.get(p, 0) + 1
        # a suffix takes in only what directly follows its prefix, so the copies counted here are consecutive
        split: dict[int, dict[int, list[int]]] = {}
        for p, k in takes.items():
            split.setdefault(group[p], {}).setdefault(k, []).append(p)
        for h, by_count in split.items():
            moved = sum(map(len, by_count.values()))
            counts = sorted(by_count)
            if moved == size[h] and len(counts) == 1:
                continue
            size[h] -= moved
            at = h
            for k in counts:
                new = len(members)
                members.append(by_count[k])
                size.append(len(by_count[k]))
                done.append(False)
                below.append(at)
                above.append(above[at])
                if above[at] >= 0:
                    below[above[at]] = new
                above[at] = new
                for p in by_count[k]:
                    group[p] = new
                at = new
        g = below[g]
        while g >= 0 and not size[g]:
            g = below[g]
    # rank the groups
    first = next(i for i in range(len(members)) if below[i] < 0)
    rank, ordered, at = {}, [], first
    while at >= 0:
        if size[at]:
            rank[at] = len(ordered)
            ordered.append(members[at])
        at = above[at]
    return [rank[x] for x in group], ordered


def _emit(s: list[int], group: list[int], members: list[list[int]]) -> list[int]:
    n = len(s)
    start, total = [], 0
    for own in members:
        start.append(total)
        total += len(own)
    # prev smaller: nearest to the left in a smaller group
    prev = [-1] * n
    for i in range(n):
        p = i - 1
        while p >= 0 and group[p] >= group[i]:
            p = prev[p]
        prev[i] = p
    sa, placed = [-1] * n, [False] * n
    sa[0], placed[n - 1] = n - 1, True
    start[group[n - 1]] += 1
    for i in range(n):
        p = sa[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            sa[start[g]] = p
            start[g] += 1
            placed[p] = True
            p = prev[p]
    return sa


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in ``sa`` with the one before it (0 for the first)."""
    n = len(s)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = sa[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out
