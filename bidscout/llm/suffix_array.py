"""Suffix arrays by Lyndon grouping, linear in the text once its symbols are numbered.

A suffix is its longest Lyndon prefix followed by the next smaller suffix. So
suffixes with one Lyndon prefix form a group, groups are ordered by their
prefixes, and members of a group by their next smaller suffixes.

Phase 1 finds the groups. It starts with one group for each symbol and takes
groups from the highest down. A group that is taken is final; the suffix before
each of its members that is in no higher group (found by previous-smaller
pointers) gets its prefix extended by that of the group, as often as the group
follows it, and moves to a new group above its old one. Members stay in text
order by themselves: pointers from later members lead to no earlier places.

Phase 2 emits the order: from the smallest suffix on, each suffix puts those
whose next smaller suffix it is at the next free place of their groups. Nothing
is renamed or recurred into.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of text's suffixes in order. The last symbol must be smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    symbols = sorted(set(text))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(symbols)
    size = [len(m) for m in members]  # how many members are still in a group
    below = list(range(-1, len(symbols) - 1))  # the next lower group
    above = list(range(1, len(symbols) + 1))
    above[-1] = -1
    taken = [False] * len(symbols)
    before = [-1] * n  # previous-smaller pointers of suffixes in taken groups

    g = len(symbols) - 1
    while g >= 0:
        taken[g] = True
        follows: dict[int, int] = {}
        for i in members[g]:
            if group[i] == g:
                p = i - 1
                while p >= 0 and taken[group[p]]:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    follows[p] = follows.get(p, 0) + 1
        if len(follows) == 1:
            (p, times), = follows.items()
            if size[group[p]] == 1:  # alone in its group, which it needn't leave
                length[group[p]] += times * length[g]
                g = below[g]
                continue
        # of one old group those that are followed more often are higher: they are dealt out
        # from the most often followed down, each time right above the old group
        dealt: list[list[int]] = [[] for _ in range(max(follows.values(), default=0) + 1)]
        for p, times in follows.items():
            dealt[times].append(p)
        for times in range(len(dealt) - 1, 0, -1):
            new_of: dict[int, int] = {}
            for p in dealt[times]:
                old = group[p]
                new = new_of.get(old)
                if new is None:
                    new_of[old] = new = len(length)
                    length.append(length[old] + times * length[g])
                    size.append(0)
                    taken.append(False)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                members[new].append(p)
                size[new] += 1
                size[old] -= 1
                group[p] = new
        g = below[g]

    # the places of each group, from the lowest group up
    place = [0] * len(length)
    g, total = 0, 0
    while g >= 0:
        place[g] = total
        total += size[g]
        g = above[g]
    # those whose next smaller suffix starts at j: first[j], then along after[]
    first, after = [-1] * (n + 1), [-1] * n
    for i in range(n):
        j = i + length[group[i]]
        after[i] = first[j]
        first[j] = i
    out = [0] * n
    out[0] = n - 1
    for k in range(n):
        i = first[out[k]]
        while i >= 0:
            x = group[i]
            out[place[x]] = i
            place[x] += 1
            i = after[i]
    return out
