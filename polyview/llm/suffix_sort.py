"""Deep-shallow sorting of byte strings, and matches among strings that surround a shared anchor."""

from __future__ import annotations

from bisect import bisect_left


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """Order of strings by a trie that keeps, at each node, only the depth of a branching and its bytes."""
    at = lambda s, d: s[d] if d < len(s) else -1
    root: list | int = ids[0]
    for i in ids[1:]:
        s, node = strings[i], root
        while not isinstance(node, int):  # blindly to some leaf
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
            if isinstance(node, tuple):
                node = node[0]
        other = strings[node]
        d = lcp(s, other)
        parent, key, node = None, None, root
        while not isinstance(node, int) and not isinstance(node, tuple) and node[0] < d:
            parent, key = node, at(s, node[0])
            node = node[1][key]
        if not isinstance(node, (int, tuple)) and node[0] == d and at(s, d) not in node[1]:
            node[1][at(s, d)] = (i,)
            continue
        if isinstance(node, (int, tuple)) and len(s) == len(other) == d:  # an equal string: one leaf holds both
            leaf = (*(node if isinstance(node, tuple) else (node,)), i)
            if parent is None:
                root = [d, {-1: leaf}] if isinstance(root, int) else leaf
            else:
                parent[1][key] = leaf
            continue
        if not isinstance(node, (int, tuple)) and node[0] == d:
            old = node[1][at(s, d)]
            node[1][at(s, d)] = (*(old if isinstance(old, tuple) else (old,)), i)
            continue
        branch = [d, {at(other, d): (node,) if isinstance(node, int) else node, at(s, d): (i,)}]
        if parent is None:
            root = branch
        else:
            parent[1][key] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        elif isinstance(node, tuple):
            out.extend(node)
        else:
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
    return out


def deep_shallow(strings: list[bytes], start: int = 0, shallow: int = 64) -> list[int]:
    """Indexes of strings in order: multikey quicksort down to depth ``shallow``, blind tries below.

    The strings share their first ``start`` bytes.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), start)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            out.extend(ids)
        elif depth >= shallow:
            out.extend(blind_trie(strings, ids))
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in ids]
            pivot = sorted(byte)[len(byte) // 2]
            less = [i for i, b in zip(ids, byte, strict=True) if b < pivot]
            same = [i for i, b in zip(ids, byte, strict=True) if b == pivot]
            more = [i for i, b in zip(ids, byte, strict=True) if b > pivot]
            stack.append((more, depth))
            stack.append((same, shallow if pivot == -1 else depth + 1))
            stack.append((less, depth))
    return out


def matches(left: list[bytes], right: list[bytes], length: int, start: int = 0) -> list[list[tuple[int, int]]]:
    """For each string, (l, r) such that the l bytes before its anchor and the r bytes from it on, l + r >= length, stand around another anchor too.

    ``left`` holds the bytes before the anchor in reverse.  Strings are sorted by ``right``; falling
    common prefixes join neighbours into groups that share r bytes, each kept in order of ``left``,
    and the smaller group is put into the larger.  A string's best l in a group is that of a neighbour.
    """
    n = len(left)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = deep_shallow(right, start)
    joins = sorted(((lcp(right[a], right[b]), k) for k, (a, b) in enumerate(zip(order, order[1:], strict=False))), reverse=True)
    group = list(range(n))  # of places in order
    held: list[list[tuple[bytes, int]]] = [[(left[i], i)] for i in order]

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for r, k in joins:
        a, b = find(k), find(k + 1)
        big, small = (a, b) if len(held[a]) >= len(held[b]) else (b, a)
        rows = held[big]
        for item in held[small]:
            at = bisect_left(rows, item)
            for near in rows[max(at - 1, 0) : at + 1]:
                both = lcp(item[0], near[0])
                if both + r >= length:
                    for i in (item[1], near[1]):
                        if not found[i] or found[i][-1][0] < both:
                            found[i].append((both, r))
            rows.insert(at, item)
        held[small] = []
        group[small] = big
    return found
