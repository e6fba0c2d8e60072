"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

STEP = 8  # bytes compared at once by the shallow sort
SHALLOW = 128


def matrix_of(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` bytes, padded with zero bytes; lengths are kept by the caller."""
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def multikey(words: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders rows within their groups by the first ``depth`` words.

    Multikey quicksort, all segments at once: each segment of rows that agree so far takes
    its middle row's word as pivot and splits into less, equal and greater; the equal part
    moves to its next word. Returns the order and the segment number of each place; rows
    of one segment agree in every compared word.
    """
    n = len(groups)
    order = np.argsort(groups, kind="stable")
    seg = np.zeros(n, np.int64)
    if n:
        seg[1:] = np.cumsum(groups[order][1:] != groups[order][:-1])
    at = np.zeros(n, np.int64)  # the word each place's segment compares next
    done = np.zeros(n, bool)
    while True:
        size = np.bincount(seg, minlength=int(seg[-1]) + 1 if n else 1)
        live = np.nonzero((size[seg] > 1) & (at < depth) & ~done)[0] if n else np.zeros(0, int)
        if not len(live):
            return order, seg
        s = seg[live]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        starts = np.nonzero(first)[0]
        part = np.cumsum(first) - 1
        value = words[order[live], at[live]]
        pivot = value[starts + np.diff(np.append(starts, len(live))) // 2]
        side = np.where(value < pivot[part], 0, np.where(value == pivot[part], 1, 2))
        moved = np.argsort(part * 3 + side, kind="stable")
        order[live] = order[live][moved]
        at[live] = at[live][moved] + (side[moved] == 1)
        key = np.zeros(n, np.int64)
        key[live] = side[moved]
        cut = np.zeros(n, bool)
        cut[1:] = (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])
        seg = np.cumsum(cut)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def blind_trie(strings: list[bytes]) -> list[int]:
    """Positions of equally long strings in sorted order.

    Inner nodes hold only the depth at which their strings part and one byte for each
    child. A search compares no skipped bytes; one comparison with the leaf it reaches
    then gives the true depth, where the string branches off.
    """
    root: list = [None, {}, [0]]  # depth (None: leaf), children, members of a leaf
    for i in range(1, len(strings)):
        s, node, path = strings[i], root, []
        while node[0] is not None:
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        near = strings[node[2][0]]
        if s == near:
            node[2].append(i)
            continue
        depth = common(s, near)
        leaf = [None, {}, [i]]
        k = len(path)
        while k and path[k - 1][0] >= depth:
            k -= 1
        below = path[k] if k < len(path) else node
        if below[0] == depth:
            below[1][s[depth]] = leaf
            continue
        above = [depth, {near[depth]: below, s[depth]: leaf}, None]
        if k:
            path[k - 1][1][s[path[k - 1][0]]] = above
        else:
            root = above
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[2]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def sort(mat: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows by group, then bytes: shallow by multikey quicksort, deep by blind tries."""
    width = mat.shape[1]
    padded = np.ascontiguousarray(np.pad(mat, ((0, 0), (0, -width % STEP))))
    words = padded.view(">u8").astype(np.uint64)
    order, seg = multikey(words, groups, min(shallow // STEP, words.shape[1]))
    if shallow < width and len(order):
        size = np.bincount(seg)
        first = np.searchsorted(seg, np.arange(len(size)))
        for j in np.nonzero(size > 1)[0]:
            rows = order[first[j] : first[j] + size[j]]
            order[first[j] : first[j] + size[j]] = rows[blind_trie([mat[r, shallow:].tobytes() for r in rows])]
    return order


def neighbours(mat: np.ndarray, lengths: np.ndarray, groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each place with the one before; -1 where a group starts."""
    out = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 8192):
        a, b = order[i - 1 : i - 1 + 8192][: len(order) - i], order[i : i + 8192]
        a = a[: len(b)]
        differ = mat[a] != mat[b]
        lcp = np.where(differ.any(1), differ.argmax(1), mat.shape[1])
        out[i : i + len(b)] = np.where(groups[a] == groups[b], np.minimum(lcp, np.minimum(lengths[a], lengths[b])), -1)
    return out
