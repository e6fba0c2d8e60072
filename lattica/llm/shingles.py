"""Distinct word-shingle sets of texts as sorted 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

import re

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
GAP = re.compile(rb"[\x20\x09-\x0D]")

_rng = np.random.default_rng(77003)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0xD6E8FEB86659FD93
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of bytes that end with white space."""
    gap = SPACE[data]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE[-1]), starts


def parts(view, most: int):
    """A long text in parts of about ``most`` bytes, cut at white space."""
    body, a = bytes(view), 0
    while a < len(body):
        m = GAP.search(body, a + most)
        b = m.end() if m else len(body)
        yield body[a:b]
        a = b


def sets_of(views: list, k: int, most: int = 2_000_000) -> list[np.ndarray]:
    """Each text's distinct shingles of k words; the whole sequence if it has fewer words.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Two different
    shingles of the corpus share a hash with a chance of about 2**-64 a pair. A text of more
    than ``most`` bytes must come alone; its words are hashed part by part.
    """
    if len(views) == 1 and len(views[0]) > most:
        words = np.concatenate([words_of(np.frombuffer(p.translate(LOWER) + b"\n", np.uint8))[0] for p in parts(views[0], most)])
        first, upto = np.zeros(1, np.int64), np.array([len(words)])
    else:
        words, starts = words_of(np.frombuffer(b"\n".join(bytes(v).translate(LOWER) for v in views) + b"\n", np.uint8))
        upto = np.searchsorted(starts, np.cumsum(np.array([len(v) for v in views], np.int64) + 1))
        first = np.concatenate([[0], upto[:-1]])
    if len(words) >= k:
        rolled = sum((words[i : len(words) - k + 1 + i] * PLACE[i] for i in range(k)), np.zeros(len(words) - k + 1, np.uint64))
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first.tolist(), upto.tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            short = sum((words[a + i : a + i + 1] * PLACE[i] for i in range(b - a)), np.zeros(1, np.uint64))
            out.append(mix(short + np.uint64(b - a) * PLACE[-2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ranges(views: list, most: int = 500_000):
    """Ranges of texts of about ``most`` bytes; a text of more is alone."""
    a = total = 0
    for i, v in enumerate(views):
        if len(v) >= most and i > a:
            yield a, i
            a, total = i, 0
        total += len(v)
        if total >= most:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(views):
        yield a, len(views)
