"""Brute-force versions the operators are tested against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def grams(text: str | None, n: int) -> frozenset:
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    w = WORD.findall((text or "").encode().translate(lower))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False))


def components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept), by comparing all pairs."""
    ids = [i for i, _ in rows]
    sets = {i: grams(t, n) for i, t in rows}
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool, str]]:
    """doc_id -> (keep_id, group_size, kept, sha)."""
    norm = {i: BLANK.sub(" ", t or "") for i, t in rows}
    groups: dict[str, list[int]] = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def nearest(vectors: dict[int, np.ndarray], query: int, k: int) -> list[tuple[int, float]]:
    q = vectors[query]
    score = {i: float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))) for i, v in vectors.items() if i != query}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
