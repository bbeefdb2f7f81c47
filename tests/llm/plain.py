"""Brute-force answers in plain Python, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, width: int = 5) -> set[tuple]:
    found = words((text or "").translate(_LOWER))
    if not found:
        return set()
    if len(found) < width:
        return {tuple(found)}
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}


def link_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (size of the set, smallest id reachable by links of 0.8 or more)."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        common: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}
