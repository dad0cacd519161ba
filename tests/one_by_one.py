"""Distances and texts in plain loops, to hold the vectorised ones and the expressions against."""

from __future__ import annotations

import re

from matchloom.functions.strings import DIVISIVES, ENCLOSERS, INTERNALS, MINOR_WORDS, TERMINALS


def osa(a: str, b: str, most: int | None = None) -> int:
    """Restricted edit distance: swaps of neighbours cost one, and nothing is edited twice.

    With ``most``, only cells within that many steps of the diagonal are filled, and any distance above it is given as most + 1.
    """
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b) if most is None else min(len(b), most + 1)
    if most is not None and len(b) - len(a) > most:
        return most + 1
    far = len(a) + len(b) + 1
    band = len(b) if most is None else most
    before, last = [far] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - band), min(len(b), i + band)
        row = [far] * (len(b) + 1)
        row[0] = i
        for j in range(low, high + 1):
            y = b[j - 1]
            best = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row[j] = best
        if most is not None and min(row[low - 1 : high + 1]) > most and min(last[max(0, low - 2) : high + 1]) > most:
            return most + 1
        before, last = last, row
    return last[-1] if most is None else min(last[-1], most + 1)


def damerau(a: str, b: str) -> int:
    """Unrestricted edit distance with swaps: text may be edited between the swapped characters."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    grid = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, l = seen.get(y, 0), match  # noqa: E741
            swap = grid[k][l] + (i - k - 1) + 1 + (j - l - 1)
            if x == y:
                match = j
            row.append(min(grid[i][j] + (x != y), row[j] + 1, grid[i][j + 1] + 1, swap))
        grid.append(row)
        seen[x] = i
    return grid[-1][-1]


def jaro(a: str, b: str) -> float:
    """Jaro similarity, with whole pairs of transposed characters."""
    if a == b:
        return 1.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, (y for y, t in zip(b, taken) if t))) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


_WORDS = re.compile(f"[^{re.escape(TERMINALS + INTERNALS + ENCLOSERS + DIVISIVES)}]*(?:[{re.escape(TERMINALS + INTERNALS + ENCLOSERS + DIVISIVES)}]|\\Z)")


def title_text(value: str) -> str | None:
    """Title case of one string; null for an empty one."""
    if not value:
        return None
    out, capital = [], True
    for match in _WORDS.finditer(value.lower()):
        word = match[0]
        if not word:
            continue
        end = word[-1]
        # a blank or comma of its own passes the capital on to the next word
        if word not in INTERNALS and (capital or word.rstrip(" ") not in MINOR_WORDS):
            word = (word[0] if word[0] == "ß" else word[0].upper()) + word[1:]
            capital = end in DIVISIVES
        if end in TERMINALS or end in ENCLOSERS:
            capital = True
        out.append(word)
    return "".join(out)


_TOKENS = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def json_text(value: str) -> str:
    """Re-indents JSON with tabs, without parsing values: key order and number text stay."""
    out: list[str] = []
    depth, after_colon = 0, False
    for token in _TOKENS.findall(value.replace("\n", "").replace("\t", "")):
        if token in "{[":
            out.append(token if after_colon else "\n" + "\t" * depth + token)
            depth, after_colon = depth + 1, False
        elif token in "}]":
            depth = max(0, depth - 1)
            out.append("\n" + "\t" * depth + token)
            after_colon = False
        elif token == ":":
            out.append(": ")
            after_colon = True
        elif after_colon or token == ",":
            out.append(token)
            after_colon = False
        else:
            out.append("\n" + "\t" * depth + token)
    return "".join(out).removeprefix("\n")
