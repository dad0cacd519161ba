"""LIKE patterns (``%``, ``_``, ``[set]``, ``[^set]``) as regular expressions."""

from __future__ import annotations

import re
import unicodedata

from .norm import ACCENTED_LETTERS

_SPECIAL = set("\\.^$*+?{}[]|()")


def _plain(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0]


def _accents_of(low: str, high: str) -> str:
    return "".join(c for c in ACCENTED_LETTERS if low <= _plain(c) <= high)


def _set(body: str) -> str:
    """The inside of a set; ranges are written ``a-z`` or ``a..z``."""
    out, k = [], 0
    quote = lambda c: "\\" + c if not c.isalnum() and c != " " else c
    while k < len(body):
        low = high = body[k]
        for mark in ("-", ".."):
            if body.startswith(mark, k + 1) and k + 1 + len(mark) < len(body):
                high = body[k + 1 + len(mark)]
                k += 1 + len(mark)
                break
        k += 1
        out.append(quote(low) if low == high else f"{quote(low)}-{quote(high)}")
        out.append(_accents_of(low, high))
    return "".join(out)


def parts(pattern: str) -> list[str]:
    """A regular expression for each character, set or wildcard of the pattern; accents do not matter."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and (end := pattern.find("]", k + 1)) > k:
            body = pattern[k + 1 : end]
            out.append(f"[^{_set(body[1:])}]" if body.startswith("^") else f"[{_set(body)}]")
            k = end
        elif c == "%":
            out.append("[\\s\\S]*?")
        elif c == "_":
            out.append("[\\s\\S]")
        elif accents := _accents_of(_plain(c), _plain(c)):
            out.append(f"[{_plain(c)}{accents}]")
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        k += 1
    return out


def to_regex(pattern: str) -> str:
    return "".join(parts(pattern))


def width(pattern: str) -> int:
    """How many characters a match has, each set counting as one."""
    return len(parts(pattern))


def compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(to_regex(pattern))
