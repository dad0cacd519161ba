"""The one string-equality rule of the library: case-sensitive, accent-insensitive, trailing blanks ignored.

Equality and joins use the collation; work on single characters uses ``norm``, which folds accents and
trims, as a collation does not reach into built-in distance functions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equality of strings as a collation of the engine.
COLLATION = "UNICODE_AI_RTRIM"


def _folding() -> tuple[str, str]:
    """Accented Latin letters (to U+024F and U+1E00 to U+1EFF) and the plain letters under them."""
    accented, plain = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            accented.append(c)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


#: Letters that equal an ASCII letter without their accent, and those ASCII letters.
ACCENTED_LETTERS, PLAIN_LETTERS = _folding()


def text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold_accents(s: Column) -> Column:
    """Latin letters without accents; text of one byte a character has none."""
    return F.when(F.octet_length(s) == F.length(s), s).otherwise(F.translate(s, ACCENTED_LETTERS, PLAIN_LETTERS))


def norm(s: Column) -> Column:
    """The form of a string that distances are taken on."""
    return F.rtrim(fold_accents(s.cast("string")))


def same(a: Column, b: Column) -> Column:
    """Equality under the rule; null if either side is."""
    return F.collate(a.cast("string"), COLLATION) == F.collate(b.cast("string"), COLLATION)
