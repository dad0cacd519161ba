"""Checks on streams.  Structure compliance without groups of unique columns needs no state, so it applies to a stream as it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.compliance import Field, fields_of, structure_compliance


def checked(stream: DataFrame, structure: T.StructType | Sequence[Field], truncation_check: bool = True) -> DataFrame:
    """A stream with the column ``__error__``; uniqueness cannot be told of a stream and is refused."""
    expected = fields_of(structure)
    if any(f.unique for f in expected):
        raise ValueError("uniqueness needs all rows, which a stream has not")
    return structure_compliance(stream, expected, truncation_check)
