"""Column names that operators add, and those of their own steps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def without(df: DataFrame, added: Iterable[str], needed: Iterable[str] = ()) -> DataFrame:
    """The rows without columns that an operator will add, or that begin with an underscore as its own steps do.

    What the operator needs stays, whatever its name.
    """
    taken = {c.lower() for c in added} - {c.lower() for c in needed}
    kept = {c.lower() for c in needed}
    return df.drop(*[c for c in df.columns if c.lower() in taken or (c.startswith("_") and c.lower() not in kept)])
