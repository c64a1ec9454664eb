"""Joins between sides that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side that grows with the input: the join sorts both sides and never sends one to the driver and all tasks.

    Spark guesses sizes from packed columns and before an explode, so it takes sides of millions of rows for small ones.
    """
    return df.hint("merge")
