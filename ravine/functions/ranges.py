"""Ranges of numbers as rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def span(start: Column | str, end: Column | str) -> Column:
    """The whole numbers from start to end, for ``explode``: none where the end lies before the start."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.when(a <= b, F.sequence(a, b))
