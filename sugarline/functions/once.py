"""Evaluating expensive expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(**columns: Column) -> Column:
    """Generator of one row with these columns, for use in ``select``.

    A filter on a computed column is pushed below its projection and then repeats the whole
    expression. It is not pushed below a generator, so parsers put behind one run once.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
