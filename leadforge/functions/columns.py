"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    ``transform(array(v), x -> body(x))[0]``: the optimizer may copy a computed
    column into a pushed-down filter, but the copy still evaluates ``value``
    once instead of once per reference inside ``body``.
    """
    return F.transform(F.array(value), body)[0]


def round6(c: Column) -> Column:
    return F.round(c, 6)
