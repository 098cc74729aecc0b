"""Naming a value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once.

    An expression that names a long sub-expression several times is otherwise copied as often,
    and copied again by every filter the optimizer pushes through it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
