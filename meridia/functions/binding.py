"""Values that an expression uses several times but should compute once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used, inside lambdas too."""
    return F.transform(F.array(value), use)[0]
