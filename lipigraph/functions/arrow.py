"""Arrow functions that are made where they are used: a worker imports their modules without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        call.__doc__, call.__name__ = f.__doc__, f.__name__
        return call

    return wrap
