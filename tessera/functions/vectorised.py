"""Arrow-batched functions that become UDFs when they are first applied, so that executors can import their modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(kind: str) -> Callable:
    """A pandas function of columns that returns ``kind``."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
