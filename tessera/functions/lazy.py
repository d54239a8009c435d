"""Arrow-batched functions whose schema is parsed when they are first used, as parsing needs a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(schema: str) -> Callable:
    """Like pandas_udf(schema), for modules that are imported before there is a session."""

    def wrap(function) -> Callable[..., Column]:
        @functools.wraps(function)
        def call(*columns) -> Column:
            return F.pandas_udf(function, schema)(*columns)

        return call

    return wrap


def arrow(schema: str) -> Callable:
    """The same for functions of Arrow arrays."""

    def wrap(function) -> Callable[..., Column]:
        @functools.wraps(function)
        def call(*columns) -> Column:
            return F.arrow_udf(function, schema)(*columns)

        return call

    return wrap
