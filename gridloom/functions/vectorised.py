"""Series functions as Column functions that need no session until they are called."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def vectorised(kind: str):
    """A function of pandas series as one of columns; Spark makes the UDF once there is a session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
