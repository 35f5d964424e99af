"""Functions in Python where built-in ones do not do: a constant bound at each call, a mean that merges, a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def with_constant(constant: str) -> Callable[[Column], Column]:
    """A function of one column that has its own constant: each call site gets the one it was made with."""
    if not isinstance(constant, str):
        raise TypeError("the constant must be a string that is known when the query is built")

    def join(values: pd.Series) -> pd.Series:
        return values + constant

    return lambda column: F.pandas_udf(join, StringType())(column)


def mean(column: Column) -> Column:
    """Nulls are left out; null where nothing is left. Sum and count are combined before the shuffle."""
    return F.when(F.count(column) > 0, F.sum(column).cast("double") / F.count(column))


class Words:
    """A table function: the words of a text with their places."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def register(spark: SparkSession) -> None:
    """Makes mean_of and words_at known to SQL for the session."""
    spark.udf.register("mean_of", F.pandas_udf(lambda v: float(v.mean()) if v.notna().any() else None, "double", F.PandasUDFType.GROUPED_AGG))
    spark.udtf.register("words_at", F.udtf(Words, returnType="place int, word string"))
