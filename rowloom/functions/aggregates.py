"""Aggregates that a user writes: a function of one column's values, for SELECT."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def register(spark: SparkSession, name: str, fold: Callable[[pd.Series], object], returns: str) -> None:
    """A name that SELECT can aggregate with. A group's values come to one task as one series: for groups of bounded size."""

    @pandas_udf(returns)
    def own(values: pd.Series) -> float:
        return fold(values)

    spark.udf.register(name, own)
