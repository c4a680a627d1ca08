"""Survival function of the chi-square distribution for whole degrees of freedom."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def survival(x: float, dof: int) -> float:
    """P(X > x). Closed forms: a finite sum for even, erfc and a finite sum for odd dof; exact
    in the far tail, where 1 - cdf would lose all digits."""
    if x <= 0 or dof < 1:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total, term = 0.0, math.sqrt(h) * 2 / math.sqrt(math.pi)
    for i in range(1, dof // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return math.erfc(math.sqrt(h)) + math.exp(-h) * total


@F.pandas_udf(T.DoubleType())
def _survival(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else survival(float(a), int(b)) for a, b in zip(x, dof, strict=True)], dtype="float64")


def p_value(x: Column, dof: Column) -> Column:
    return _survival(x.cast("double"), dof.cast("int"))
