"""Frequency and position weights of terms."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

PositionWeight = Callable[[Column], Column]


def zipf_coefficient(order: Column, s: float) -> Column:
    """``1 / order ** s``: the more frequent a word (the lower its order), the larger its coefficient."""
    return F.lit(1.0) / F.pow(order.cast("double"), F.lit(float(s)))


class PythonWeight:
    """A position weight given as a Python function of the 0-based position.

    The function is evaluated in Python workers from the array lengths alone, once per position and batch, so no other
    column leaves the JVM. A ``Column -> Column`` function avoids Python altogether.
    """

    def __init__(self, weight: Callable[[int], float]):
        self.weight = weight

    def of_length(self, length: Column) -> Column:
        weight = self.weight

        @F.pandas_udf(ArrayType(DoubleType()))
        def weights(lengths: pd.Series) -> pd.Series:
            longest = int(lengths.max()) if lengths.notna().any() else 0
            table = [float(weight(position)) for position in range(longest)]
            return lengths.map(lambda n: None if pd.isna(n) else table[: int(n)])

        return weights(length)


def coefficients(orders: Column, s: float, weight: PositionWeight | PythonWeight | None = None) -> Column:
    """Per term, its position weight times its Zipf coefficient, in term order.

    :param orders: array of frequency orders; positions are those left after pruning.
    :param weight: position weight, 1 everywhere by default.
    """
    if weight is None:
        return F.transform(orders, lambda order: zipf_coefficient(order, s))
    if isinstance(weight, PythonWeight):
        return F.zip_with(weight.of_length(F.size(orders)), orders,
                          lambda factor, order: factor * zipf_coefficient(order, s))
    return F.transform(orders, lambda order, position: weight(position) * zipf_coefficient(order, s))
