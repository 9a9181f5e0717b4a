"""Column expressions on array<double> vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors may be stored as floats."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scale(a: Column, k: Column) -> Column:
    """Vector times scalar. The scalar is repeated as an array, so it is computed once per row and not once per
    element inside the lambda."""
    return F.zip_with(a, F.array_repeat(k, F.size(a)), lambda x, y: x * y)


def unit(a: Column, floor: float = 1e-8) -> Column:
    """Row L2 normalisation; the norm is floored so that zero rows stay zero."""
    return scale(a, 1.0 / F.greatest(norm(a), F.lit(floor)))


def sum_vectors(col: str, dim: int, weight: str | None = None) -> Column:
    """Element-wise (weighted) sum as an aggregate: one sum per element, so map-side combine and codegen apply."""
    by = f" * `{weight}`" if weight else ""
    return F.expr("array(" + ", ".join(f"sum(`{col}`[{i}]{by})" for i in range(dim)) + ")")


def mean_vectors(col: str, dim: int) -> Column:
    return F.expr("array(" + ", ".join(f"avg(`{col}`[{i}])" for i in range(dim)) + ")")


def dot_sums(a: str, b: str, dim: int, weight: str = "1D") -> Column:
    """Per element the sum over rows of a * b * weight."""
    return F.expr("array(" + ", ".join(f"sum(`{a}`[{i}] * `{b}`[{i}] * ({weight}))" for i in range(dim)) + ")")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def vector_dim(df: DataFrame, col: str = "vec") -> int:
    """Length of the vectors, read from one row (all rows have the same length)."""
    row = df.select(F.size(col).alias("n")).first()
    return int(row["n"]) if row else 0


def times_matrix(matrix: np.ndarray):
    """Arrow UDF: vector column times a fixed matrix whose size is a parameter (it travels with the function)."""

    @F.pandas_udf("array<double>")
    def product(col: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(col.to_numpy()) @ matrix)) if len(col) else col

    return product
