"""Vectors as arrays of floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null for vectors of different lengths."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; one of length up to 1e-12 stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def to_blob(c: str | Column) -> Column:
    """Little-endian 32-bit floats."""
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(c)


def from_blob(c: str | Column) -> Column:
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return F.pandas_udf(run, "array<float>")(c)
