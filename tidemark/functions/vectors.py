"""Columns on arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def sliding_agreement(a: Column, b: Column, most: int, least: int, bits: int = 32) -> Column:
    """The best mean agreement of the bits of two arrays of words over slides of up to `most` places either way that overlap in `least` words at least; 0 if none does."""
    def at(off: Column) -> Column:
        n = F.least(F.size(a), F.size(b) + off) - F.greatest(off, F.lit(0))
        pairs = F.zip_with(F.slice(a, F.greatest(off, F.lit(0)) + 1, F.greatest(n, F.lit(0))), F.slice(b, F.greatest(-off, F.lit(0)) + 1, F.greatest(n, F.lit(0))), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
        return F.when(n >= least, 1 - F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x) / n / bits)

    return F.coalesce(F.array_max(F.transform(F.sequence(F.lit(-most), F.lit(most)), at)), F.lit(0.0))


@F.pandas_udf(BinaryType())
def to_blob(column: pd.Series) -> pd.Series:
    """An array of numbers as a blob of little-endian single-precision ones; null for a null array."""
    return column.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def from_blob(blob: str, width: int) -> Column:
    """A blob of little-endian single-precision numbers as its layers, arrays of `width` numbers; null for a null blob or one that isn't whole layers."""

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def layers(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None or len(b) % (4 * width) else np.frombuffer(b, dtype="<f4").astype(np.float64).reshape(-1, width).tolist())

    return layers(blob)


def bit_agreement(a: Column, b: Column, bits: int = 32) -> Column:
    """The share of bits in which two words agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / bits
