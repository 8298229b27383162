"""Vectors as little-endian 32-bit floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_bytes(vec: Column | str) -> Column:
    """Packed vector; null stays null."""

    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(pack, T.BinaryType())(vec)


def from_bytes(raw: Column | str, dim: int) -> Column:
    """Vector of so many components; other lengths are null."""

    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4") if x is not None and len(x) == 4 * dim else None)

    return F.pandas_udf(unpack, T.ArrayType(T.FloatType()))(raw)
