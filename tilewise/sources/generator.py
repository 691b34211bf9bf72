"""Synthetic arrays whose cells hold their own row-major number, and their known medians."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import output_space, strides
from ..operators.model import ArrayFrame
from .netcdf3 import write_file


def incrementing(spark: SparkSession, shape: Sequence[int], dims: Sequence[str] | None = None) -> ArrayFrame:
    dims = list(dims or (f"d{i}" for i in range(len(shape))))
    return ArrayFrame.from_linear(spark.range(math.prod(shape)).select("id", F.col("id").alias("value")), "id", shape, dims)


def write_incrementing(file: str, shape: Sequence[int], dims: Sequence[str], variable: str = "windspeed1", unlimited: bool = True) -> None:
    """A file with the array (32-bit integers), and for each dimension a coordinate variable 0, 1, 2, ..."""
    data = {d: ([d], np.arange(n, dtype="i4" if k == 0 else "f4"), {"units": "index", "long_name": d}) for k, (d, n) in enumerate(zip(dims, shape))}
    data[variable] = (list(dims), np.arange(math.prod(shape), dtype="i4").reshape(shape), {})
    write_file(file, list(zip(dims, map(int, shape))), data, record=dims[0] if unlimited else None)


def known_median(shape: Sequence[int], tile: Sequence[int], key: Sequence[int]) -> int:
    """Upper median of a whole tile of an incrementing array. Its first dimension must have an even length."""
    if tile[0] % 2 or any(g >= n for g, n in zip(key, output_space(shape, tile))):
        raise ValueError("known for whole tiles with an even first length")
    s = strides(shape)
    return sum(g * e * t for g, e, t in zip(key, tile, s)) + tile[0] // 2 * s[0]
