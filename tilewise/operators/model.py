"""An array as a DataFrame: a column for each dimension, one for the value, and the shape beside it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coordinates, in_records
from ..functions.shapes import checked


@dataclass(frozen=True)
class ArrayFrame:
    """`shape` is None where the array is sparse and its extent isn't known."""

    df: DataFrame
    dims: tuple[str, ...]
    value: str = "value"
    shape: tuple[int, ...] | None = None

    @staticmethod
    def of(df: DataFrame, dims: Sequence[str], value: str = "value", shape: Sequence[int] | None = None) -> ArrayFrame:
        missing = {*dims, value} - set(df.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        if shape is not None and len(shape) != len(dims):
            raise ValueError("a length for each dimension is needed")
        return ArrayFrame(df, tuple(dims), value, checked(shape) if shape is not None else None)

    @staticmethod
    def from_linear(df: DataFrame, number: str, shape: Sequence[int], dims: Sequence[str], value: str = "value") -> ArrayFrame:
        """From row-major cell numbers."""
        return ArrayFrame.of(df.select(*coordinates(number, shape, dims), F.col(value)), dims, value, shape)

    def where(self, condition: Column) -> ArrayFrame:
        return replace(self, df=self.df.where(condition))

    def records(self, low: int | None = None, high: int | None = None) -> ArrayFrame:
        """Cells whose first coordinate is in [low, high): an exact filter, which Parquet and `netcdf3.scan` get to see."""
        return self.where(in_records(self.dims[0], low, high))

    def cells(self) -> DataFrame:
        """The identity operator: coordinates and value as they are."""
        return self.df.select(*self.dims, self.value)

    def null_cells(self, fill: float | None = None) -> DataFrame:
        """Cells without a value: null, or equal to the fill value."""
        v = F.col(self.value)
        return self.df.where(v.isNull() if fill is None else v.isNull() | (v == F.lit(fill))).select(*self.dims)


def concat(arrays: Sequence[ArrayFrame], mode: str = "concat", file_column: str | None = None) -> ArrayFrame:
    """Several files as one array. `concat` puts them one after another along the first dimension, `combine` over each
    other; with `file_column` the number of the file is kept."""
    if mode not in ("concat", "combine"):
        raise ValueError(f"no such mode: {mode}")
    first, offset, frames = arrays[0], 0, []
    for k, a in enumerate(arrays):
        if a.dims != first.dims or a.value != first.value:
            raise ValueError("arrays of other dimensions or values can't be put together")
        df = a.df.select(*a.dims, a.value)
        if mode == "concat":
            if a.shape is None:
                raise ValueError("only arrays of known shape can be put one after another")
            df = df.withColumn(a.dims[0], (F.col(a.dims[0]) + offset).cast("int"))
            offset += a.shape[0]
        frames.append(df.withColumn(file_column, F.lit(k)) if file_column else df)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    shape = None if first.shape is None else (offset, *first.shape[1:]) if mode == "concat" else tuple(max(x) for x in zip(*(a.shape for a in arrays)))
    return replace(first, df=out, shape=shape)
