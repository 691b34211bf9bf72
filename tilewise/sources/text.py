"""Results as lines of text, a line for each tile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_lines(tiles: DataFrame, tile: Sequence[int], variable: str, result: str = "result", file: Column | str = "") -> DataFrame:
    """(value): `file@variable@[corner],[shape]`, a tab, `values = result`. The corner is the tile's key g0, ..., the shape the tile's;
    `file` is a name or a column. A null result is written as `null`."""
    listed = lambda parts: F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    corner = listed([F.col(f"g{i}").cast("string") for i in range(len(tile))])
    shape = listed([F.lit(str(int(e))) for e in tile])
    name = F.lit(file) if isinstance(file, str) else F.coalesce(file, F.lit(""))
    key = F.concat(name, F.lit(f"@{variable}@"), corner, F.lit(","), shape)
    return tiles.select(F.concat(key, F.lit("\tvalues = "), F.coalesce(F.col(result).cast("string"), F.lit("null"))).alias("value"))


def write_text(tiles: DataFrame, path: str, tile: Sequence[int], variable: str, result: str = "result", file: Column | str = "", mode: str = "errorifexists") -> None:
    text_lines(tiles, tile, variable, result, file).write.mode(mode).text(path)
