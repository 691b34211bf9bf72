"""Early results: a tile's median is final, and emitted, as soon as all of its cells have arrived."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import tile_key
from ..functions.shapes import checked, expected_cells
from ..operators.states import gathered
from ..sources import netcdf3

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Cells of a bundle of neighbouring tiles, about, which are a state together: a state's own cost is that of many cells.
BUNDLE_CELLS = 1 << 14
#: A cell on its way: its tile's place in the bundle, whether it has a value, and the value.
CELL = np.dtype([("t", "<i4"), ("there", "?"), ("v", "<f8")])


def bundle_of(shape: Sequence[int], tile: Sequence[int]) -> tuple[int, ...]:
    """How many tiles along each dimension are a bundle: the last dimensions' first, as these complete together."""
    room, out = max(1, BUNDLE_CELLS // math.prod(tile)), []
    for n, e in zip(reversed(shape), reversed(tile)):
        out.append(max(1, min(-(-n // e), room)))
        room //= out[-1]
    return tuple(reversed(out))


def _packed(bundle: tuple[int, ...]):
    """From cells (g0, ..., v, there) of a task: a row for each of its bundles (b0, ..., cells)."""
    names = [*(f"b{i}" for i in range(len(bundle))), "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *keys, v, there in gathered(batches):
            keys = np.stack([k.to_numpy().astype(np.int64) for k in keys])
            size = np.array(bundle)[:, None]
            own, cells = keys // size, np.empty(len(v), CELL)
            cells["t"], cells["there"], cells["v"] = np.ravel_multi_index(tuple(keys % size), bundle), there.to_numpy(zero_copy_only=False), v.to_numpy()
            order = np.lexsort(own[::-1])
            own, cells = own[:, order], cells[order]
            heads = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
            packed = [cells[a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(cells)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in own[:, heads]), pa.array(packed, pa.binary())], names=names)

    return run


class _Tiles(StatefulProcessor):
    """The state of a bundle of tiles is a list that is only appended to, a packed run of cells for each batch that brought some, and a count for each tile, -1
    where the tile is out. What a batch writes is what it brings, however much of the tiles has come before; cells of tiles that are out are
    removed when they are half of the list."""

    def __init__(self, keys: list[str], shape: Sequence[int], tile: Sequence[int], records: tuple[int, int] | None):
        self.keys, self.shape, self.tile, self.records = keys, shape, tile, records
        self.bundle = bundle_of(shape, tile)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "run binary")
        self.seen = handle.getValueState("seen", "n binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([np.frombuffer(cells, CELL) for part in rows for cells in part["cells"]])
        own = np.stack(np.unravel_index(np.arange(math.prod(self.bundle)), self.bundle), axis=1) + np.array(key) * np.array(self.bundle)
        expected = np.array([expected_cells(self.shape, self.tile, tuple(k), self.records) for k in own.tolist()])
        known = self.seen.exists()
        seen = np.frombuffer(self.seen.get()[0], np.int64).copy() if known else np.zeros(len(own), np.int64)
        new = new[seen[new["t"]] >= 0]
        come = np.bincount(new["t"], minlength=len(own))
        seen += come
        out = (come > 0) & (seen >= expected)
        old = np.zeros(0, CELL)
        if known and (out & (seen > come)).any():  # some of these tiles' cells came before
            old = np.concatenate([np.zeros(0, CELL), *(np.frombuffer(run, CELL) for (run,) in self.runs.get())])
        n_cells, left = seen[out], new[new["there"] & ~out[new["t"]]]
        seen[out] = -1
        if ((seen < 0) | (expected == 0)).all():
            if known:
                self.runs.clear()
                self.seen.clear()
        else:
            stays = old[seen[old["t"]] >= 0]
            if 2 * len(stays) <= len(old) > 0:
                self.runs.clear()
                left = np.concatenate([stays, left])
            if len(left):
                self.runs.appendValue((left.tobytes(),))
            self.seen.update((seen.tobytes(),))
        if not out.any():
            return
        cells = np.concatenate([old[out[old["t"]]], new[new["there"] & out[new["t"]]]])
        cells = cells[np.lexsort((cells["v"], cells["t"]))]  # NaN is the largest
        n = np.bincount(cells["t"], minlength=len(out))
        middle = (np.cumsum(n) - n + n // 2)[out]
        missing = n[out] == 0
        result = np.append(cells["v"], 0.0)[np.where(missing, len(cells), middle)]
        nan = np.isnan(result)
        found = pd.DataFrame({k: g.astype(np.int32) for k, g in zip(self.keys, own[out].T)})
        # pandas has one NaN for what is missing and what is no number: null and NaN travel beside the result
        found["result"], found["missing"], found["nan"], found["n_cells"] = np.where(nan, 0.0, result), missing, nan, n_cells
        yield found


def appending_state(spark: SparkSession) -> None:
    """States whose lists grow by what is appended need the RocksDB store, and logs of changes in place of whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def early_medians(cells: DataFrame, dims: Sequence[str], shape: Sequence[int], tile: Sequence[int], value: str = "value", records: tuple[int, int] | None = None) -> DataFrame:
    """From a stream of cells: g0, ..., result, n_cells, each tile once. Edge tiles, and tiles cut by the range of `records`,
    are complete with what the array has there. Each cell arrives once, as a file source with a checkpoint has it. Null cells count but have no
    rank, as in `tile_agg`: of a tile of nulls only the median is null; NaN is the largest value."""
    shape, tile = checked(shape), checked(tile)
    keys = [f"g{i}" for i in range(len(tile))]
    appending_state(cells.sparkSession)
    keyed = cells.where(F.lit(True) if records is None else F.col(dims[0]).between(records[0], records[1] - 1))
    v = F.col(value).cast("double")
    keyed = keyed.where(" AND ".join(f"`{d}` IS NOT NULL" for d in dims)).select(*tile_key(dims, tile), F.coalesce(v, F.lit(0.0)).alias("v"), v.isNotNull().alias("there"))
    schema = ", ".join(f"{k} int" for k in keys) + ", result double, missing boolean, nan boolean, n_cells long"
    bundles = [f"b{i}" for i in range(len(tile))]
    packed = keyed.mapInArrow(_packed(bundle_of(shape, tile)), ", ".join(f"{b} int" for b in bundles) + ", cells binary")
    found = packed.groupBy(*bundles).transformWithStateInPandas(_Tiles(keys, shape, tile, records), schema, "append", "none")
    return found.select(*keys, F.when(F.col("nan"), F.lit(float("nan"))).when(~F.col("missing"), F.col("result")).alias("result"), "n_cells")


def scan_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The cells of NetCDF-3 files as they arrive, in order of their names: see `netcdf3.StreamReader`."""
    spark.dataSource.register(netcdf3.NetCDF3)
    return spark.readStream.format("netcdf3").options(**options).load(path)
