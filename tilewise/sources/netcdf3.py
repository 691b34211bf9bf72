"""NetCDF-3 classic files (CDF-1 and CDF-2) as a Spark data source, for reading, streaming and writing.

    scan(spark, "file:///data/*.nc", variable="windspeed1").where("time >= 100 AND time < 200")
    spark.read.format("netcdf3").option("variable", "windspeed1").load("file:///data/*.nc")
    df.write.format("netcdf3").option("variable", "var1").mode("append").save("file:///out")

Reading gives a row for each cell: an int column for each dimension (by its name) and `value`. `scan` registers the source and
lets Spark push comparisons of dimensions into it, so that other cells are never read. Options:
`variable` (required; several by commas give a column for each, by its name: the first has all dimensions, the others some of
them, in that order, and are repeated along the rest; one that has a dimension's name is called name_value), `records` ("low,high",
only these records are read), `coordinate` with `coordinateEq`, `coordinateGt`, `coordinateLt` (a variable of one dimension: only places
whose coordinate passes, as in `coords.predicate`; each file's own variable is looked at while planning),
`maxPartitionBytes` (of a partition; default 32 MB: larger records are cut inside, small files share a partition), `openCostBytes`
(what opening a slab counts for), `numPartitions` (for a file, instead), `align` (slabs are multiples of so many records, or of so many places
along each dimension by commas), `layout` (cells; slabs: a row (low, values) for each `align` records, packed in row-major
order; boxes: a row (corner, lengths, values) for each slab), `fileColumn` (adds the file's name), `multiFileMode` (concat: files lie one after
another along the first dimension; combine: over each other), `ignoreInvalid` (skip what isn't NetCDF-3), `fillAsNull` (true: cells with the fill
value are null; false: they are values; not given: cells that have their variable's own `_FillValue` are absent, as the sink wrote none there).

A task reads at most `BATCH_CELLS` cells at a time, whatever a record's size. Files of ours say where their first cell lies, by the attribute
`tilewise_corner`; others follow what lies before them. Writing: see `Writer`. Files are opened by their URI: local folders and every store
Arrow knows.
"""

from __future__ import annotations

import fnmatch
import itertools
import math
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, ShortType, StringType, StructField, StructType

from ..plans import boxes
from ..plans.ranges import record_slabs

# Fixed values of the public format: type codes with big-endian types, list tags, default fill values.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
FILLS = {"i1": -127, "i2": -32767, "i4": -2147483647, "f4": 9.969209968386869e36, "f8": 9.969209968386869e36}
SPARK_TYPES = {"i1": ShortType(), "i2": ShortType(), "i4": IntegerType(), "f4": FloatType(), "f8": DoubleType()}
KINDS = {"int": "i4", "float": "f4", "double": "f8", "smallint": "i2", "bigint": "f8"}
BATCH_CELLS, DENSE_CELLS = 1 << 20, 1 << 28
#: Defaults of a partition's bytes and of what opening a slab counts for; slabs inside a record have so many bytes at least.
PARTITION_BYTES, OPEN_BYTES, LEAST_SLAB = 32 << 20, 64 << 10, 1 << 10
#: Ranges along a dimension that a file is read in, at most; tasks still check each place.
MOST_RUNS = 64
CORNER = "tilewise_corner"
#: Number of records of a file that was written in one go: it follows from the file's size.
STREAMING = -1


def open_store(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def find_files(path: str) -> list[str]:
    """Files of a path, in order of their names: one file, a folder's *.nc, or what a pattern names; any part of the path may be one."""
    from pyarrow import fs

    plain = next((k for k, c in enumerate(path) if c in "*?["), len(path))
    head = path[: path.rfind("/", 0, plain) + 1] if plain < len(path) else path
    store, at = open_store(head)
    own, at = head.rstrip("/"), at.rstrip("/")
    prefix = own[: len(own) - len(at)] if own.endswith(at) else ""
    if plain == len(path):
        if store.get_file_info(at).type == fs.FileType.File:
            return [path]
        folders, last = [at or "/"], "*.nc"
    else:
        *parts, last = path[len(head) :].rstrip("/").split("/")
        folders = [at or "/"]
        for part in parts:
            inner = [f for folder in folders for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
            folders = [f.path for f in inner if f.type == fs.FileType.Directory and fnmatch.fnmatchcase(f.base_name, part)]
    found = [f for folder in folders for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
    matching = [f for f in found if fnmatch.fnmatchcase(f.base_name, last)]
    files = [f.path for f in matching if f.type == fs.FileType.File]
    for folder in (f.path for f in matching if f.type == fs.FileType.Directory and plain < len(path)):  # a pattern that names folders
        files += [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, "*.nc")]
    return [prefix + f for f in sorted(files)]


def move_file(file: str, to: str) -> None:
    """Gives a file of a store another name, in a folder that is made where it isn't there."""
    store, at = open_store(file)
    target = open_store(to)[1]
    store.create_dir(target.rpartition("/")[0], recursive=True)
    store.move(at, target)


@dataclass
class Variable:
    name: str
    dims: list[int]
    kind: str
    begin: int = 0
    size: int = 0
    record: bool = False
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    version: int
    records: int
    dimensions: list[tuple[str, int]]  # the record dimension's length is 0
    attributes: dict
    variables: dict[str, Variable]

    @property
    def record_size(self) -> int:
        return sum(v.size for v in self.variables.values() if v.record)

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.dimensions[d][1] or self.records for d in self.variable(name).dims)

    def names(self, name: str) -> list[str]:
        return [self.dimensions[d][0] for d in self.variable(name).dims]

    def variable(self, name: str) -> Variable:
        if name not in self.variables:
            raise ValueError(f"no variable {name}; there are {', '.join(self.variables)}")
        return self.variables[name]


def parse_header(raw: bytes) -> Header:
    if raw[:3] != b"CDF" or raw[3:4] not in (b"\x01", b"\x02"):
        raise ValueError("not a NetCDF-3 classic file")
    at = 4

    def number(form: str = ">i") -> int:
        nonlocal at
        (out,) = struct.unpack_from(form, raw, at)
        at += struct.calcsize(form)
        return out

    def padded(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise struct.error("short")
        out = raw[at : at + n]
        at += -(-n // 4) * 4
        return out

    def text() -> str:
        return padded(number()).decode()

    def listed(tag: int) -> range:
        found, n = number(), number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("broken header")
        return range(n)

    def attributes() -> dict:
        out = {}
        for _ in listed(ATTRIBUTES):
            name, kind = text(), TYPES[number()]
            n = number()
            data = padded(n * np.dtype(kind).itemsize)
            out[name] = data.decode() if kind == "S1" else np.frombuffer(data, kind).tolist()
        return out

    version, records = raw[3], number()
    dims = [(text(), number()) for _ in listed(DIMENSIONS)]
    general = attributes()
    found = {}
    for _ in listed(VARIABLES):
        name = text()
        own = [number() for _ in range(number())]
        more = attributes()
        kind = np.dtype(TYPES[number()]).str.lstrip(">|")
        number()  # the stored size is redundant, and too small for large variables
        v = Variable(name, own, kind, number(">q" if version == 2 else ">i"), attributes=more)
        v.record = bool(own) and dims[own[0]][1] == 0
        cells = math.prod(dims[d][1] for d in own[v.record :])
        v.size = cells * np.dtype(TYPES[CODES[kind]]).itemsize
        found[name] = v
    if sum(v.record for v in found.values()) > 1:  # a single record variable isn't padded
        for v in found.values():
            v.size = -(-v.size // 4) * 4 if v.record else v.size
    return Header(version, records, dims, general, found)


def read_header(file: str) -> Header:
    store, at = open_store(file)
    with store.open_input_file(at) as f:
        n = 1 << 16
        while True:
            raw = f.read_at(min(n, f.size()), 0)
            try:
                head = parse_header(raw)
                if head.records == STREAMING:
                    first = min((v.begin for v in head.variables.values() if v.record), default=0)
                    head.records = (f.size() - first) // head.record_size if head.record_size else 0
                return head
            except struct.error:
                if n >= f.size():
                    raise ValueError(f"{file}: the header is cut off") from None
                n *= 4


def build_header(dimensions: list[tuple[str, int]], variables: list[Variable], records: int = 0, attributes: dict | None = None) -> bytes:
    """A CDF-2 header; sets each variable's place."""

    def text(x: str) -> bytes:
        b = x.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def attribute_list(items: dict) -> bytes:
        out = struct.pack(">ii", ATTRIBUTES if items else 0, len(items))
        for name, x in items.items():
            if isinstance(x, str):
                out += text(name) + struct.pack(">i", 2) + text(x)
            else:
                a = np.atleast_1d(np.asarray(x))
                a = a.astype(">i4" if a.dtype.kind == "i" else a.dtype.newbyteorder(">"))
                out += text(name) + struct.pack(">ii", CODES[a.dtype.str[1:]], len(a)) + a.tobytes() + b"\0" * (-a.nbytes % 4)
        return out

    def build() -> bytes:
        out = b"CDF\x02" + struct.pack(">i", records) + struct.pack(">ii", DIMENSIONS if dimensions else 0, len(dimensions))
        out += b"".join(text(n) + struct.pack(">i", size) for n, size in dimensions) + attribute_list(attributes or {})
        out += struct.pack(">ii", VARIABLES if variables else 0, len(variables))
        for v in variables:
            out += text(v.name) + struct.pack(f">i{len(v.dims)}i", len(v.dims), *v.dims) + attribute_list(v.attributes)
            out += struct.pack(">iiq", CODES[v.kind], min(v.size, 2**31 - 4), v.begin)
        return out

    at = len(build())
    for v in sorted(variables, key=lambda v: v.record):
        v.begin = at
        at += v.size
    return build()


def write_file(file: str, dimensions: list[tuple[str, int]], data: dict[str, tuple[list[str], np.ndarray, dict]], record: str | None = None, attributes: dict | None = None) -> None:
    """One file with whole variables: name -> (dimensions, values, attributes). `record` names the unlimited dimension."""
    number = {n: i for i, (n, _) in enumerate(dimensions)}
    records = dict(dimensions).get(record, 0)
    variables = []
    for name, (dims, values, more) in data.items():
        kind = values.dtype.newbyteorder(">").str.lstrip(">|")
        v = Variable(name, [number[d] for d in dims], kind, attributes=more, record=bool(dims) and dims[0] == record)
        size = values.nbytes // max(1, records) if v.record else values.nbytes
        v.size = -(-size // 4) * 4
        variables.append(v)
    alone = [v for v in variables if v.record]
    if len(alone) == 1:
        alone[0].size = data[alone[0].name][1].nbytes // max(1, records)
    head = build_header([(n, 0 if n == record else size) for n, size in dimensions], variables, records, attributes)
    store, at = open_store(file)
    own = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as out:
        out.write(head)
        big = {v.name: np.ascontiguousarray(data[v.name][1]).astype(data[v.name][1].dtype.newbyteorder(">")) for v in variables}
        for v in variables:
            if not v.record:
                out.write(big[v.name].tobytes().ljust(v.size, b"\0"))
        for r in range(records if alone else 0):
            for v in alone:
                out.write(big[v.name][r : r + 1].tobytes().ljust(v.size, b"\0"))
    store.move(own, at)


@dataclass
class Slab:
    """A box of one file, in the file's own places; `start` is where its first cell lies."""

    file: str
    box: boxes.Box
    start: tuple[int, ...]


class Slabs(InputPartition):
    def __init__(self, slabs: list[Slab]):
        super().__init__(None)
        self.slabs = slabs


def wanted(options: dict) -> list[str]:
    names = [n.strip() for n in options.get("variable", "").split(",") if n.strip()]
    if not names:
        raise ValueError("option variable is needed")
    return names


def layout_of(options: dict) -> str:
    layout = options.get("layout", "cells")
    if layout not in ("cells", "slabs", "boxes"):
        raise ValueError(f"no such layout: {layout}")
    if layout != "cells" and len(wanted(options)) > 1 or layout == "slabs" and options.get("fillasnull", "false").lower() == "true":
        raise ValueError(f"{layout} hold the packed values of one variable, " + ("without nulls" if layout == "slabs" else "not of several"))
    return layout


def fill_of(v: Variable) -> float | None:
    """The fill value that the variable itself states."""
    given = v.attributes.get("_FillValue")
    return given[0] if isinstance(given, list) and given else None


def equal_to(values: np.ndarray, fill: float | None) -> np.ndarray | None:
    """Where values are the fill value; None where they can't be."""
    if fill is None:
        return None
    found = np.isnan(values) if fill != fill else values == values.dtype.type(fill)
    return found if found.any() else None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.variables = wanted(options)
        self.low, self.high = (int(x) for x in options["records"].split(",")) if options.get("records") else (None, None)
        self.bounds: dict[str, list] = {}  # of dimensions, by name: [low, high)
        self.align = [int(x) for x in str(options.get("align", 1)).split(",")]
        if min(self.align) < 1:
            raise ValueError("align is a positive number of records")

    def files(self) -> list[tuple[str, Header]]:
        return usable_files(self.options["path"], self.options)

    def partitions(self) -> list[Slabs]:
        return self.planned(self.files())

    def planned(self, files: list[tuple[str, Header]]) -> list[Slabs]:
        o, layout = self.options, layout_of(self.options)
        mode = o.get("multifilemode", "concat")
        if mode not in ("concat", "combine"):
            raise ValueError(f"no such multiFileMode: {mode}")
        if layout != "cells" and mode == "combine" and len(files) > 1:
            raise ValueError(f"{layout} of files over each other don't hold whole tiles")
        groups: list[list[Slab]] = []
        costs, offset = [], 0
        most = int(o.get("maxpartitionbytes", PARTITION_BYTES))
        for file, head in files:
            shape, start = head.shape(self.variables[0]), self._start(head, offset if mode == "concat" else 0, mode)
            offset = max(offset, start[0] + shape[0]) if mode == "concat" else 0
            if layout == "slabs" and (start[0] % self.align[0] or any(start[1:])):
                raise ValueError(f"{file} begins inside a tile: no whole slabs of {self.align[0]} records")
            found = [Slab(file, box, start) for box in self._cut(head, shape, start, layout, most) for box in self._wanted(file, head, box, start)]
            if "numpartitions" in o:
                groups += [[x] for x in found]
            else:
                size = self._record_bytes(head) / max(1, math.prod(shape[1:]))
                groups += [[x] for x in found]
                costs += [int(boxes.cells(x.box) * size) + int(o.get("opencostbytes", OPEN_BYTES)) for x in found]
        if not costs:
            return [Slabs(g) for g in groups]
        out = []
        for group in boxes.packed(costs, most):
            slabs: list[Slab] = []
            for file, own in itertools.groupby((groups[k][0] for k in group), key=lambda x: x.file):
                own = list(own)
                slabs += [Slab(file, box, own[0].start) for box in boxes.compact(x.box for x in own)]
            out.append(Slabs(slabs))
        return out

    def _start(self, head: Header, offset: int, mode: str) -> tuple[int, ...]:
        shape, corner = head.shape(self.variables[0]), head.attributes.get(CORNER)
        if mode == "combine" or not isinstance(corner, list):
            return (offset, *[0] * (len(shape) - 1))
        return tuple(int(x) for x in [*corner, *[0] * len(shape)][: len(shape)])

    def _cut(self, head: Header, shape: tuple[int, ...], start: tuple[int, ...], layout: str, most: int) -> list[boxes.Box]:
        n, record = shape[0], self._record_bytes(head)
        own = [None if x is None else x - start[0] for x in (self.low, self.high)]
        rest = shape[1:]
        whole = lambda a, b: ((a, *[0] * len(rest)), (b, *rest))
        low, high = max(0, own[0] or 0), n if own[1] is None else min(n, own[1])
        inside = record * self.align[0] > max(most, LEAST_SLAB) and len(shape) > 1 and "numpartitions" not in self.options
        parts = min(n, max(1, int(self.options["numpartitions"]) if "numpartitions" in self.options else -(-n * record // max(1, most))))
        if layout == "cells" and not inside or layout == "slabs":
            return [whole(a, b) for a, b in record_slabs(n, parts, self.align[0], *own)]
        if low >= high:
            return []
        each = max(1, max(most, LEAST_SLAB) * math.prod(rest) // max(1, record)) if inside else -(-n // max(1, parts)) * math.prod(rest)
        return list(boxes.cut(whole(low, high), shape, each, self.align, start))

    def _wanted(self, file: str, head: Header, box: boxes.Box, start: tuple[int, ...]) -> Iterator[boxes.Box]:
        """What the bounds of dimensions and the coordinate leave of a box."""
        names = head.names(self.variables[0])
        limits = [self.bounds.get(n, [None, None]) for n in names]
        low = tuple(0 if a is None else max(0, a - s) for (a, _), s in zip(limits, start))
        high = tuple(h if b is None else min(h, b - s) for (_, b), s, h in zip(limits, start, box[1]))
        box = boxes.both(box, (low, high))
        along_, ranges = self._coordinate(file, head)
        for a, b in [(None, None)] if ranges is None else ranges:
            one = box if a is None else boxes.both(box, (tuple(a if i == along_ else x for i, x in enumerate(box[0])), tuple(b if i == along_ else x for i, x in enumerate(box[1]))))
            if boxes.cells(one):
                yield one

    def _coordinate(self, file: str, head: Header) -> tuple[int, list[tuple[int, int]] | None]:
        """The dimension that the coordinate lies along and the ranges of it that can pass; None without a coordinate."""
        if "coordinate" not in self.options:
            return 0, None
        known = self.__dict__.setdefault("_ranges", {})
        if file not in known:
            store, at = open_store(file)
            with store.open_input_file(at) as f:
                dim, passed = self._passed(f, head)
            known.clear()
            known[file] = dim, boxes.runs(passed.tolist(), MOST_RUNS)
        return known[file]

    def _passed(self, f, head: Header) -> tuple[int, np.ndarray]:
        v, first = head.variable(self.options["coordinate"]), head.variable(self.variables[0])
        if len(v.dims) != 1 or v.dims[0] not in first.dims:
            raise ValueError(f"{v.name} isn't a coordinate of {first.name}: it needs one of its dimensions, and no other")
        values = block(f, head, v).astype(np.float32)
        bound = lambda name: np.float32(self.options[name]) if name in self.options else None
        eq, gt, lt = (bound(f"coordinate{x}") for x in ("eq", "gt", "lt"))
        if eq is not None:
            return first.dims.index(v.dims[0]), values == eq
        keep = np.ones(len(values), bool)
        keep = keep & ((values > gt) | np.isnan(values)) if gt is not None else keep  # NaN is the largest, as in Spark
        return first.dims.index(v.dims[0]), keep & (values < lt) if lt is not None else keep

    def _record_bytes(self, head: Header) -> int:
        """Bytes of the variables for each place along the first dimension."""
        v = head.variable(self.variables[0])
        found = [head.variable(n) for n in self.variables]
        return sum(math.prod(head.shape(x.name)[1:]) * np.dtype(TYPES[CODES[x.kind]]).itemsize for x in found if x.dims[:1] == v.dims[:1])

    def read(self, partition: Slabs | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left to read
            return
        for file, slabs in itertools.groupby(partition.slabs, key=lambda x: x.file):
            head = read_header(file)
            store, at = open_store(file)
            with store.open_input_file(at) as f:
                for slab in slabs:
                    if layout_of(self.options) == "slabs":
                        yield from self._slabs(f, head, head.variable(self.variables[0]), slab)
                    else:
                        yield from self._read(f, head, slab)

    def _read(self, f, head: Header, slab: Slab) -> Iterator[pa.RecordBatch]:
        first, shape, layout = head.variable(self.variables[0]), head.shape(self.variables[0]), layout_of(self.options)
        kept = {v.name: along(first, v) for v in (head.variable(n) for n in self.variables)}
        dim, passed = self._passed(f, head) if "coordinate" in self.options else (0, None)
        held: dict[str, tuple[boxes.Box, np.ndarray]] = {}
        for box in boxes.cut(slab.box, shape, BATCH_CELLS, self.align if layout == "boxes" else (), slab.start):
            size = tuple(b - a for a, b in zip(*box))
            cells = {}
            for name, sides in kept.items():
                own = tuple(tuple(x for x, k in zip(side, sides) if k) for side in box)
                if name not in held or held[name][0] != own:
                    held[name] = own, hyperslab(f, head, head.variable(name), own)
                cells[name] = np.broadcast_to(held[name][1].reshape([n if k else 1 for n, k in zip(size, sides)]), size)
            if all(kept[first.name]):
                held.pop(first.name, None)
            missing = {n: self._missing(head.variable(n), cells[n]) for n in self.variables}
            keep = None
            if passed is not None:
                own = passed[box[0][dim] : box[1][dim]]
                keep = None if own.all() else np.broadcast_to(own.reshape([-1 if i == dim else 1 for i in range(len(size))]), size)
            if layout == "boxes":
                gone = missing[first.name] if keep is None else ~keep if missing[first.name] is None else ~keep | missing[first.name]
                values = self._column(first, cells[first.name].reshape(-1), None if gone is None else gone.reshape(-1))
                lists = [pa.array([[a + s for a, s in zip(box[0], slab.start)]], pa.list_(pa.int32())), pa.array([list(size)], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)]
                yield pa.RecordBatch.from_arrays(lists, names=self.schema.names)
                continue
            if self.options.get("fillasnull") is None:
                full = [missing[n] for n in self.variables if all(kept[n])]
                if full and all(m is not None for m in full):
                    absent = np.logical_and.reduce(full)
                    keep = ~absent if keep is None else keep & ~absent
            at = None if keep is None else np.flatnonzero(keep)
            some = lambda x: np.ascontiguousarray(x).reshape(-1) if at is None else x.reshape(-1)[at]
            out = [pa.array(some(np.broadcast_to(np.arange(a + s, b + s, dtype=np.int32).reshape([-1 if i == k else 1 for k in range(len(size))]), size))) for i, (a, b, s) in enumerate(zip(*box, slab.start))]
            out += [self._column(head.variable(n), some(cells[n]), None if missing[n] is None else some(missing[n])) for n in self.variables]
            if "filecolumn" in self.options:
                out.append(pa.repeat(pa.scalar(slab.file), len(out[0])))
            yield pa.RecordBatch.from_arrays(out, names=self.schema.names)

    def _missing(self, v: Variable, values: np.ndarray) -> np.ndarray | None:
        given = self.options.get("fillasnull")
        if given is not None and given.lower() != "true":
            return None
        fill = fill_of(v)
        return equal_to(values, FILLS[v.kind] if fill is None and given is not None else fill)

    @staticmethod
    def _column(v: Variable, part: np.ndarray, missing: np.ndarray | None) -> pa.Array:
        found = pa.array(part, mask=missing)
        return found.cast(pa.int16()) if v.kind == "i1" else found

    def _slabs(self, f, head: Header, v: Variable, slab: Slab) -> Iterator[pa.RecordBatch]:
        align, (a, end), start = self.align[0], (side[0] for side in slab.box), slab.start[0]
        row = math.prod(head.shape(v.name)[1:])
        step = align * max(1, BATCH_CELLS // max(1, align * row))
        while a < end:
            b = min((a // step + 1) * step, end)
            cells = block(f, head, v, a, b).reshape(-1)
            if self.options.get("fillasnull") is None and equal_to(cells, fill_of(v)) is not None:
                raise ValueError(f"{slab.file} has absent cells, which slabs can't leave out: take boxes")
            cuts = [a, *range((a // align + 1) * align, b, align), b]
            ends = pa.array([(c - a) * row for c in cuts], pa.int32())
            lows = pa.array([c + start for c in cuts[:-1]], pa.int32())
            yield pa.RecordBatch.from_arrays([lows, pa.ListArray.from_arrays(ends, self._column(v, cells, None))], names=["low", "values"])
            a = b


class StreamReader(DataSourceStreamReader):
    """Files as they arrive, in order of their names: an offset is the last file's name, how many files there were up to it, and where the next
    one of others begins. Each file is whole when it gets its name, and stays. A file that comes after one with a later name would never be read: then the
    query stops with an error. A batch is all files that have come; a restart goes on behind the last one of the checkpoint."""

    def __init__(self, schema: StructType, options: dict):
        self.reader = Reader(schema, options)

    def initialOffset(self) -> dict:
        return {"file": "", "files": 0}

    def _names(self) -> list[str]:
        return [f.rpartition("/")[2] for f in find_files(self.reader.options["path"])]

    def latestOffset(self) -> dict:
        names = sorted(self._names())
        return {"file": names[-1], "files": len(names)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Slabs]:
        files = sorted(find_files(self.reader.options["path"]), key=lambda f: f.rpartition("/")[2])
        names = [f.rpartition("/")[2] for f in files]
        for offset in (start, end):
            if sum(n <= offset["file"] for n in names) != offset["files"]:
                raise ValueError(f"files up to {offset['file']} have changed: they must arrive in order of their names, and stay")
        if start["files"] == end["files"]:
            return []
        known = usable_files("", self.reader.options, files[: end["files"]])
        planned = self.reader.planned(known)
        new = set(files[start["files"] : end["files"]])
        kept = [Slabs([s for s in p.slabs if s.file in new]) for p in planned]
        return [p for p in kept if p.slabs]

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PruningReader(Reader):
    """Also reads only the places that Spark's comparisons of dimensions leave; Spark still checks every row."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.schema.names:
                self._narrow(f.attribute[0], f)
            yield f

    def _narrow(self, name: str, f: Filter) -> None:
        given = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        known = [x for x in given if isinstance(x, int)]
        if not known:
            return
        least, most = min(known), max(known)
        low = {EqualTo: least, In: least, GreaterThan: least + 1, GreaterThanOrEqual: least}.get(type(f))
        high = {EqualTo: most + 1, In: most + 1, LessThan: most, LessThanOrEqual: most + 1}.get(type(f))
        bounds = self.bounds.setdefault(name, [None, None])
        if low is not None:
            bounds[0] = low if bounds[0] is None else max(bounds[0], low)
        if high is not None:
            bounds[1] = high if bounds[1] is None else min(bounds[1], high)


def along(first: Variable, other: Variable) -> list[bool]:
    """For each dimension of the first variable whether the other one has it."""
    kept = [d in other.dims for d in first.dims]
    if [d for d, k in zip(first.dims, kept) if k] != other.dims:
        raise ValueError(f"{other.name} has other dimensions than {first.name}, or another order of them")
    return kept


def block(f, head: Header, v: Variable, a: int = 0, b: int | None = None) -> np.ndarray:
    """Records [a, b) of a variable, all by default."""
    shape = head.shape(v.name)
    end = (b if b is not None else shape[0], *shape[1:]) if shape else ()
    return hyperslab(f, head, v, ((a, *[0] * (len(shape) - 1)) if shape else (), end))


#: Bytes that one request reads, about, where more than one run is wanted.
REQUEST_BYTES = 1 << 22


def hyperslab(f, head: Header, v: Variable, box: boxes.Box) -> np.ndarray:
    """A box of a variable. Read in runs of bytes: gaps between them are read too where that is cheap."""
    shape, kind, (low, high) = head.shape(v.name), np.dtype(TYPES[CODES[v.kind]]), box
    size = [b - a for a, b in zip(low, high)]

    def bytes_at(place: int, length: int) -> bytes:
        raw = f.read_at(length, place)
        if len(raw) != length:
            raise ValueError(f"the file is cut off in {v.name}")
        return raw

    def within(begin: int, shape: tuple[int, ...], low: tuple[int, ...], size: list[int]) -> np.ndarray:
        """A box of an array that lies in one piece."""
        n, inner = len(shape), [math.prod(shape[i + 1 :]) for i in range(len(shape))]
        if not n:
            return np.frombuffer(bytes_at(begin, kind.itemsize), kind).reshape(())
        # one run holds the range along dimension d, and all of the dimensions behind it
        d = next(i for i in range(n) if i == n - 1 or math.prod(size[: i + 1]) * inner[i] <= max(4 * math.prod(size), REQUEST_BYTES // 16))
        parts = []
        for lead in itertools.product(*(range(a, a + m) for a, m in zip(low[:d], size[:d]))):
            first = sum(x * k for x, k in zip([*lead, low[d]], inner))
            run = np.frombuffer(bytes_at(begin + first * kind.itemsize, size[d] * inner[d] * kind.itemsize), kind).reshape(size[d], *shape[d + 1 :])
            parts.append(run[(slice(None), *(slice(a, a + m) for a, m in zip(low[d + 1 :], size[d + 1 :])))].reshape(-1))
        return np.concatenate(parts).reshape(size)

    if 0 in size:
        return np.zeros(size, kind.newbyteorder("="))
    if not (v.record and head.record_size != v.size):
        found = within(v.begin, shape, low, size)
    elif head.record_size > REQUEST_BYTES // 4:  # a record of all variables is large: only this one's part of each
        found = np.stack([within(v.begin + r * head.record_size, shape[1:], low[1:], size[1:]) for r in range(low[0], high[0])])
    else:
        parts, own = [], math.prod(shape[1:]) * kind.itemsize
        step = REQUEST_BYTES // head.record_size
        for r in range(low[0], high[0], step):
            n = min(step, high[0] - r)
            raw = bytes_at(v.begin + r * head.record_size, (n - 1) * head.record_size + own).ljust(n * head.record_size, b"\0")
            rows = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, -1)[:, :own]).view(kind).reshape(n, *shape[1:])
            parts.append(rows[(slice(None), *(slice(a, b) for a, b in zip(low[1:], high[1:])))])
        found = np.concatenate(parts)
    return found.astype(kind.newbyteorder("="))


def usable_files(path: str, options: dict, files: list[str] | None = None) -> list[tuple[str, Header]]:
    skip = options.get("ignoreinvalid", "false").lower() == "true"

    def opened(file: str) -> Header | None:
        try:
            return read_header(file)
        except ValueError as e:
            if skip:
                return None
            raise ValueError(f"{file}: {e}") from None

    files = find_files(path) if files is None else files
    with ThreadPoolExecutor(32) as pool:  # a header is a request to the store: many wait at once
        found = [(f, h) for f, h in zip(files, pool.map(opened, files)) if h is not None]
    if not found:
        raise ValueError(f"no NetCDF-3 file at {path}")
    return found


@dataclass
class Wrote(WriterCommitMessage):
    file: str | None


class Writer(DataSourceArrowWriter):
    """Each partition is one file, written to a folder of this write and moved to the target when all are there. An append keeps
    what is there; an overwrite takes away the *.nc files of before. The attribute `tilewise_corner` holds a file's first coordinates.

    Columns are `variable` (default: `value`, which is then stored under that name; several by commas are several variables),
    `recordVariable` (variables of the first dimension only: a record's first row says their value), and the dimensions: all others, in order.
    Without `shape` a file is a dense block over the box that the partition's cells span, put together in memory. With `shape` (the lengths
    of all dimensions but the first, by commas) rows must come in order of the dimensions, as `ranges.repartitioned` deals and
    sorts them: then a file has an unlimited first dimension, its records go out as they come, and a task holds one record, or of a single variable one
    run of `BATCH_CELLS` cells, whatever the partition's size. Absent and null cells get the fill value."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.overwrite, self.write_id = schema, options, overwrite, uuid.uuid4().hex[:16]
        self.staging = f"{options['path'].rstrip('/')}/_{self.write_id}"
        listed = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()]
        named, self.by_record = listed("variable"), listed("recordvariable")
        #: column -> name in the file
        self.variables = {n: n for n in named} if len(named) > 1 or named and named[0] in schema.names else {"value": named[0] if named else "var1"}
        missing = [n for n in (*self.variables, *self.by_record) if n not in schema.names]
        if missing:
            raise ValueError(f"a column `{missing[0]}` and one for each dimension are needed")
        self.dims = [n for n in schema.names if n not in self.variables and n not in self.by_record]
        self.kinds = {}
        for n in (*self.variables, *self.by_record):
            kind = schema[n].dataType.simpleString()
            if kind not in KINDS:
                raise ValueError(f"NetCDF-3 has no numbers for {kind}: `{n}`")
            self.kinds[n] = KINDS[kind]
        self.inner = tuple(int(x) for x in listed("shape")) if "shape" in options else None
        if self.inner is not None and (len(self.inner) != len(self.dims) - 1 or min(self.inner, default=1) < 1):
            raise ValueError("shape has a positive length for each dimension but the first")
        if self.inner is None and (len(self.variables) > 1 or self.by_record):
            raise ValueError("several variables need the option shape, and rows in order")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        full = (b for b in iterator if b.num_rows)
        first = next(full, None)
        if first is None:
            return Wrote(None)
        store, path = open_store(self.staging)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        file = f"{self.staging}/part-{self.write_id}-{task.partitionId():05d}-{task.taskAttemptId()}.nc"
        (self._dense if self.inner is None else self._records)(file, itertools.chain([first], full))
        return Wrote(file)

    def _places(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        at = np.stack([batch.column(d).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[d].to_numpy() for d in self.dims], axis=1)
        if at.dtype == object or at.dtype.kind == "f":
            raise ValueError("a cell's place has no nulls")
        at = at.astype(np.int64)
        if at.min() < -(1 << 31) or at.max() >= 1 << 31:
            raise ValueError("coordinates are 32-bit integers")
        return at

    def _filled(self, column, name: str) -> np.ndarray:
        """A column's values with the fill value for nulls."""
        kind = self.kinds[name]
        if self.schema[name].dataType.simpleString() == "bigint":
            whole = column.drop_null().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.drop_null().to_numpy()
            if len(whole) and max(abs(int(whole.min())), abs(int(whole.max()))) > 1 << 53:
                raise ValueError("NetCDF-3 has no 64-bit integers, and a double holds them up to 2**53 only")
        gone, values = column.is_null(), column.fill_null(0)
        gone, values = (x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy() for x in (gone, values))
        return np.where(gone, FILLS[kind], values).astype(kind)

    def _dense(self, file: str, batches: Iterator[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(list(batches))
        at = self._places(table)
        corner = at.min(axis=0)
        shape = at.max(axis=0) - corner + 1
        if math.prod(map(int, shape)) > int(self.options.get("densecells", DENSE_CELLS)):
            raise ValueError("a partition spans too many cells for one dense file: repartition by ranges of the key first, or give the shape and rows in order")
        ((column, name),) = self.variables.items()
        kind = self.kinds[column]
        cells = np.full(shape, FILLS[kind], kind)
        cells[tuple((at - corner).T)] = self._filled(table[column], column)
        dimensions = [(d, int(n)) for d, n in zip(self.dims, shape)]
        write_file(file, dimensions, {name: (self.dims, cells, {"_FillValue": np.array([FILLS[kind]], kind)})}, attributes={CORNER: corner.astype(np.int32)})

    def _records(self, file: str, batches: Iterator[pa.RecordBatch]) -> None:
        row, inner = math.prod(self.inner), self.inner
        strides = np.array([math.prod(inner[i + 1 :]) for i in range(len(inner))], np.int64)
        made = []
        for column, name in {**self.variables, **{n: n for n in self.by_record}}.items():
            own = column in self.variables
            v = Variable(name, list(range(len(self.dims))) if own else [0], self.kinds[column], record=True, attributes={"_FillValue": np.array([FILLS[self.kinds[column]]], self.kinds[column])})
            v.size = (row if own else 1) * np.dtype(v.kind).itemsize
            made.append((column, v))
        if len(made) > 1:
            for _, v in made:
                v.size = -(-v.size // 4) * 4
        # of a single variable runs of any length can go out; of several whole records
        held = row if len(made) > 1 else max(1, min(BATCH_CELLS, row * BATCH_CELLS))
        fresh = lambda: {c: np.full(held if c in self.variables else 1, FILLS[v.kind], v.kind) for c, v in made}
        now, base, last, begun = fresh(), 0, -1, None
        store, at = open_store(file)
        with store.open_output_stream(at) as out:

            def put(cells: int) -> None:
                for c, v in made:
                    big = now[c][: cells if c in self.variables else 1].astype(np.dtype(v.kind).newbyteorder(">"))
                    out.write(big.tobytes() if len(made) == 1 else big.tobytes().ljust(v.size, b"\0"))

            for batch in batches:
                places = self._places(batch)
                if begun is None:
                    begun = int(places[0, 0])
                    dimensions = [(self.dims[0], 0), *zip(self.dims[1:], inner)]
                    out.write(build_header(dimensions, [v for _, v in made], STREAMING, {CORNER: np.array([begun, *[0] * len(inner)], np.int32)}))
                if len(inner) and ((places[:, 1:] < 0) | (places[:, 1:] >= inner)).any():
                    raise ValueError(f"a cell lies outside of the shape {inner}")
                number = (places[:, 0] - begun) * row + (places[:, 1:] @ strides if len(inner) else 0)
                if (np.diff(number, prepend=last) < 0).any():
                    raise ValueError("rows must come in order of the dimensions: sort within partitions first")
                if np.diff(number, prepend=max(last, 0)).max() > DENSE_CELLS + row:
                    raise ValueError("too many absent cells in a row for a dense file")
                last = int(number[-1])
                values = {c: self._filled(batch.column(c), c) for c, _ in made}
                done = 0
                while done < len(number):
                    while number[done] >= base + held:
                        put(held)
                        now, base = fresh(), base + held
                    end = int(np.searchsorted(number, base + held))
                    for c, _ in made:
                        if c in self.variables:
                            now[c][number[done:end] - base] = values[c][done:end]
                        elif now[c][0] == FILLS[self.kinds[c]]:
                            now[c][0] = values[c][done]
                    done = end
            rest = (last // row + 1) * row - base  # up to the end of the last record
            while rest > 0:
                put(min(held, rest))
                now, rest = fresh(), rest - held

    def commit(self, messages: list) -> None:
        folder = self.options["path"].rstrip("/")
        store, _ = open_store(folder)
        before = find_files(folder) if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                store.move(open_store(m.file)[1], open_store(f"{folder}/{m.file.rpartition('/')[2]}")[1])
        for file in before:
            store.delete_file(open_store(file)[1])
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, at = open_store(self.staging)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class NetCDF3(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> StructType:
        o = self._options()
        names, (_, head) = wanted(o), usable_files(o["path"], o)[0]
        kinds = [head.variable(n).kind for n in names]
        if any(k not in SPARK_TYPES for k in kinds):
            raise ValueError("text variables aren't arrays of numbers")
        if layout_of(o) == "slabs":
            return StructType([StructField("low", IntegerType()), StructField("values", ArrayType(SPARK_TYPES[kinds[0]], False))])
        if layout_of(o) == "boxes":
            places = ArrayType(IntegerType(), False)
            return StructType([StructField("corner", places), StructField("lengths", places), StructField("values", ArrayType(SPARK_TYPES[kinds[0]]))])
        dims = head.names(names[0])
        out = [StructField(n, IntegerType()) for n in dims]
        called = [n + "_value" if n in dims else n for n in names] if len(names) > 1 else ["value"]
        out += [StructField(n, SPARK_TYPES[k]) for n, k in zip(called, kinds)]
        if "filecolumn" in o:
            out.append(StructField(o["filecolumn"], StringType()))
        if len({f.name.lower() for f in out}) < len(out):
            raise ValueError(f"two columns of one name: {', '.join(f.name for f in out)}")
        return StructType(out)

    def reader(self, schema: StructType) -> Reader:
        o = self._options()
        return (PruningReader if o.get("pushdown", "false").lower() == "true" and layout_of(o) == "cells" else Reader)(schema, o)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, self._options())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self._options(), overwrite)


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """The source with push-down of comparisons of the first dimension."""
    spark.dataSource.register(NetCDF3)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("netcdf3").options(pushdown="true", **options).load(path)


def describe(path: str) -> dict[str, tuple[int, ...]]:
    """Variables of a file and their shapes."""
    head = read_header(find_files(path)[0])
    return {n: head.shape(n) for n in head.variables}


def describe_partitions(spark: SparkSession, path: str, inside: bool = False, **options) -> DataFrame:
    """How a scan would be cut, a row for each slab: partition, file, low and high (records of the file), first (the place of `low` in the
    array), cells; with `inside` also corner and lengths of the slab in the file."""
    source = NetCDF3({**options, "path": path})
    rows = []
    for k, p in enumerate(source.reader(source.schema()).partitions()):
        for s in p.slabs:
            (low, *_), (high, *_) = s.box
            rows.append((k, s.file, low, high, low + s.start[0], boxes.cells(s.box), list(s.box[0]), [b - a for a, b in zip(*s.box)]))
    out = spark.createDataFrame(rows, "partition int, file string, low long, high long, first long, cells long, corner array<long>, lengths array<long>")
    return out if inside else out.drop("corner", "lengths")
