"""Token ids in binary files, each document compressed by itself with a shared dictionary (operator 2).

A data set is a folder of shards in ascending doc_id order. A shard holds, one after another:

    magic 8 bytes | zstandard frames, one for each document | index | trailer

Each frame is a document's ids as little-endian unsigned 32-bit integers, compressed with the
dictionary. The index has for each document three little-endian signed 64-bit integers: doc_id,
end of its frame in the file, number of ids. The trailer (JSON, its length in the last 4 bytes)
names the dictionary by the SHA-256 of its bytes, and where the index starts. `dictionary.zdict`
lies beside the shards. A short document is read by one look into the index and one frame.

The dictionary is fitted on a bounded sample (`SAMPLE_DOCS` documents, the smallest by a hash of
doc_id, `SAMPLE_IDS` ids from the middle of each); it changes sizes only, never what is read.

Defined cases: null text is an empty text (its end id alone); an empty table gives no shards and
no rows; repeated doc_ids lie side by side, ordered by a hash of their text, but those of a doc_id
that fills several shards are dealt over these in no order; a null doc_id comes first and is stored
as the least 64-bit integer; extra columns are ignored.

A shard's file has a name of its task's attempt. The table that `write` returns names the files that
count; one that a lost attempt left behind isn't among them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .storage import new_path, sampled, written

END_ID = 2
MAGIC = b"ZTOKIDS1"
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 2_000, 64 << 10
#: Compressed bytes of a shard, about.
SHARD_BYTES = 64 << 20
#: Shards of a data set at most (larger corpora get larger shards): the driver holds a bound for each, and a sketch of ten times as many ids.
MOST_SHARDS = 16_384
#: Bytes of frames that are read at once, about.
READ_BYTES = 8 << 20
NULL_ID = -(1 << 63)


def filesystem(path: str):
    """(file system, path in it): local folders and every store that Arrow opens by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def encoded(docs: DataFrame, dictionary: bytes, bounds: list[int], end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, frame, text_hash, shard) of each document of `docs` (doc_id, text). A shard begins above each bound; a
    bound that comes m + 1 times is a doc_id with m or more shards full, and its rows are dealt over the m that lie between."""
    path = path or tokens.tokenizer_path()
    limits = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, squeeze = tokens.encoder(path), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            shard = np.searchsorted(limits, doc_ids, side="left")
            spare = np.searchsorted(limits, doc_ids, side="right") - shard - 1
            shard = (shard + (spare > 0) * (1 + batch.column(3).to_numpy() % np.maximum(spare, 1))).astype(np.int32)
            for first, texts in tokens.chunks(batch.column(1)):
                ids, sizes = enc.encode(texts)
                ends = np.cumsum(sizes)
                flat, sizes = np.insert(ids, ends, np.uint32(end_id)).astype("<u4"), sizes + 1
                starts = np.cumsum(sizes) - sizes
                frames = [squeeze.compress(flat[a : a + n].data) for a, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes), pa.array(frames, pa.binary()), batch.column(2).slice(first, len(texts)), pa.array(shard[first : first + len(texts)])], names=["doc_id", "n_tokens", "frame", "text_hash", "shard"])

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, frame binary, text_hash long, shard int")


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def train(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> bytes:
    """A zstandard dictionary from serialised ids of a bounded sample; empty bytes where the sample is too small for one."""
    import zstandard

    middle_of = F.expr(f"substring(text, greatest(1, cast(length(text) / 2 as int) - {4 * SAMPLE_IDS}), {8 * SAMPLE_IDS})")
    texts = sampled(docs.select("doc_id", middle_of.alias("t")), "doc_id", SAMPLE_DOCS, docs.count())
    samples = []
    for one in tokens.encode_lists([r["t"] for r in texts.collect()], path):
        middle = max(0, (len(one) - SAMPLE_IDS) // 2)
        samples.append(np.append(one[middle : middle + SAMPLE_IDS], end_id).astype("<u4").tobytes())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def write(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes `docs` to `folder` and returns the shards: shard, file, n_docs, n_tokens, bytes."""
    raw = train(docs, end_id, path)
    if shards is None:
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = min(MOST_SHARDS, max(1, size // SHARD_BYTES, min(32, size >> 22)))
    # quantiles of the ids alone: a range shuffle would tokenise everything a second time to find them
    steps = [k / shards for k in range(1, shards)]
    bounds = sorted(int(x) for x in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", steps, 0.1 / shards)) if steps else []
    frames = encoded(docs, raw, bounds, end_id, path)
    store, at = filesystem(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/dictionary.zdict") as out:
        out.write(raw)
    digest = hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, at = filesystem(folder)
        out, index, end, name = None, [], len(MAGIC), f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.zids"
        own = f"{at}/_{name}"  # in place under its name when it is whole
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(own)
                out.write(MAGIC)
            blobs = batch.column(2)
            size = np.diff(np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, 4 * blobs.offset))
            index.append(np.stack([batch.column(0).to_numpy(), end + np.cumsum(size), batch.column(1).to_numpy()], axis=1))
            out.write(b"".join(blobs.to_pylist()))
            end += int(size.sum())
        if out is None:
            return
        table = np.concatenate(index).astype("<i8")
        trailer = json.dumps({"dictionary_sha256": digest, "index": end, "docs": len(table)}).encode()
        out.write(table.tobytes() + trailer + len(trailer).to_bytes(4, "little"))
        out.close()
        store.move(own, f"{at}/{name}")
        values = [[shard], [f"{folder}/{name}"], [len(table)], [int(table[:, 2].sum())], [end + table.nbytes + len(trailer) + 4]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["shard", "file", "n_docs", "n_tokens", "bytes"])

    dealt = frames.repartitionById(len(bounds) + 1, F.col("shard")).drop("shard").sortWithinPartitions("doc_id", "text_hash")
    return written(dealt.mapInArrow(run, "shard long, file string, n_docs long, n_tokens long, bytes long"), "shards")


class Shard:
    """One shard: its index, and the ids of single documents."""

    def __init__(self, file: str, dictionary: bytes | None = None):
        import zstandard

        store, at = filesystem(file)
        self.file = store.open_input_file(at)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(4, size - 4), "little")
        trailer = json.loads(self.file.read_at(n, size - 4 - n))
        if dictionary is None:
            with store.open_input_file(f"{at.rpartition('/')[0]}/dictionary.zdict") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != trailer["dictionary_sha256"]:
            raise ValueError(f"{file} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(24 * trailer["docs"], trailer["index"]), "<i8").reshape(-1, 3)
        self.starts = np.concatenate([[len(MAGIC)], self.index[:-1, 1]])
        self.opened = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, row: int) -> np.ndarray:
        start, end = int(self.starts[row]), int(self.index[row, 1])
        return np.frombuffer(self.opened.decompress(self.file.read_at(end - start, start)), "<u4")

    def ranges(self, most: int = 1000) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents' ids in order: (row of the first, ids of each), about `READ_BYTES` of the file at a time."""
        first, n = 0, len(self.index)
        while first < n:
            last = int(np.searchsorted(self.index[:, 1], self.starts[first] + READ_BYTES, side="right"))
            last = min(max(last, first + 1), first + most)
            raw = memoryview(self.file.read_at(int(self.index[last - 1, 1] - self.starts[first]), int(self.starts[first])))
            cuts = self.starts[first:last] - self.starts[first], self.index[first:last, 1] - self.starts[first]
            yield first, [np.frombuffer(self.opened.decompress(raw[a:b]), "<u4") for a, b in zip(*cuts)]
            first = last

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this doc_id, from their frames alone."""
        a, b = (int(np.searchsorted(self.index[:, 0], doc_id, side)) for side in ("left", "right"))
        return [self.ids(row) for row in range(a, b)]


def read(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Every document of the shards (a table as `write` returns it): doc_id, start (ids before it in all shards), n_tokens,
    ids_crc32, and with `keep_ids` ids."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard of SHARD_BYTES
    placed = shards.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(file)
                starts = base + np.cumsum(shard.index[:, 2]) - shard.index[:, 2]
                for first, ids in shard.ranges():
                    part = shard.index[first : first + len(ids)]
                    wrong = [int(d) for d, n, x in zip(part[:, 0], part[:, 2], ids) if len(x) != n]
                    if wrong:
                        raise ValueError(f"{file}: frames and index differ at doc_id {wrong[0]}")
                    crc = np.fromiter((zlib.crc32(x) for x in ids), np.int64, len(ids))
                    out = [pa.array(part[:, 0], mask=part[:, 0] == NULL_ID), pa.array(starts[first : first + len(ids)]), pa.array(part[:, 2]), pa.array(crc)]
                    if keep_ids:
                        out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    n = shards.count()
    return placed.repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def round_trip(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes all of `docs` and reads the files back."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, folder or new_path(spark, "token-files"), end_id, path))
