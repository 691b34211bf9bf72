"""Token counts of documents in flat token files without an index, by a separator scan (operator 3).

A flat file is nothing but little-endian unsigned 16- or 32-bit ids; each document ends with an
end-of-document id. Files are read in blocks of `BLOCK_BYTES`. One pass finds for each block how
many separators it has and where its last one is, by a vectorised comparison. A prefix scan over
the blocks of each file (running sum of the counts, running maximum of the places) tells each
block the number of the document it begins in and where that document began, however many blocks
ago. A second pass gives each document where its separator lies.

Defined cases: ids after a file's last separator are one more document with terminated = false;
two separators side by side hold an empty document (0 tokens); an empty file has no rows. For
`flat_files`: null text is an empty document, an empty table gives no files, repeated doc_ids are
separate documents, extra columns are ignored, and a text with the end-of-document id among its ids
is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .storage import new_path, written
from .token_files import filesystem

BLOCK_BYTES = 4 << 20
#: No text has this id: the vocabulary ends at 49407, its own special token, which texts can hold.
END_ID = 0xFFFF


def flat_files(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes a flat file of 16-bit ids for each partition of `docs` (doc_id, text), without a shuffle. Returns what the files
    themselves don't hold: file, bytes, and doc_ids in the order written (lists of at most some thousands)."""
    path = path or tokens.tokenizer_path()
    store, at = filesystem(folder)
    store.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, number, size = tokens.encoder(path), None, 0, 0
        store, at = filesystem(folder)
        # a rerun writes a file of its own: the rows of the attempt that Spark commits name it, and no other file is read
        name = f"flat-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
        for batch in batches:
            for first, texts in tokens.chunks(batch.column(1)):
                ids, sizes = enc.encode(texts)
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("this vocabulary needs 32-bit ids")
                if (ids == end_id).any():
                    raise ValueError(f"a text holds the end-of-document id {end_id}")
                out = out or store.open_output_stream(f"{at}/{name}")
                flat = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u2")
                out.write(flat.data)
                size += flat.nbytes
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.arange(number, number + n)), batch.column(0).slice(first, n), pa.array(np.full(n, size))], names=["file", "number", "doc_id", "bytes"])
                number += n
        if out is not None:
            out.close()

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, number long, doc_id long, bytes long"), "flat-files")


def _separators(file: str, block: int, width: int, block_bytes: int, end_id: int) -> tuple[np.ndarray, int]:
    """Places of the separators in a block, counted from the file's start, and the place behind the block."""
    store, at = filesystem(file)
    with store.open_input_file(at) as f:
        ids = np.frombuffer(f.read_at(block_bytes, block * block_bytes), f"<u{width}")
    first = block * block_bytes // width
    return first + np.flatnonzero(ids == end_id), first + len(ids)


def scan(files: DataFrame, end_id: int = END_ID, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document of flat `files` (file, bytes): file, number (from 0 in each file), start, n_tokens (without the
    separator), terminated."""
    if width not in (2, 4) or block_bytes % width:
        raise ValueError("width is 2 or 4 bytes, and a block holds whole ids")
    blocks = files.where("bytes > 0").select("file", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block_bytes})")).alias("block"), F.expr(f"(bytes - 1) div {block_bytes}").alias("last_block"))
    dealt = written(blocks.repartition(F.col("file"), F.col("block")), "blocks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_separators(f, b, width, block_bytes, end_id)[0] for f, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in found], pa.int64()), pa.array([int(x[-1]) if len(x) else -1 for x in found], pa.int64())], names=["file", "block", "last_block", "n", "last"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, behind = _separators(row["file"], row["block"], width, block_bytes, end_id)
                starts = np.concatenate([[row["begun"]], ends + 1])
                closed = np.ones(len(starts), bool)
                closed[-1] = False
                stops = np.append(ends, behind)
                if row["block"] < row["last_block"] or starts[-1] == behind:  # the open document ends in a later block, or there is none
                    starts, stops, closed = starts[:-1], stops[:-1], closed[:-1]
                n = len(starts)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * n, pa.string()), pa.array(row["before"] + np.arange(n)), pa.array(starts), pa.array(stops - starts), pa.array(closed)], names=["file", "number", "start", "n_tokens", "terminated"])

    summary = dealt.mapInArrow(look, "file string, block long, last_block long, n long, last long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    placed = summary.select("file", "block", "last_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("begun"))
    spread = written(placed, "scanned").repartition(F.col("file"), F.col("block"))
    return spread.mapInArrow(emit, "file string, number long, start long, n_tokens long, terminated boolean")


def document_counts(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes `docs` as flat files and counts their documents' tokens by scanning them: doc_id, n_tokens, start, terminated."""
    wrote = flat_files(docs, folder or new_path(docs.sparkSession, "flat"), end_id, path)
    files = wrote.groupBy("file").agg(F.max("bytes").alias("bytes"))
    # written ids compress so well that the size of their files would suggest a broadcast
    return wrote.select("file", "number", "doc_id").hint("merge").join(scan(files, end_id, 2, block_bytes), ["file", "number"]).select("doc_id", "n_tokens", "start", "terminated")
