"""Shards of bounded size by extendible hashing (operator 7).

A row's 60 bits are 32 of the MD5 of its doc_id and 28 of the MD5 of its text. A bucket is a prefix
of bits; the empty prefix holds everything. Only a bucket of more than `limit` bytes splits on one
more bit, so each shard is the shortest prefix whose rows fit. The directory maps bit prefixes of
equal length (cells) to shards. Sums over prefixes are made from the cells' sums, not the rows.

Rows that still share all bits when their bucket is too large are equal rows: they go to pages of
that bucket, in order. A single row over the limit is a shard by itself.

Defined cases: a null doc_id counts as an empty string, a null text as no bytes; repeated rows
are kept; an empty table gives no rows; extra columns are kept by `assign` (columns named as its
results are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

LIMIT = 1 << 20
BITS = 60
#: Cells of the directory for each shard, as a power of two; bits that a further round looks at.
FINE, MORE = 3, 16
#: Down to this depth oversized prefixes, at most 2 ** (TOP + 1), are broadcast.
TOP = 12
#: Parts in which the equal rows of one prefix are numbered.
SALTS = 512
#: A cell with more than a HOT-th of all rows is hot: fewer than HOT are, so their leaves are broadcast and their rows dealt over SPREAD keys.
HOT, SPREAD = 1024, 1 << 20


def bits(key: str = "doc_id", text: str = "text") -> Column:
    """60 bits of a row, as a number."""
    part = lambda c, n: F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1, n)
    return F.conv(F.concat(part(key, 8), part(text, 7)), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """From (bits, bytes): the leaf of every cell: cell, cell_depth, n (its rows), depth, prefix, shard_bytes. Cells don't overlap."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, (total // max(1, limit)).bit_length()) + FINE)
    found, floor, active = None, 0, rows
    while True:
        cells = written(active.groupBy(F.shiftright("bits", BITS - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("bits").alias("n")), "cells")
        levels = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = written(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")), "sums")
        # a prefix near the root that is no shard has very many cells, which would all be dealt to one task
        crowded = sums.where((F.col("shard_bytes") > limit) & (F.col("depth") <= TOP)).select("depth", "prefix")
        levels = levels.join(F.broadcast(crowded), ["depth", "prefix"], "left_anti")
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        # levels are many times the written cells, whose files' size would suggest a broadcast
        leaf = levels.hint("merge").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.first("n").alias("n"), F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        leaf = written(leaf.select("cell", F.lit(depth).alias("cell_depth"), "n", "leaf.*"), "leaves")
        found = leaf if found is None else found.union(leaf)
        if depth == BITS:
            return found
        large = cells.join(leaf.select("cell"), "cell", "left_anti").select("cell")
        if large.isEmpty():
            return found
        cell_of = F.shiftright("bits", BITS - depth)
        active = written(active.join(large, cell_of == F.col("cell"), "left_semi"), "oversized")
        floor, depth = depth + 1, min(BITS, depth + MORE)


def _placed(rows: DataFrame, leaves: DataFrame, depth: int, most: int) -> DataFrame:
    """`rows` whose cell of `depth` bits has a leaf, with it. No key of the join has more than `most` rows: those of larger cells
    have their leaf from a broadcast before and are dealt evenly."""
    names = ("depth", "prefix", "shard_bytes")
    of = lambda df, tag: df.select(F.col("cell").alias("__cell"), *(F.col(c).alias(f"__{tag}_{c}") for c in names))
    hot, cold = of(leaves.where(F.col("n") > most), "hot"), of(leaves.where(F.col("n") <= most), "cold")
    early = rows.withColumn("__cell", F.shiftright("__bits", BITS - depth)).join(F.broadcast(hot), "__cell", "left")
    dealt = F.when(F.col("__hot_depth").isNull(), F.col("__cell")).otherwise(-1 - F.monotonically_increasing_id() % SPREAD)
    every = early.withColumn("__cell", dealt).join(cold, "__cell", "left")
    return every.select(*(f"`{c}`" for c in rows.columns), *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(f"__{c}") for c in names)).where(F.col("__depth").isNotNull())


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with shard (bits of the prefix, and the page where one is needed), shard_depth and shard_bytes."""
    kept = [f"`{c}`" for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    narrow = written(docs.select(bits(key, text).alias("bits"), size.alias("bytes")), "bits")
    leaves = directory(narrow, limit)
    df = docs.select(*kept, bits(key, text).alias("__bits"), size.alias("__bytes"))
    depths = {r["cell_depth"]: r["n"] for r in leaves.groupBy("cell_depth").agg(F.sum("n").alias("n")).collect()}  # at most BITS
    placed = None
    for d in sorted(depths):  # one, but for buckets beyond the first directory's depth
        part = _placed(df, leaves.where(F.col("cell_depth") == d), d, sum(depths.values()) // HOT)
        placed = part if placed is None else placed.union(part)
    if placed is None:
        placed = df.select("*", F.lit(0).alias("__depth"), F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__shard_bytes"))
    name = F.concat(F.lit("b"), F.when(F.col("__depth") > 0, F.lpad(F.conv(F.col("__prefix").cast("string"), 10, 2), F.col("__depth"), F.lit("0"))).otherwise(""))
    result = lambda page: [*kept, F.concat(name, page).alias("shard"), F.col("__depth").alias("shard_depth"), F.col("__shard_bytes").alias("shard_bytes")]
    over = (F.col("__depth") == BITS) & (F.col("__shard_bytes") > limit)
    if leaves.where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit)).isEmpty():
        return placed.select(*result(F.lit("")))
    # rows with all bits alike are equal: as many to a page as fit, numbered in parts of each prefix
    alike = written(placed.where(over).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "alike")
    in_order = Window.partitionBy("__prefix").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy("__prefix", "__salt").count().select("__prefix", "__salt", F.coalesce(F.sum("count").over(in_order), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__prefix", "__salt").orderBy("__bytes")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("__bytes"))))
    paged = alike.join(parts, ["__prefix", "__salt"]).withColumn("__page", F.floor(number / each))
    return placed.where(~over).select(*result(F.lit(""))).union(paged.select(*result(F.concat(F.lit("+"), F.col("__page").cast("string")))))


def sql(limit: int = LIMIT) -> str:
    """The query's rows as DuckDB SQL: every prefix's sum, and for each row the shortest that fits."""
    return f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) || substr(md5(coalesce(text, '')), 1, 7))::BIGINT AS bits FROM documents
),
levels AS (SELECT doc_id, bytes, d::INT AS depth, bits >> ({BITS} - d)::INT AS prefix FROM rows, generate_series(0, {BITS}) AS g(d)),
sums AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes FROM levels GROUP BY ALL),
leaf AS (
  SELECT l.doc_id, l.depth, l.prefix, s.shard_bytes, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS n
  FROM levels l JOIN sums s USING (depth, prefix) WHERE s.shard_bytes <= {limit} OR l.depth = {BITS}
)
SELECT doc_id, 'b' || CASE WHEN depth > 0 THEN substr(prefix::BIT::VARCHAR, 65 - depth) ELSE '' END AS shard, depth AS shard_depth, shard_bytes FROM leaf WHERE n = 1
"""
