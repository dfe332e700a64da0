"""Extendible hashing: shards are hash prefixes, and only a bucket above its byte limit splits on another bit.

A row's key is a string of bits: 60 of md5(id), 60 of md5(text) for rows of one id, and 60 of the row's number in its
table for rows that are equal in both, so that even a third of all rows under one key splits further. The directory is
made from cells (prefixes a few bits longer than the shards need), each of which is counted at every depth up to its own;
a cell's shard is its shortest prefix that fits the limit. Cells that do not fit go on with more bits, from their own
rows alone. Everything is DataFrame operations; no step needs more than one cell's rows together.

Defined results: null texts have no bytes; null ids hash as the empty text; one row larger than the limit is a shard of its
own; an empty table has no shard; all columns stay, and clashing ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Text bytes of a shard at most: what a training loader reads at once. Archives would take more.
SHARD_BYTES = 1 << 20
#: Bits by which the cells of a round are longer than shards of even size would be.
SPARE = 4
STEP = 12
BITS = 180
ADDED = ["shard", "depth", "shard_bytes", "shard_docs"]


def _bits(text):
    """60 bits of md5, as text."""
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2), 60, "0")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with bytes and key bits. The rows' numbers hold for as long as the result is read from where it is staged."""
    return docs.withColumns({
        "_bytes": F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long"),
        "_bits": F.concat(_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), _bits(F.coalesce(F.col("text").cast("string"), F.lit(""))),
                          _bits(F.monotonically_increasing_id().cast("string"))),
    })


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(cell, cell_depth, shard, depth, shard_bytes, shard_docs): every cell and the shard that holds it.

    ``rows`` has _bits and _bytes and is read once per round; rounds after the first see oversized cells only.
    """
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    out, left = None, rows
    while True:
        cells = left.groupBy(F.substring("_bits", 1, high).alias("cell")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("docs"))
        levels = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        sums = levels.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = stage(sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)), "hash-fits")
        # Short prefixes hold many cells and fit only if everything is small: depths at which nothing fits are not joined.
        first = fits.agg(F.min("depth")).first()[0]
        at = levels.where(F.col("depth") >= (high if first is None else first)).select("cell", "depth", F.expr("substring(cell, 1, depth)").alias("shard"))
        found = stage(at.join(fits, ["depth", "shard"], "left").groupBy("cell").agg(
            F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "shard", "shard_bytes", "shard_docs"))).alias("leaf")), "hash-cells")
        made = found.where("leaf IS NOT NULL").select("cell", F.lit(high).alias("cell_depth"), "leaf.shard", "leaf.depth", "leaf.shard_bytes", "leaf.shard_docs")
        out = made if out is None else out.unionByName(made)
        over = found.where("leaf IS NULL").select("cell")
        if high == BITS or over.isEmpty():
            return out
        left = left.join(over, F.substring("_bits", 1, high) == F.col("cell"), "left_semi")
        low, high = high + 1, min(BITS, high + STEP)


def assigned(rows: DataFrame, limit: int) -> DataFrame:
    """Staged rows (keys in _bits and _bytes) with their shard; one join per round of the directory, the first of which holds nearly all rows."""
    made = directory(rows.select("_bits", "_bytes"), limit)
    names = [c for c in rows.columns if c not in ("_bits", "_bytes")]
    none = [F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs")]
    out = rows.select(*names, *none).limit(0)
    for (depth,) in made.select("cell_depth").distinct().collect():
        own = made.where(F.col("cell_depth") == depth).select(F.col("cell").alias("_cell"), *ADDED)
        out = out.unionByName(rows.join(own, F.substring("_bits", 1, depth) == F.col("_cell")).select(*names, *ADDED))
    return out


def sharded(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with shard (its bits), depth, shard_bytes and shard_docs."""
    docs = docs.drop(*ADDED)
    own = {c: f"{c}__own" for c in docs.columns if c in ("_bits", "_bytes", "_cell")}  # set aside, then named as before
    made = assigned(stage(keyed(docs.withColumnsRenamed(own)), "hash-rows"), limit)
    return made.withColumnsRenamed({v: k for k, v in own.items()})


def write(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """One folder per shard; a shard's rows are brought together by its bits, so that it is one file."""
    made = sharded(docs, limit)
    made.withColumn("_shard", F.concat(F.lit("s"), "shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)


def query(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    return assigned(stage(keyed(docs.select("doc_id", "text")).drop("text"), "hash-rows"), limit)


def oracle(limit: int = SHARD_BYTES) -> str:
    """The same for tables whose rows differ in id or text."""
    bits = "lpad(bin(CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)), 60, '0')"
    key = bits.format("coalesce(CAST(doc_id AS VARCHAR), '')") + " || " + bits.format("coalesce(text, '')")
    return f"""WITH k AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS b, {key} AS bits FROM documents),
p AS (SELECT r, doc_id, b, d.range AS depth, substr(bits, 1, CAST(d.range AS INT)) AS shard FROM k, range(0, 121) d),
s AS (SELECT depth, shard, sum(b) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY depth, shard),
f AS (SELECT p.r, p.doc_id, p.depth, p.shard, s.shard_bytes, s.shard_docs FROM p JOIN s USING (depth, shard)
      WHERE s.shard_bytes <= {limit} OR s.shard_docs = 1)
SELECT doc_id, shard, CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs FROM f
QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1"""
