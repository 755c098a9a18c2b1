"""Sharding to a byte limit by extendible hashing, in DataFrame operations only.

A document's key is a string of hash bits. A bucket is a prefix of it; one that holds
more bytes than the limit splits on the next bit, and only that one, until every
bucket fits or holds a single document. Bucket sizes are summed once over prefixes of
some depth and rolled up to all shorter ones; only buckets that are still too large
there are summed again, deeper.

After HASH_BITS bits of the id's hash come bits of a row number's hash, so that rows
with one id split as well. That number is drawn once and checkpointed.

Defined cases: a null text has 0 bytes; a null id hashes by its text; a document over
the limit has a shard of its own; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.util import checkpoint, release

LIMIT = 16 << 20
HASH_BITS = 48
#: Bits summed at once beyond those that equal buckets would need.
AHEAD = 4


def _prefix(depth: Column) -> list[Column]:
    """The first depth bits of the key, as two numbers."""
    first = F.when(depth >= HASH_BITS, F.col("h")).otherwise(F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - F.least(depth, F.lit(HASH_BITS))).cast("int")))
    second = F.when(depth <= HASH_BITS, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("g"), (F.lit(2 * HASH_BITS) - F.greatest(depth, F.lit(HASH_BITS))).cast("int")))
    return [first.alias("p"), second.alias("q")]


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, bytes and the key's two numbers h and g, checkpointed; with ``whole`` also row, a struct of docs' own columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(text.cast("binary"))))
    h = F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    g = F.call_function("shiftrightunsigned", F.xxhash64(F.monotonically_increasing_id()), F.lit(64 - HASH_BITS))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), h.alias("h"), g.alias("g"), *row))


def directory(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[int]]:
    """The buckets (at, p, q, depth, shard_bytes, shard_docs) by their prefix of ``at`` bits, and all values of ``at``.

    Prefixes of ``at`` bits that share a bucket have a row each, as in the directory of an extendible hash table.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    at = min(2 * HASH_BITS, math.ceil(math.log2(max(1, total / limit))) + AHEAD)
    least, found, depths, left = 0, None, [], rows
    while True:
        depths.append(at)
        fine = left.groupBy(*_prefix(F.lit(at))).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        fine = fine.select("p", "q", "b", "n", F.when(F.lit(at) < HASH_BITS, F.call_function("shiftleft", F.col("p"), F.lit(max(0, HASH_BITS - at)))).otherwise(F.col("p")).alias("h"), F.call_function("shiftleft", F.col("q"), F.lit(min(HASH_BITS, 2 * HASH_BITS - at))).alias("g"))
        up = fine.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(at))))
        up = up.select(F.col("p").alias("fp"), F.col("q").alias("fq"), "b", "n", "depth", *_prefix(F.col("depth")))
        sums = up.groupBy("depth", "p", "q").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = up.select("fp", "fq", "depth", "p", "q").join(sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == 2 * HASH_BITS)), ["depth", "p", "q"])
        leaf = fits.groupBy(F.col("fp").alias("p"), F.col("fq").alias("q")).agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("s")).select(F.lit(at).alias("at"), "p", "q", "s.*")
        leaf = checkpoint(leaf)
        found = leaf if found is None else found.unionByName(leaf)
        over = fine.select("p", "q").join(leaf, ["p", "q"], "left_anti")
        if over.isEmpty():
            return found, depths
        over = checkpoint(over)
        left = left.withColumns(dict(zip(("p", "q"), _prefix(F.lit(at)), strict=True))).join(over, ["p", "q"], "left_semi").select(rows.columns)
        least, at = at + 1, min(2 * HASH_BITS, at + 8)


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """rows as ``keys`` gives them, with shard (its bits), depth, shard_bytes and shard_docs: each row once."""
    table, depths = directory(rows.select("bytes", "h", "g"), limit)
    out, rest = None, rows
    for at in depths:
        own = rest.withColumns(dict(zip(("p", "q"), _prefix(F.lit(at)), strict=True)))
        leaf = table.filter(F.col("at") == at).drop("at")
        hit = own.join(leaf, ["p", "q"])
        out = hit if out is None else out.unionByName(hit)
        if at != depths[-1]:
            rest = own.join(leaf, ["p", "q"], "left_anti").select(rows.columns)
    bits = F.concat(F.lpad(F.bin("h"), HASH_BITS, "0"), F.lpad(F.bin("g"), HASH_BITS, "0"))
    return out.withColumn("shard", bits.substr(F.lit(1), F.col("depth")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, bytes, shard (its bits), depth, shard_bytes, shard_docs."""
    return _assigned(keys(docs, id_col, text_col), limit).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> str:
    """docs as Parquet with a folder for each shard, every row once, whatever its id.

    Returns the name of the folders' column: ``shard``, with underscores before it where docs has that column.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    rows = keys(docs, id_col, text_col, whole=True)
    out = _assigned(rows, limit).select("row.*", F.concat(F.lit("s"), "shard").alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)
    release(rows)
    return name


#: Of the registered query: small enough that the smaller tables split as well.
QUERY_LIMIT = 1 << 20


def query(docs: DataFrame) -> DataFrame:
    return assign(docs, limit=QUERY_LIMIT)


def oracle(limit: int = QUERY_LIMIT) -> str:
    return f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS h FROM documents),
b AS (SELECT doc_id, bytes, lpad(bin(h), 48, '0') AS bits FROM d),
x AS (SELECT b.*, k AS depth, substr(bits, 1, CAST(k AS INT)) AS shard FROM b, range(0, 49) r(k)),
s AS (SELECT *, sum(bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs FROM x WINDOW w AS (PARTITION BY depth, shard))
SELECT doc_id, bytes, shard, CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs FROM s
WHERE shard_bytes <= {limit} OR shard_docs = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
