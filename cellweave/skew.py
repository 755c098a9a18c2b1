"""Joins whose hot keys are dealt over salts, and semi-joins that spare large rows a shuffle.

Keys with more rows than a share 1/MOST of all rows, of which there are at most MOST, are
hot; their list is broadcast, which that bounds. The rows of a hot key get a salt each, and
the other side's row is repeated for each salt. All other keys have salt 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.util import checkpoint

#: Hot keys at most, and rows that one salt takes.
MOST, SLICE = 4096, 512
#: Ids of a semi-join's small side that are broadcast, 2 MB of them; more are joined by a shuffle.
FEW = 1 << 18


def hot_keys(counts: DataFrame, key: str, rows: str, total: int, slice_rows: int = SLICE) -> DataFrame:
    """(__hot, __salts) of counts (key, rows): keys over both slice_rows and a share 1/MOST of total, so at most MOST of them."""
    least = max(slice_rows, -(-total // MOST))
    found = counts.filter(F.col(rows) > least).select(F.col(key).alias("__hot"), F.ceil(F.col(rows) / least).cast("int").alias("__salts"))
    return F.broadcast(checkpoint(found))


def _salts(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    return df.join(hot, F.col(key) == F.col("__hot"), "left")


def dealt(df: DataFrame, hot: DataFrame, key: str, by: Column) -> DataFrame:
    """The large side of a join: df with __salt, by a hash of ``by`` where key is hot."""
    return _salts(df, hot, key).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__salts")).cast("int"), F.lit(0))).drop("__hot", "__salts")


def repeated(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The small side of a join: df with a row for each __salt of its key."""
    return _salts(df, hot, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")


def having(rows: DataFrame, ids: DataFrame, column: str, few: int = FEW) -> DataFrame:
    """The rows whose column is among ids (one distinct column of that name), counted first: up to few are broadcast and rows stay where they are."""
    ids = checkpoint(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= few else ids, column, "left_semi")


def lacking(rows: DataFrame, ids: DataFrame, on: Column, few: int = FEW) -> DataFrame:
    """The rows that no row of ids meets, counted first: up to few are broadcast and rows stay where they are."""
    ids = checkpoint(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= few else ids, on, "left_anti")
