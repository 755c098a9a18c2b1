"""Exact deduplication by skew-safe combining.

Rows are deduplicated where they are read (map-side combine), merged within salted
digest groups, and the salts' winners are merged globally. Every stage groups by the
whole normalised text beside its digest, so equality is always that of the content.
Rows meet their group's winner in a join that salts large groups.

Defined cases: a null text counts as empty; a null id loses against any other id and
a group of null ids only has a null keep_id, of which one row stays; rows that share
id and text are all marked ``kept`` by ``assign``, while ``keep_one`` keeps one of
them; an empty table gives an empty table. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.skew import dealt, hot_keys, lacking, repeated
from cellweave.util import checkpoint

#: Salts of a digest group; each salt takes the rows of 1/SALTS of the ids.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("id", digest(F.col("norm")).alias("digest"), "norm")


def _combined(keyed: DataFrame, salts: int) -> DataFrame:
    """(digest, norm, keep_id, group_size): one row for each distinct text."""
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    local = salted.groupBy("digest", "salt", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return local.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _classes(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows (id, digest), the winners (digest, keep_id, group_size), and the rows whose digest stands for several texts."""
    keyed = _keyed(docs, id_col, text_col, digest)
    winners = checkpoint(_combined(keyed, salts).select("digest", "keep_id", "group_size"))
    clash = winners.groupBy("digest").count().filter("count > 1").select("digest")
    if clash.isEmpty():
        return keyed.select("id", "digest"), winners, None
    clash = checkpoint(clash)
    winners = winners.join(clash, "digest", "left_anti")
    apart = keyed.join(clash, "digest")
    apart = apart.join(_combined(apart, salts), ["digest", "norm"]).select("id", "digest", "keep_id", "group_size", "norm")
    return keyed.join(clash, "digest", "left_anti").select("id", "digest"), winners, apart


def _decided(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """rows (id, digest, ...) with keep_id and group_size of their group; winners have each digest once."""
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    hot = hot_keys(winners, "digest", "group_size", total)
    return dealt(rows, hot, "digest", F.col("id")).join(repeated(winners, hot, "digest"), ["digest", "__salt"]).drop("__salt")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, winners, apart = _classes(docs, id_col, text_col, salts, digest)
    if digest is not sha256:  # the result always has the SHA-256
        out = _decided(_keyed(docs, id_col, text_col, digest), winners).withColumn("sha", sha256(F.col("norm")))
    else:
        out = _decided(rows, winners).withColumn("sha", F.col("digest"))
    cols = ["id", "keep_id", "group_size", "sha"]
    if apart is not None:
        out = out.select(cols).unionByName(apart.withColumn("sha", sha256(F.col("norm"))).select(cols))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: one for each distinct text.

    Where a digest stands for several texts, the whole text is the key instead.
    """
    rows, winners, apart = _classes(docs, id_col, text_col, salts, digest)
    if apart is not None:
        return keep_one(docs, id_col, text_col, salts, lambda norm: F.concat(digest(norm), F.lit(":"), norm))
    decided = checkpoint(_decided(rows, winners).select("id", F.col("digest").alias("d"), F.col("id").eqNullSafe(F.col("keep_id")).alias("stays")).groupBy("id", "d", "stays").agg(F.count("*").alias("rows")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), digest(normalised(F.col(text_col))).alias("digest"))
    same = lambda t: (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col(t))
    kept = lacking(marked, decided.filter("not stays").select(F.col("id").alias("i"), "d"), same("i"))
    # Rows that share id and text: rare, found on ids and digests alone.
    twice = checkpoint(decided.filter("stays and rows > 1").select(F.col("id").alias("i2"), "d"))
    if twice.isEmpty():
        return kept.select("row.*")
    single = kept.join(twice, same("i2"), "left_semi").groupBy("id", "digest").agg(F.min("row").alias("row"))
    return kept.join(twice, same("i2"), "left_anti").select("row.*").unionByName(single.select("row.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
