"""Mixing sources to target weights by capped water-filling.

The corpus' words are shared out to the sources by weight; a source is clamped at
``max_epochs`` times its own words, and the excess goes to the others by weight until
none is above. A source is then repeated whole as often as its target allows, and the
fraction of an epoch that is left is a seeded sample of its documents: the first ones
in the order of a seeded hash, and one more document that best fills the gap.

All sums are taken over hash bins of each source, so no task holds a source: a
running sum over bins finds the bin in which the sample ends, and only that bin's
documents are put in order. The number of bins follows the number of rows.

Defined cases: a null text has size 0; null is a source of its own, after all others;
rows with the same id and text are taken alike; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellweave.util import checkpoint

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Rows of a bin, about; bins are named by as many hexadecimal digits of a hash as that takes.
BIN = 1024


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with target: a row for each source, so few rows.

    In the order of size by weight the clamped sources come first; whether one is
    clamped follows from running sums of whole numbers.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = sources.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", cycle)
    order = W.orderBy(F.col("source_size") / F.col("w"), "place")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", max_epochs * F.col("source_size"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    ranked = ranked.withColumn("clamped", left * F.col("w") > F.col("cap") * open_weight)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("clamped"), F.col("w"))).over(everything)
    ranked = ranked.withColumn("rest", rest).withColumn("share", share)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("rest")).cast("double") / F.col("share"))
    return ranked.select("source", "source_size", target.alias("target"))


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), content))
    return [content.alias("content"), F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("place")]


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, content, place, size, source_size, target, times."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_keys(docs, id_col, text_col, source_col, seed), n_words(F.col(text_col)).alias("size"))
    rows = checkpoint(rows)
    digits = max(1, math.ceil(math.log(max(1, rows.count() / BIN), 16)))
    rows = rows.withColumn("bin", F.substring("place", 1, digits))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    by_source = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    same = lambda a, b, *more: F.expr(" and ".join([f"{a}.source <=> {b}.source", *(f"{a}.{c} = {b}.{c}" for c in more)]))
    bins = bins.alias("b").join(by_source.alias("t"), same("b", "t")).select("b.*", "source_size", "target")
    upto = W.partitionBy("source").orderBy("bin")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    bins = bins.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    bins = checkpoint(bins.withColumn("before", F.sum("bin_size").over(upto) - F.col("bin_size")))

    # Rows with one id and text are one unit, so that they are treated alike.
    units = rows.groupBy("source", "bin", "place", "content").agg(F.sum("size").alias("unit"))
    units = units.alias("u").join(bins.alias("b"), same("u", "b", "bin")).select("u.*", "part", "before", "bin_size")
    in_bin = W.partitionBy("source", "bin").orderBy("place", "content")
    full, last = F.col("before") + F.col("bin_size") <= F.col("part"), F.col("before") < F.col("part")
    inside = units.filter(last & ~full).withColumn("more", F.col("before") + F.sum("unit").over(in_bin) <= F.col("part"))
    outside = units.filter(full | ~last).withColumn("more", full)
    units = checkpoint(inside.unionByName(outside).select("source", "place", "content", "unit", "part", "more"))
    taken = units.groupBy("source").agg((F.first("part") - F.sum(F.when(F.col("more"), F.col("unit")).otherwise(0))).alias("gap"))
    gaps = taken.filter("gap > 0")
    fits = units.filter("not more and unit > 0").alias("u").join(gaps.alias("g"), same("u", "g"))
    off = F.abs(F.col("unit") - F.col("gap"))
    fills = fits.filter(off < F.col("gap")).groupBy("u.source").agg(F.min(F.struct(off.alias("off"), F.col("place"), F.col("content"))).alias("f")).select("source", "f.place", "f.content")
    units = units.alias("u").join(fills.alias("f"), same("u", "f", "place", "content"), "left").select("u.source", "u.place", "u.content", (F.col("more") | F.col("f.place").isNotNull()).alias("more"))
    out = rows.alias("r").join(units.alias("u"), same("r", "u", "place", "content")).select("r.*", "more")
    out = out.alias("r").join(bins.alias("b"), same("r", "b", "bin")).select("r.*", "source_size", "target", "whole")
    return out.select("doc_id", "source", "content", "place", "size", "source_size", "target", (F.col("whole") + F.col("more").cast("long")).alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    kept = decisions(docs, id_col, text_col, source_col, seed=seed, **options).filter("times > 0").select("source", "place", "content", "times").distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col(source_col).alias("source"), *_keys(docs, id_col, text_col, source_col, seed))
    found = rows.alias("r").join(kept.alias("k"), F.expr("r.place = k.place and r.content = k.content and r.source <=> k.source"))
    return found.select("r.row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return decisions(docs).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS content,
  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, [5, 2, 1][CAST(i % 3 + 1 AS INT)] AS w FROM p),
c AS (SELECT *, sum(n) OVER () AS total,
  (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w >
  3 * n * (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS clamped FROM w),
t AS (SELECT source, n, CASE WHEN clamped THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * (total - coalesce(sum(3 * n) FILTER (clamped) OVER (), 0)) AS DOUBLE) / sum(w) FILTER (NOT clamped) OVER () END AS target FROM c),
r AS (SELECT source, n, target, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (SELECT source, place, content, CAST(sum(size) AS BIGINT) AS unit FROM d GROUP BY ALL),
m AS (SELECT u.*, target - whole * n AS part, sum(unit) OVER (PARTITION BY u.source ORDER BY place, content) <= target - whole * n AS more
  FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source),
g AS (SELECT source, any_value(part) - coalesce(sum(unit) FILTER (more), 0) AS gap FROM m GROUP BY source),
f AS (SELECT m.source, min(row(abs(unit - gap), place, content)) AS f FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source
  WHERE NOT more AND unit > 0 AND abs(unit - gap) < gap GROUP BY m.source),
x AS (SELECT m.source, m.place, m.content, more OR (f.f IS NOT NULL AND f.f[2] = m.place AND f.f[3] = m.content) AS more
  FROM m LEFT JOIN f ON m.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target, (whole + CAST(x.more AS INT)) * size AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.place = x.place AND d.content = x.content JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
