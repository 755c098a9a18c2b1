"""Seeded molecules, fragments and pair tables: the same rows for any partitioning, as every number is a hash of its row's id."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, k: int) -> Column:
    """A number between 0 and 1 for each key; k tells the numbers of one row apart."""
    return ((F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(k)), 11)).cast("double") + 0.5) / float(1 << 53)


def normal(key: Column, seed: int, k: int) -> Column:
    return F.sqrt(-2 * F.ln(uniform(key, seed, 2 * k))) * F.cos(2 * math.pi * uniform(key, seed, 2 * k + 1))


def _pick(names: Sequence[str], key: Column, seed: int, k: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.floor(uniform(key, seed, k) * len(names)).cast("int") + 1)


def molecules(spark: SparkSession, n: int = 800, cells: int = 40, genes: int = 6, seed: int = 0, sigma: tuple[float, float, float] = (100.0, 100.0, 10.0)) -> DataFrame:
    """n molecules about the origin, of random cells 0 to cells - 1 and features G1, G2, ..."""
    key = F.col("id")
    at = [(normal(key, seed, 10 + i) * s).alias(c) for i, (c, s) in enumerate(zip("xyz", sigma, strict=True))]
    return spark.range(n).select(key.alias("transcript_id"), _pick([f"G{i + 1}" for i in range(genes)], key, seed, 1).alias("feature_name"), F.floor(uniform(key, seed, 2) * cells).cast("string").alias("cell_id"), *at)


def pair_table(spark: SparkSession, genes: int = 6, seed: int = 0) -> DataFrame:
    """Both directions of each pair of features with association, probabilities and counts, as rankings take them."""
    names = [f"G{i + 1}" for i in range(genes)]
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "a string, b string")
    key = F.concat("a", F.lit("|"), "b")
    u = lambda k, low, high: F.lit(low) + uniform(key, seed, k) * (high - low)
    rows = pairs.select("a", "b", u(1, -0.1, 0.6).alias("NPMI"), u(2, 0.01, 0.2).alias("pa"), u(3, 0.01, 0.2).alias("pb"), u(4, 0.01, 0.8).alias("share"), F.floor(u(5, 1.0, 50.0)).alias("count_ij"))
    rows = rows.withColumn("P_ij", F.least("pa", "pb") * F.col("share"))
    one = lambda i, j, pi, pj: rows.select(F.col(i).alias("gene_i"), F.col(j).alias("gene_j"), F.col(pi).alias("P_i"), F.col(pj).alias("P_j"), "P_ij", "NPMI", (F.col("P_ij") / F.col(pi)).alias("P_j_given_i"), (F.col("P_ij") / F.col(pj)).alias("P_i_given_j"), "count_ij")
    return one("a", "b", "pa", "pb").unionByName(one("b", "a", "pb", "pa"))


def augmented(markers: Sequence[str], pool: Sequence[str], k: int = 2, seed: int = 0) -> list[str]:
    """markers and k of the pool's features, or all of fewer."""
    return [*markers, *random.Random(seed).sample(sorted(pool), min(k, len(pool)))]


def fragment(spark: SparkSession, markers: Sequence[str], name: str, centre: Sequence[float], n: int = 80, sigma: float = 0.7, drop: int = 0, seed: int = 0) -> DataFrame:
    """n molecules about a centre, of the markers but for ``drop`` of them; one always stays."""
    gone = set(random.Random(seed).sample(sorted(markers), max(0, min(drop, len(markers) - 1))))
    key = F.concat(F.lit(f"{name}|"), F.col("id").cast("string"))
    at = [(F.lit(float(m)) + normal(key, seed, 10 + i) * sigma).alias(c) for i, (c, m) in enumerate(zip("xyz", centre, strict=True))]
    return spark.range(n).select(F.col("id").alias("transcript_id"), _pick([m for m in markers if m not in gone], key, seed, 1).alias("feature_name"), F.lit(name).alias("cell_id"), *at)
