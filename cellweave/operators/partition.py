"""Partitions of cells on their neighbour graph, and molecules dealt out to them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellweave.operators.geometry import bisect, edge_cut, place_in_hulls
from cellweave.operators.graph import radius_knn, undirected
from cellweave.util import checkpoint, release


#: The share of cut edges that a turn of moves must save to be worth another.
WORTH = 0.01


def knn(points: DataFrame, k: int, coords: Sequence[str] = ("x", "y"), key: str = "cell_id") -> DataFrame:
    """Directed edges (src, dst, length) to the k nearest others, however far.

    The radius begins at what holds a few times k points on average, and doubles for those
    that have fewer than k others within it.
    """
    points = points.dropna(subset=list(coords)).select(key, *[F.col(c).cast("double").alias(c) for c in coords])
    ends = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in coords for i, f in enumerate((F.min, F.max))]).first()
    if k < 1 or k + 1 > ends["n"]:
        raise ValueError("k must be at least 1 and less than the number of points")
    sides = [ends[f"{c}1"] - ends[f"{c}0"] for c in coords]
    whole = math.sqrt(sum(s * s for s in sides))
    radius = max(sides) * (4 * k / ends["n"]) ** (1 / len(coords)) / 2 or 1.0
    left, out = points, None
    while True:
        found = checkpoint(radius_knn(points, k, radius, coords, key, of=left))
        full = found.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") == k).select("src")
        good = found.join(full, "src", "left_semi")
        out = good if out is None else out.unionByName(good)
        left = checkpoint(left.join(full, F.col(key) == F.col("src"), "left_anti"))
        if radius > whole or left.isEmpty():
            return out
        radius *= 2


def alpha_estimate(points: DataFrame, k: int = 20, scale: float = 1.8, coords: Sequence[str] = ("x", "y", "z"), key: str = "transcript_id") -> DataFrame:
    """One row: scale times the median distance to the k nearest others."""
    return knn(points, k, coords, key).agg((F.percentile("length", F.lit(0.5)) * scale).alias("alpha"))


def _moves(both: DataFrame, own: DataFrame, up: bool, most: int, least: int) -> DataFrame:
    """(node, target): cells with more neighbours in another partition, the best first, as many as sizes allow. Only to later partitions, or only to earlier ones, so that neighbours don't change places."""
    mine = own.select(F.col("node").alias("u"), F.col("partition").alias("home"))
    theirs = own.select(F.col("node").alias("v"), F.col("partition").alias("target"))
    n = both.join(theirs, "v").groupBy("u", "target").agg(F.count("*").alias("n")).join(mine, "u")
    way = F.col("target") > F.col("home") if up else F.col("target") < F.col("home")
    best = n.groupBy("u", "home").agg(F.sum(F.when(F.col("target") == F.col("home"), F.col("n")).otherwise(0)).alias("here"), F.max(F.when(way, F.struct("n", "target"))).alias("best"))
    gains = best.filter(F.col("best.n") > F.col("here")).select("u", "home", F.col("best.target").alias("target"), (F.col("best.n") - F.col("here")).alias("gain"))
    sizes = own.groupBy("partition").agg(F.count("*").alias("size"))
    room = sizes.select(F.col("partition").alias("target"), (most - F.col("size")).alias("room"))
    spare = sizes.select(F.col("partition").alias("home"), (F.col("size") - least).alias("spare"))
    place = lambda side: F.row_number().over(W.partitionBy(side).orderBy(F.desc("gain"), "u"))
    ranked = gains.join(F.broadcast(room), "target").join(F.broadcast(spare), "home")  # a row per partition
    into = ranked.withColumn("r", place("target")).filter("r <= room")
    return into.withColumn("r", place("home")).filter("r <= spare").select(F.col("u").alias("node"), "target")


def partition_cells(cells: DataFrame, parts: int = 100, k: int = 10, key: str = "cell_id", slack: float = 0.05, rounds: int = 8) -> tuple[DataFrame, int, int]:
    """cells with partition, the edges it cuts of the graph of k nearest neighbours, and those that bisection alone cuts.

    Bisection along the axes gives balanced, compact partitions; border cells then move to
    where most of their neighbours are, as long as sizes stay within slack of the mean.
    """
    cells = cells.dropna(subset=["x", "y"])
    edges = checkpoint(undirected(knn(cells, k, key=key)))
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    own = checkpoint(bisect(cells, parts, key).select(F.col(key).alias("node"), "partition"))
    cut = lambda p: edge_cut(edges, p, "node").first()[0]
    n = own.count()
    most, least = math.ceil(n / parts * (1 + slack)), math.floor(n / parts * (1 - slack))
    first = now = cut(own)
    still = 0
    for turn in range(2 * rounds):
        moves = _moves(both, own, turn % 2 == 0, most, least)
        new = checkpoint(own.join(moves, "node", "left").select("node", F.coalesce("target", "partition").alias("partition")))
        cost = cut(new)
        still = 0 if cost < now * (1 - WORTH) else still + 1
        if cost < now:
            release(own)
            own, now = new, cost
        else:
            release(new)
        if still == 2:  # neither way helps much
            break
    out = cells.join(own.withColumnRenamed("node", "__node"), F.col(key) == F.col("__node")).drop("__node")
    return out, now, first


def chunk(molecules: DataFrame, parts: DataFrame, shapes: DataFrame, cell: str = "cell_id", partition: str = "partition") -> DataFrame:
    """molecules with the partition of their cell; those of no partitioned cell get the hull that holds them, else the one with the nearest centroid. NULL without coordinates."""
    own = parts.select(F.col(cell).alias("__cell"), partition)
    known = molecules.join(own, F.col(cell) == F.col("__cell"), "left").drop("__cell")
    stray = known.filter(F.col(partition).isNull()).drop(partition)
    return known.filter(F.col(partition).isNotNull()).unionByName(place_in_hulls(stray, shapes, partition))


def chunk_summary(chunks: DataFrame, cell: str = "cell_id", partition: str = "partition") -> DataFrame:
    """(partition, n_transcripts, n_cells) in order."""
    return chunks.groupBy(partition).agg(F.count("*").alias("n_transcripts"), F.count_distinct(cell).alias("n_cells")).orderBy(partition)
