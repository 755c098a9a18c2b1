"""Delaunay adjacency, hulls, point-in-hull and balanced spatial partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.delaunay import delaunay, delaunay_edges, simplex_edges, simplices
from cellweave.util import checkpoint

__all__ = ["bisect", "convex_hull", "delaunay", "delaunay_edges", "edge_cut", "hulls", "inside_hull", "place_in_hulls", "simplex_edges", "simplices"]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The hull's corners, counterclockwise from the least; collinear ones left out."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def chain(q: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hulls(cells: DataFrame, partition: str = "partition", min_cells: int = 3) -> DataFrame:
    """(partition, ring, cx, cy): hulls of partitions with enough cells, with their area's centroid.

    Corners of slices are found first, so no task holds a partition.
    """
    kind = cells.schema[partition].dataType.simpleString()
    parts = cells.dropna(subset=["x", "y"]).withColumn("__slice", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    counts = parts.groupBy(partition).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_cells).select(partition)

    def corners(g: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({partition: [g[partition].iloc[0]] * len(h), "x": h[:, 0], "y": h[:, 1]})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(g[["x", "y"]].to_numpy())
        x, y = h[:, 0], h[:, 1]
        cross = x * np.roll(y, -1) - np.roll(x, -1) * y
        area = cross.sum()
        c = ((x + np.roll(x, -1)) @ cross / (3 * area), (y + np.roll(y, -1)) @ cross / (3 * area)) if len(h) > 2 and area else h.mean(axis=0)
        return pd.DataFrame({partition: [g[partition].iloc[0]], "ring": [[{"x": float(a), "y": float(b)} for a, b in h]], "cx": [float(c[0])], "cy": [float(c[1])]})

    some = parts.join(counts, partition, "left_semi").select(partition, "__slice", "x", "y").groupBy(partition, "__slice").applyInPandas(corners, f"{partition} {kind}, x double, y double")
    return some.groupBy(partition).applyInPandas(whole, f"{partition} {kind}, ring array<struct<x:double,y:double>>, cx double, cy double")


def inside_hull(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies strictly inside a counterclockwise convex ring of at least three corners."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    left = F.zip_with(ring, after, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) > 0)
    return (F.size(ring) >= 3) & F.forall(left, lambda ok: ok)


#: Partitions at most: their hulls are sent to all tasks.
MAX_PARTITIONS = 4096


def place_in_hulls(points: DataFrame, shapes: DataFrame, partition: str = "partition") -> DataFrame:
    """points with partition: the first hull that holds them, else the one whose centroid is nearest; NULL without coordinates."""
    n = shapes.count()
    if n > MAX_PARTITIONS:
        raise ValueError(f"over {MAX_PARTITIONS} hulls")
    ends = [f(F.col(f"ring.{c}")).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.array_min, F.array_max))]
    one = shapes.agg(F.array_sort(F.collect_list(F.struct(F.col(partition).alias("id"), "ring", "cx", "cy", *ends))).alias("__h"))
    rows = points.crossJoin(F.broadcast(one))  # one row, of at most MAX_PARTITIONS hulls
    x, y = F.col("x"), F.col("y")
    boxed = lambda h: (x > h["x0"]) & (x < h["x1"]) & (y > h["y0"]) & (y < h["y1"])
    within = F.get(F.filter("__h", lambda h: boxed(h) & inside_hull(x, y, h["ring"])), F.lit(0))["id"]
    nearest = F.array_min(F.transform("__h", lambda h: F.struct(((h["cx"] - x) * (h["cx"] - x) + (h["cy"] - y) * (h["cy"] - y)).alias("d"), h["id"].alias("id"))))["id"]
    return rows.withColumn(partition, F.when(x.isNotNull() & y.isNotNull(), F.coalesce(within, nearest))).drop("__h")


def bisect(cells: DataFrame, parts: int = 100, key: str = "cell_id", accuracy: int = 10000) -> DataFrame:
    """cells with partition from 0: recursive bisection at quantiles along alternating axes, so that partitions are balanced and compact.

    A level is one aggregation of all quantiles and a join to at most ``parts`` rows.
    """
    if parts < 2:
        raise ValueError("at least two partitions")
    if parts > MAX_PARTITIONS:
        raise ValueError(f"over {MAX_PARTITIONS} partitions")
    out = cells.dropna(subset=["x", "y"]).withColumn("partition", F.lit(0)).withColumn("__m", F.lit(parts))
    axis = 0
    while parts > 1:
        c = "xy"[axis % 2]
        half = F.floor(F.col("__m") / 2).cast("int")
        cuts = out.filter(F.col("__m") > 1).groupBy("partition").agg(F.percentile_approx(c, F.array(*[F.lit(q) for q in (0.25, 1 / 3, 0.4, 0.5)]), accuracy).alias("__q"), F.first("__m").alias("__of"))
        # The share of the lower half is 1/2, or for few partitions 1/3 or 2/5; otherwise near enough to 1/2.
        cut = F.when(F.col("__of") == 3, F.get("__q", F.lit(1))).when(F.col("__of") == 5, F.get("__q", F.lit(2))).otherwise(F.get("__q", F.lit(3)))
        cuts = checkpoint(cuts.select("partition", cut.alias("__cut")))
        low = F.col(c) <= F.col("__cut")
        out = out.join(F.broadcast(cuts), "partition", "left")
        out = out.withColumns({"partition": F.when(F.col("__cut").isNull() | low, F.col("partition")).otherwise(F.col("partition") + half), "__m": F.when(F.col("__cut").isNull(), F.col("__m")).when(low, half).otherwise(F.col("__m") - half)}).drop("__cut")
        parts, axis = -(-parts // 2), axis + 1
    return out.drop("__m")


def edge_cut(edges: DataFrame, parts: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row: how many undirected edges (src < dst) join different partitions."""
    p = parts.select(F.col(key).alias("__k"), F.col("partition").alias("__p"))
    e = edges.join(p, F.col("src") == F.col("__k")).select("dst", F.col("__p").alias("__a")).join(p, F.col("dst") == F.col("__k"))
    return e.agg(F.count_if(F.col("__a") != F.col("__p")).alias("edge_cut"))
