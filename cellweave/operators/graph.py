"""Neighbour graphs of molecules and what is done with their edges.

The neighbour join is an equi-join on grid cells of the radius' size: a point meets
those of its own and the adjacent cells only, never all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellweave.functions.scalars import clip, distance
from cellweave.operators.components import connected_components
from cellweave.operators.prune import removals
from cellweave.operators.scores import cell_scores_relu, component_scores, pair_sums
from cellweave.operators.stats import gene_sets, on_features
from cellweave.skew import dealt, hot_keys, repeated
from cellweave.util import checkpoint

XYZ = ("x", "y", "z")
#: Points of a grid cell from which it counts as crowded.
CROWD = 2048


def _meet(left: DataFrame, right: DataFrame, radius: float, coords: Sequence[str]) -> DataFrame:
    """Pairs of left (a, coordinates) and right (b, coordinates) up to radius apart: a, b, length."""
    at = [F.floor(F.col(c) / radius).cast("long").alias(f"g{i}") for i, c in enumerate(coords)]
    near = left.dropna(subset=list(coords)).select("a", *[F.col(c).alias(f"p{i}") for i, c in enumerate(coords)], *at)
    for i in range(len(coords)):
        near = near.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + d for d in (-1, 0, 1)])))
    far = right.dropna(subset=list(coords)).select("b", *[F.col(c).alias(f"q{i}") for i, c in enumerate(coords)], *at)
    cell = [f"g{i}" for i in range(len(coords))]
    # The points of a crowded cell are dealt over salts, and whoever is near it meets each salt.
    counts = far.groupBy(F.xxhash64(*cell).alias("cell")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = hot_keys(counts, "cell", "rows", total, CROWD)
    near = repeated(near.withColumn("cell", F.xxhash64(*cell)), hot, "cell")
    far = dealt(far.withColumn("cell", F.xxhash64(*cell)), hot, "cell", F.col("b"))
    both = near.join(far.drop("cell"), [*cell, "__salt"])
    length = distance([F.col(f"p{i}") for i in range(len(coords))], [F.col(f"q{i}") for i in range(len(coords))])
    return both.withColumn("length", length).filter(F.col("length") <= radius).select("a", "b", "length")


def radius_knn(points: DataFrame, k: int, radius: float, coords: Sequence[str] = XYZ, key: str = "transcript_id", of: DataFrame | None = None) -> DataFrame:
    """Directed edges (src, dst, length) to the k nearest others up to radius away; ties by distance rounded to 6 places go to the smaller id.

    Points without coordinates have no edges; one at the same place is a neighbour like any other.
    A point's pairs are cut to k where they are found, before they are shuffled.
    Given ``of``, only that table's points have edges, to others of points.
    """
    cols = [F.col(c).cast("double").alias(c) for c in coords]
    edges = _meet((points if of is None else of).select(F.col(key).alias("a"), *cols), points.select(F.col(key).alias("b"), *cols), radius, coords).filter("a <> b")
    order = W.partitionBy("a").orderBy(F.round("length", 6), "b")
    return edges.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select(F.col("a").alias("src"), F.col("b").alias("dst"), "length")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, src < dst, whichever way it was found."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("length").alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of nodes with an edge, edges being undirected."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def associate(edges: DataFrame, nodes: DataFrame, ranked: DataFrame, key: str = "transcript_id", gene: str = "feature_name") -> DataFrame:
    """edges with gene_src, gene_dst, npmi and cond_prob of the pair; 0 where it is dropped or unknown."""
    g = nodes.select(F.col(key).alias("__k"), F.col(gene).alias("__g"))
    e = edges.join(g, F.col("src") == F.col("__k")).drop("__k").withColumnRenamed("__g", "gene_src").join(g, F.col("dst") == F.col("__k")).drop("__k").withColumnRenamed("__g", "gene_dst")
    kept = ranked.filter(~F.col("drop")).groupBy(F.col("gene_i").alias("gene_src"), F.col("gene_j").alias("gene_dst")).agg(F.max_by("NPMI", "score").alias("npmi"), F.max("cond_prob").alias("cond_prob"))
    return e.join(kept, ["gene_src", "gene_dst"], "left").fillna(0.0, ["npmi", "cond_prob"]).select("src", "dst", "length", "gene_src", "gene_dst", "npmi", "cond_prob")


def prune_edges(edges: DataFrame, gates: DataFrame, distances: tuple[float, float] = (0.5, 1.5), npmi_range: tuple[float, float] = (0.01, 0.1), cond_range: tuple[float, float] = (0.001, 0.01), prune_npmi: float = -0.1) -> DataFrame:
    """Edges that stay, with connect. Strong short ones are marked; unmarked ones go if weak or long.

    gates: (gene_i, NPMI_thresh, cond_prob_thresh); the gates of the source's gene apply,
    clipped once more, and the upper bounds where it has none.
    """
    g = gates.select(F.col("gene_i").alias("gene_src"), clip(F.col("NPMI_thresh"), *npmi_range).alias("__n"), clip(F.col("cond_prob_thresh"), *cond_range).alias("__c"))
    e = edges.join(g, "gene_src", "left").fillna(npmi_range[1], ["__n"]).fillna(cond_range[1], ["__c"])
    strong = (F.col("npmi") > F.col("__n")) & (F.col("cond_prob") > F.col("__c")) & (F.col("length") < distances[0])
    weak = (F.col("npmi") <= prune_npmi) | (F.col("cond_prob") <= cond_range[0]) | (F.col("length") >= distances[1])
    return e.withColumn("connect", strong.cast("int")).filter(strong | ~weak).drop("__n", "__c").select("src", "dst", "length", "gene_src", "gene_dst", "npmi", "cond_prob", "connect")


def component_summary(comps: DataFrame, nodes: DataFrame, key: str = "transcript_id", gene: str = "feature_name", cell: str = "cell_id", coords: Sequence[str] = XYZ, min_size: int = 1) -> DataFrame:
    """component, n_nodes, n_unique_genes, genes, centroid_*, assigned_cell_id, cell_id_purity. A tie for the majority label goes to the smallest."""
    own = comps.join(nodes, F.col("node") == F.col(key))
    votes = own.groupBy("component", cell).agg(F.count("*").alias("n")).groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(cell).alias("c"))).alias("v"))
    centre = [F.avg(c).alias(f"centroid_{c}") for c in coords]
    out = own.groupBy("component").agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_set(gene)).alias("genes"), *centre).join(votes, "component").filter(F.col("n_nodes") >= min_size)
    return out.select("component", "n_nodes", F.size("genes").cast("long").alias("n_unique_genes"), "genes", *[f"centroid_{c}" for c in coords], F.col("v.c").alias("assigned_cell_id"), (-F.col("v.n") / F.col("n_nodes")).alias("cell_id_purity"))


def scored_components(comps: DataFrame, nodes: DataFrame, npmi: DataFrame, use_relu: bool = True, purity_threshold: float = 0.05, tau: float = 0.05, eps: float = 1e-8, **options) -> DataFrame:
    """component_summary with purity and conflict, and for use_relu relative_purity, relative_conflict and signal_strength; largest and purest first.

    Scores and n_unique_genes are of the features that npmi knows; 0 where undefined.
    """
    own = component_summary(comps, nodes, **options)
    sets = checkpoint(on_features(own.select(F.col("component").alias("entity"), "genes"), npmi))
    sums = pair_sums(sets, npmi, purity_threshold, tau)
    scores = cell_scores_relu(sums, eps, 0.0) if use_relu else component_scores(sums)
    known = scores.withColumnRenamed("entity", "component").withColumnRenamed("n_genes", "n_unique_genes")
    out = own.drop("n_unique_genes").join(known, "component").withColumn("n_unique_genes", F.col("n_unique_genes").cast("long"))
    return out.orderBy(F.desc("n_nodes"), F.desc("purity"), "component")


def unassigned_components(df: DataFrame, npmi: DataFrame, label: str = "cell_id_npmi_cons_p2", unassigned: str = "-1", gene: str = "feature_name", key: str = "transcript_id", coords: Sequence[str] = XYZ, k: int = 8, radius: float = 1.5, min_size: int = 50, threshold: float = -0.1, neighbors=radius_knn, pruner=removals) -> DataFrame:
    """Components of the unassigned molecules, pruned once; adds unassigned_comp_id, unassigned_qc_status, unassigned_comp_size, cell_id_final.

    Components are numbered by their smallest molecule. neighbors(points, k, radius, coords, key) gives the edges,
    pruner(sets, npmi, threshold) the (entity, gene) to remove.
    """
    none = F.col(label).isNull() | (F.col(label) == unassigned)
    loose = df.filter(none).select(key, gene, *coords)
    found = connected_components(neighbors(loose, k, radius, coords, key))
    comp = loose.join(found, F.col(key) == F.col("node"), "left").select(F.col(key).alias("__k"), F.col(gene).alias("__g"), F.coalesce("component", key).alias("__c"))
    sizes = comp.groupBy("__c").agg(F.count("*").alias("__n"))
    # Numbers for all components, by range, so that no task orders them all.
    from cellweave.sources.tables import number_rows

    numbered = number_rows(sizes, ["__c"], "__i").withColumn("__id", F.concat(F.lit("UNASSIGNED_"), F.col("__i").cast("string"))).drop("__i")
    comp = comp.join(numbered, "__c")
    large = comp.filter(F.col("__n") >= min_size)
    gone = pruner(gene_sets(large, "__id", "__g"), npmi, threshold).select(F.col("entity").alias("__id"), F.col("gene").alias("__g"), F.lit(True).alias("__out"))
    comp = comp.join(gone, ["__id", "__g"], "left").drop("__g", "__c")
    out = df.join(comp, F.col(key) == F.col("__k"), "left")
    status = F.when(~none, None).when(F.col("__n") < min_size, "drop_small_comp").when(F.col("__out"), "drop_npmi_pruned_gene").otherwise("keep_unassigned_comp")
    out = out.withColumns({"unassigned_comp_id": F.when(none, F.col("__id")), "unassigned_qc_status": status, "unassigned_comp_size": F.when(none, F.col("__n").cast("double"))})
    final = F.when(~none, F.col(label)).when(F.col("unassigned_qc_status") == "keep_unassigned_comp", F.col("unassigned_comp_id")).otherwise("DROP")
    return out.withColumn("cell_id_final", final).drop("__k", "__n", "__id", "__out")
