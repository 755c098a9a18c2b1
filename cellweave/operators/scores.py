"""Purity, conflict and coherence of entities from pairwise feature association.

One pass over an entity's feature pairs gives all sums; every score is an expression
of them. How a pair without an observed value counts is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scalars import relu_symmetric
from cellweave.operators.stats import with_values


def pair_values(sets: DataFrame, npmi: DataFrame, keep: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(entity, npmi) of each observed pair of features of sets (entity, genes, ...)."""
    return with_values(sets, npmi, keep).select(*keep, "npmi")


def pair_sums(sets: DataFrame, npmi: DataFrame, purity_threshold: float = 0.05, tau: float = 0.05) -> DataFrame:
    """One row per entity: n_genes, n_pairs (all), n_seen (observed), n_pos, n_neg, sum_neg, relu_pos, relu_neg.

    Unobserved pairs add to no sum but to n_pairs, which is what counting them as 0 does.
    """
    v, r = F.col("npmi"), relu_symmetric(F.col("npmi"), tau)
    sums = pair_values(sets, npmi).groupBy("entity").agg(
        F.count("*").alias("n_seen"), F.count_if(v > purity_threshold).alias("n_pos"), F.count_if(v < 0).alias("n_neg"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("sum_neg"), F.sum(F.greatest(r, F.lit(0.0))).alias("relu_pos"), F.sum(F.greatest(-r, F.lit(0.0))).alias("relu_neg")
    )
    k = F.size("genes").cast("long")
    out = sets.select("entity", k.alias("n_genes"), (k * (k - 1) / 2).cast("long").alias("n_pairs")).join(sums, "entity", "left")
    return out.fillna(0, ["n_seen", "n_pos", "n_neg"]).fillna(0.0, ["sum_neg", "relu_pos", "relu_neg"])


def _per(total: Column, n: str, none: float | None) -> Column:
    return F.when(F.col(n) > 0, total / F.col(n)).otherwise(F.lit(none).cast("double"))


def cell_scores(sums: DataFrame) -> DataFrame:
    """purity and conflict over all pairs; NULL below two features."""
    return sums.select("entity", "n_genes", _per(F.col("n_pos"), "n_pairs", None).alias("purity"), _per(F.col("sum_neg"), "n_pairs", None).alias("conflict"))


def cell_scores_relu(sums: DataFrame, eps: float = 1e-8, none: float | None = None) -> DataFrame:
    """purity, conflict and signal from values beyond tau, and their shares of the signal; ``none`` where undefined."""
    pos, neg = F.col("relu_pos"), F.col("relu_neg")
    total = pos + neg
    two = F.col("n_pairs") > 0
    rel = lambda x: F.when(two & (total > eps), x / total).otherwise(F.lit(none).cast("double"))
    return sums.select("entity", "n_genes", _per(pos, "n_pairs", none).alias("purity"), _per(neg, "n_pairs", none).alias("conflict"), F.when(two, total).otherwise(F.lit(none).cast("double")).alias("signal_strength"), rel(pos).alias("relative_purity"), rel(neg).alias("relative_conflict"))


def coherence(sums: DataFrame) -> DataFrame:
    """C = purity - conflict over observed pairs, conflict being the mean over negative ones; 0 where there is none."""
    purity = _per(F.col("n_pos"), "n_seen", 0.0)
    conflict = _per(F.col("sum_neg"), "n_neg", 0.0)
    return sums.select("entity", "n_genes", (purity - conflict).alias("C"), purity.alias("purity"), conflict.alias("conflict"))


def coherence_relu(sums: DataFrame) -> DataFrame:
    """C from values beyond tau, both terms over observed pairs."""
    purity, conflict = _per(F.col("relu_pos"), "n_seen", 0.0), _per(F.col("relu_neg"), "n_seen", 0.0)
    return sums.select("entity", "n_genes", (purity - conflict).alias("C"), purity.alias("purity"), conflict.alias("conflict"))


def attach(cells: DataFrame, scores: DataFrame, key: str = "cell_id", columns: dict[str, str] | None = None) -> DataFrame:
    """cells with the scores of theirs, NULL where there are none; columns maps names in scores (entity, ...) to new ones."""
    columns = columns or {c: c for c in scores.columns if c != "entity"}
    side = scores.select(F.col("entity").alias("__entity"), *[F.col(a).alias(b) for a, b in columns.items()])
    return cells.join(side, F.col(key) == F.col("__entity"), "left").drop("__entity")


def score_cells(df: DataFrame, npmi: DataFrame, purity_threshold: float = 0.05, purity_percentile: float = 0.8, conflict_percentile: float = 0.8, **options) -> DataFrame:
    """(entity, cell_purity, cell_purity_bool, conflict_score, is_conflict) of the cells of a table of molecules; options are those of ``cells``."""
    s = cell_scores(pair_sums(cells(df, **options), npmi, purity_threshold))
    s = flag(flag(s, "purity", "cell_purity_bool", purity_percentile), "conflict", "is_conflict", conflict_percentile)
    return s.select("entity", F.col("purity").alias("cell_purity"), "cell_purity_bool", F.col("conflict").alias("conflict_score"), "is_conflict")


def score_cells_relu(df: DataFrame, npmi: DataFrame, tau: float = 0.05, purity_percentile: float = 0.8, conflict_percentile: float = 0.8, eps: float = 1e-8, **options) -> DataFrame:
    """The same from values beyond tau: (entity, cell_purity_relu, relative_purity, relative_conflict, signal_strength, is_pure_relu, cell_conflict_relu, is_conflict_relu)."""
    s = cell_scores_relu(pair_sums(cells(df, **options), npmi, tau, tau), eps)
    s = flag(flag(s, "purity", "is_pure_relu", purity_percentile), "conflict", "is_conflict_relu", conflict_percentile)
    return s.select("entity", F.col("purity").alias("cell_purity_relu"), "relative_purity", "relative_conflict", "signal_strength", "is_pure_relu", F.col("conflict").alias("cell_conflict_relu"), "is_conflict_relu")


def component_scores(sums: DataFrame) -> DataFrame:
    """cell_scores with 0 below two features."""
    return cell_scores(sums).fillna(0.0, ["purity", "conflict"])


def flag(scores: DataFrame, column: str, name: str, percentile: float = 0.8, threshold: float | None = None) -> DataFrame:
    """name: whether the score is at least the exact percentile of all scores, or the threshold. False where there is no score."""
    if threshold is not None:
        return scores.withColumn(name, F.coalesce(F.col(column) >= threshold, F.lit(False)))
    bound = scores.agg(F.percentile(column, F.lit(percentile)).alias("__t"))
    return scores.crossJoin(F.broadcast(bound)).withColumn(name, F.coalesce(F.col(column) >= F.col("__t"), F.lit(False))).drop("__t")  # one row


def cells(df: DataFrame, min_molecules: int = 10, genes: DataFrame | None = None, cell: str = "cell_id", gene: str = "feature_name", exclude: tuple[str, ...] = ("UNASSIGNED",)) -> DataFrame:
    """(entity, genes) of cells with enough molecules, counted before features outside genes are left out; a cell may keep none."""
    from cellweave.operators.stats import without

    kept = without(df, exclude, cell).filter(F.col(cell).isNotNull())
    if genes is not None:
        kept = kept.join(genes.select(F.col(genes.columns[0]).alias(gene)).distinct().withColumn("__in", F.lit(True)), gene, "left")
        name = F.when(F.col("__in"), F.col(gene))
    else:
        name = F.col(gene)
    return kept.groupBy(F.col(cell).alias("entity")).agg(F.count("*").alias("n_molecules"), F.array_sort(F.collect_set(name)).alias("genes")).filter(F.col("n_molecules") >= min_molecules).select("entity", "genes")


def pair_statistics(sets: DataFrame, npmi: DataFrame) -> DataFrame:
    """Sum, least, quartiles and number of the observed pair values of each entity."""
    v = pair_values(sets, npmi).groupBy("entity").agg(F.sum("npmi").alias("sum"), F.min("npmi").alias("min"), F.percentile("npmi", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias("q"), F.count("*").alias("n_pairs"))
    out = sets.select("entity", F.size("genes").cast("long").alias("n_genes")).join(v, "entity", "left")
    return out.select("entity", "n_genes", "sum", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))
