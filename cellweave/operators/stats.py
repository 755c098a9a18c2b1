"""Counts, co-occurrence statistics, rankings and thresholds of features.

A feature panel is of bounded size, so the arrays of a context's features and the
tables of feature pairs are bounded whatever the number of molecules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellweave.functions.labels import is_unassigned
from cellweave.functions.scalars import clip
from cellweave.util import checkpoint


def quality(df: DataFrame, minimum: float, column: str = "qv", strict: bool = False) -> DataFrame:
    return df.filter(F.col(column) > minimum if strict else F.col(column) >= minimum)


def without(df: DataFrame, labels: Iterable[str] = ("UNASSIGNED",), column: str = "cell_id") -> DataFrame:
    """Rows whose label is none of labels; an empty set drops nothing."""
    labels = list(labels)
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(labels)) if labels else df


def on_panel(df: DataFrame, panel: DataFrame, gene: str = "feature_name") -> DataFrame:
    return df.join(panel.select(gene), gene, "left_semi")


def region(df: DataFrame, x: tuple[float, float], y: tuple[float, float], cell: str = "cell_id") -> DataFrame:
    """All rows of every cell with a molecule in the box, and the unassigned rows in it."""
    box = F.col("x").between(*x) & F.col("y").between(*y)
    none = is_unassigned(F.col(cell))
    cells = df.filter(box & ~none).select(cell).distinct()
    return df.filter(~none).join(cells, cell, "left_semi").select(df.columns).unionByName(df.filter(box & none))


def confident(df: DataFrame, minimum: float = 30, low: float = 0.2, high: float = 0.8, exclude: Iterable[str] = ("UNASSIGNED",), quality_col: str = "qv", cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Molecules over a nucleus, of cells whose count of them is between two exact percentiles; and all that pass the quality filter."""
    good = quality(df, minimum, quality_col)
    inside = without(good, exclude, cell).filter(F.col("overlaps_nucleus") == 1)
    sizes = inside.groupBy(cell).agg(F.count("*").alias("__n"))
    bounds = sizes.agg(F.percentile("__n", F.lit(low)).alias("__lo"), F.percentile("__n", F.lit(high)).alias("__hi"))
    keep = sizes.crossJoin(F.broadcast(bounds)).filter(F.col("__n").between(F.col("__lo"), F.col("__hi"))).select(cell)  # one row
    return inside.join(keep, cell, "left_semi").select(df.columns), good


def cell_gene_counts(df: DataFrame, cell: str = "cell_id", gene: str = "feature_name", exclude: Iterable[str] = (), binary: bool = False) -> DataFrame:
    """(cell, gene, count): the sparse matrix of counts, or of presence."""
    counts = without(df, exclude, cell).groupBy(cell, gene).agg(F.count("*").alias("count"))
    return counts.withColumn("count", F.lit(1).cast("long")) if binary else counts


def cell_totals(counts: DataFrame, cell: str = "cell_id") -> DataFrame:
    return counts.groupBy(cell).agg(F.sum("count").alias("n_transcripts"), F.count("*").alias("n_genes"))


def gene_sets(df: DataFrame, entity: str, gene: str = "feature_name") -> DataFrame:
    """(entity, genes): the sorted distinct features of each entity."""
    return df.groupBy(F.col(entity).alias("entity")).agg(F.array_sort(F.collect_set(gene)).alias("genes"))


def pairs_of(genes: Column) -> Column:
    """All pairs (i < j) of a sorted array."""
    later = lambda g, k: F.transform(F.slice(genes, k + 2, F.size(genes)), lambda h: F.struct(g.alias("i"), h.alias("j")))
    return F.flatten(F.transform(genes, later))


#: Feature pairs that are broadcast, about 20 MB of them.
FEW_PAIRS = 1 << 18


def with_values(sets: DataFrame, npmi: DataFrame, keep: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(keep, gene_i, gene_j, npmi) of the pairs of features of each of sets (..., genes) that npmi has.

    npmi is counted first: up to FEW_PAIRS are broadcast, so that an entity's pairs are met
    where the entity is and no pair, however frequent, is shuffled. Beyond that they are.
    """
    side = checkpoint(npmi.select("gene_i", "gene_j", "npmi"))
    pairs = sets.select(*keep, F.explode(pairs_of(F.col("genes"))).alias("p")).select(*keep, F.col("p.i").alias("gene_i"), F.col("p.j").alias("gene_j"))
    return pairs.join(F.broadcast(side) if side.count() <= FEW_PAIRS else side, ["gene_i", "gene_j"]).select(*keep, "gene_i", "gene_j", "npmi")


def on_features(sets: DataFrame, npmi: DataFrame) -> DataFrame:
    """sets (..., genes) without the features that npmi doesn't know. A panel of features is one bounded array."""
    panel = npmi.select(F.explode(F.array("gene_i", "gene_j")).alias("g")).agg(F.collect_set("g").alias("__panel"))
    return sets.crossJoin(F.broadcast(panel)).withColumn("genes", F.array_sort(F.array_intersect("genes", "__panel"))).drop("__panel")  # one row


def npmi(df: DataFrame, context: str = "cell_id", gene: str = "feature_name", min_count: int = 2, count_col: str | None = None, set_neg_one: bool = False, thr: float = 0.05, grid: bool = True) -> DataFrame:
    """Pointwise mutual information of features over contexts, plain and normalised.

    A feature is in a context with at least min_count molecules of it; contexts without
    any don't count. With grid, all ordered pairs have a row, the diagonal and pairs that
    never meet included; else only i < j that meet. What is undefined is NULL.
    """
    counted = df.groupBy(F.col(context).alias("c"), F.col(gene).alias("g")).agg((F.sum(count_col) if count_col else F.count("*")).alias("n"))
    sets = counted.filter(F.col("n") >= min_count).groupBy("c").agg(F.array_sort(F.collect_list("g")).alias("genes"))
    single = sets.select(F.explode("genes").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    pair = sets.select(F.explode(pairs_of(F.col("genes"))).alias("p")).groupBy("p.i", "p.j").agg(F.count("*").alias("n"))
    total = sets.agg(F.count("*").alias("c"))
    left, right = single.select(F.col("g").alias("gene_i"), F.col("n").alias("ni")), single.select(F.col("g").alias("gene_j"), F.col("n").alias("nj"))
    if grid:
        meet = pair.select(F.col("i").alias("gene_i"), F.col("j").alias("gene_j"), "n")
        meet = meet.unionByName(meet.select(F.col("gene_j").alias("gene_i"), F.col("gene_i").alias("gene_j"), "n")).unionByName(single.select(F.col("g").alias("gene_i"), F.col("g").alias("gene_j"), "n"))
        rows = left.crossJoin(right).join(meet, ["gene_i", "gene_j"], "left").fillna(0, ["n"])  # the grid of the panel is the result
    else:
        rows = pair.select(F.col("i").alias("gene_i"), F.col("j").alias("gene_j"), "n").join(left, "gene_i").join(right, "gene_j")
    rows = rows.crossJoin(F.broadcast(total))  # one row
    p = {k: F.col(k) / F.col("c") for k in ("n", "ni", "nj")}
    pmi = F.when(F.col("n") > 0, F.ln(F.try_divide(p["n"], p["ni"] * p["nj"])))
    norm = F.when((F.col("n") > 0) & (F.col("n") < F.col("c")), pmi / -F.ln(p["n"]))
    if set_neg_one:
        norm = F.when((F.col("n") == 0) & (p["ni"] > thr) & (p["nj"] > thr), F.lit(-1.0)).otherwise(norm)
    return rows.select("gene_i", "gene_j", p["ni"].alias("P_i"), p["nj"].alias("P_j"), p["n"].alias("P_ij"), (F.col("n") / F.col("nj")).alias("P_i_given_j"), (F.col("n") / F.col("ni")).alias("P_j_given_i"), pmi.alias("PMI"), norm.alias("NPMI"), F.col("n").alias("count_ij"))


def upper(pairs: DataFrame) -> DataFrame:
    """(gene_i < gene_j, npmi): each pair once, NULL and NaN left out. Of repeated pairs the largest value stands."""
    a, b = F.col("gene_i"), F.col("gene_j")
    rows = pairs.filter((a != b) & F.col("NPMI").isNotNull() & ~F.isnan("NPMI"))
    return rows.groupBy(F.least(a, b).alias("gene_i"), F.greatest(a, b).alias("gene_j")).agg(F.max("NPMI").alias("npmi"))


def rankings(pairs: DataFrame, min_support: int = 5, npmi_thresh: float = -0.1, power_npmi: float = 3, power_cond: float = 2) -> DataFrame:
    """pairs with NPMI (NULL as -1), drop, cond_prob and score. Unsorted: order by score, gene_i, gene_j for a report."""
    v = F.coalesce(F.when(~F.isnan("NPMI"), F.col("NPMI")), F.lit(-1.0))
    cond = F.least("P_i_given_j", "P_j_given_i")
    drop = (F.col("count_ij") < min_support) | (v <= npmi_thresh)
    return pairs.withColumns({"NPMI": v, "cond_prob": cond, "drop": drop}).withColumn("score", F.when(F.col("drop"), 0.0).otherwise(F.pow("NPMI", F.lit(power_npmi)) * F.pow("cond_prob", F.lit(power_cond))))


def extremes(pairs: DataFrame, n: int = 10, column: str = "NPMI", largest: bool = True) -> DataFrame:
    """The n pairs of the largest or smallest value, with place from 1; ties by name."""
    order = [F.desc(column) if largest else F.asc(column), F.asc("gene_i"), F.asc("gene_j")]
    some = pairs.filter(F.col(column).isNotNull() & ~F.isnan(column)).orderBy(*order).limit(n)
    return some.withColumn("place", F.row_number().over(W.orderBy(*order)))


def noise_partners(npmi: DataFrame, markers: Iterable[str], low: float = -0.1, high: float = -0.05) -> DataFrame:
    """(gene): the features, markers aside, that are weakly anti-correlated with a marker, by name."""
    markers = list(markers)
    a, b = F.col("gene_i"), F.col("gene_j")
    weak = npmi.filter((F.col("npmi") > low) & (F.col("npmi") < high) & (a.isin(markers) | b.isin(markers)))
    return weak.select(F.explode(F.array(a, b)).alias("gene")).filter(~F.col("gene").isin(markers)).distinct().orderBy("gene")


def thresholds(ranked: DataFrame, min_support: int = 5, top: int = 4, npmi_range: tuple[float, float] = (0.01, 0.1), cond_range: tuple[float, float] = (0.001, 0.01)) -> DataFrame:
    """(gene_i, NPMI_thresh, cond_prob_thresh): a gene's top-th largest value counted from 0, or its last, clipped."""
    good = ranked.filter(F.col("count_ij") >= min_support)

    def pick(value: str, bounds: tuple[float, float], name: str) -> DataFrame:
        w = W.partitionBy("gene_i")
        at = F.row_number().over(w.orderBy(F.col(value).desc(), "gene_j"))
        rows = good.withColumn("__at", at).withColumn("__n", F.count("*").over(w)).filter(F.col("__at") == F.least(F.lit(top + 1), F.col("__n")))
        return rows.select("gene_i", clip(F.col(value), *bounds).alias(name))

    return pick("NPMI", npmi_range, "NPMI_thresh").join(pick("cond_prob", cond_range, "cond_prob_thresh"), "gene_i")


#: Tests of a block, whose q-values one task finishes.
BLOCK = 1 << 16


def benjamini_hochberg(df: DataFrame, p: str = "p", name: str = "q", key: str = "id") -> DataFrame:
    """Adjusted p-values over all finite ones; others stay NULL.

    Ranks come from a sort by range. Within blocks of ranks, and then over the blocks'
    minima, the least adjusted value of all later ranks is carried down: no task holds all
    tests, only one minimum for each block.
    """
    from cellweave.sources.tables import number_rows

    ok = F.col(p).isNotNull() & ~F.isnan(p)
    ranked = checkpoint(number_rows(df.filter(ok), [p, key], "__r"))
    n = ranked.count()
    ranked = ranked.withColumns({"__v": F.col(p) * F.lit(n) / (F.col("__r") + 1), "__b": F.floor(F.col("__r") / BLOCK)})
    later = ranked.groupBy("__b").agg(F.min("__v").alias("__m")).withColumn("__after", F.min("__m").over(W.orderBy("__b").rowsBetween(1, W.unboundedFollowing))).drop("__m")
    own = F.min("__v").over(W.partitionBy("__b").orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, 0))
    q = F.least(F.lit(1.0), "__own", "__after")
    done = ranked.withColumn("__own", own).join(later, "__b").withColumn(name, q).select(*df.columns, name)
    return done.unionByName(df.filter(~ok).withColumn(name, F.lit(None).cast("double")))
