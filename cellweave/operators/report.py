"""Summaries of labels, scores and stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.labels import is_unassigned, report_kind
from cellweave.operators.scores import pair_statistics
from cellweave.operators.stats import confident, npmi, on_panel, quality
from cellweave.skew import having


def stage_counts(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """A row per stage column: molecules by kind of their label. All stages are counted in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), report_kind(F.col(s)).alias("kind")) for s in stages]))
    rows = df.select(pairs.alias("s")).select("s.*")
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return rows.groupBy("stage").agg(n("drop", "unknown").alias("unassigned"), n("whole_cell").alias("whole_cell"), n("partial_cell").alias("partial_cell"), n("pseudocell").alias("pseudocell"), F.count("*").alias("total"))


def quality_summary(scores: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, 80th and 95th percentile of each metric, and the number of entities."""
    cols = [f(m) for m in metrics for f in (lambda m: F.avg(m).alias(f"mean_{m}"), lambda m: F.percentile(m, F.lit(0.8)).alias(f"p80_{m}"), lambda m: F.percentile(m, F.lit(0.95)).alias(f"p95_{m}"))]
    return scores.groupBy(*by).agg(F.count("*").alias("n_entities"), *cols)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows, and the share of rows whose two labels are the same, NULLs being alike."""
    return df.agg(F.count("*").alias("n"), F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias("agreement"))


def diagnostics(df: DataFrame, values: DataFrame, cell: str = "cell_id", gene: str = "feature_name") -> DataFrame:
    """Pair statistics of every cell at each step of pruning: original, core_pass1, partial_pass1, partial_pass2, unassigned_from_partial."""
    s1, s2 = F.col("npmi_cons_p1_status"), F.col("npmi_cons_p2_status")
    steps = {"original": F.lit(True), "core_pass1": s1 == "core", "partial_pass1": s1 == "partial_p1", "partial_pass2": s2 == "partial_p2", "unassigned_from_partial": s2 == "unassigned_from_partial"}
    tag = F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in steps.items()]), lambda x: x.isNotNull()))
    rows = df.filter(s1 != "unassigned_input").select(F.col(cell).alias("cell"), F.col(gene).alias("g"), tag.alias("step"))
    sets = rows.groupBy("cell", "step").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("g")).alias("genes")).withColumn("entity", F.struct("cell", "step"))
    stats = pair_statistics(sets.select("entity", "genes"), values)
    return sets.select("entity", "n_rows").join(stats, "entity").select("entity.*", "n_rows", "n_genes", "sum", "min", "p25", "p50", "p75", "n_pairs")


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same ones each time: those of the smallest seeded hash."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def interaction_counts(df: DataFrame, p: str = "p", alpha: float = 0.05, sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """(sender, receiver, n): significant interactions between groups."""
    return df.filter(F.col(p) < alpha).groupBy(sender, receiver).agg(F.count("*").alias("n"))


def interaction_matrix(counts: DataFrame, sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """counts (sender, receiver, n) with a column for each receiver, 0 where they don't interact."""
    return counts.groupBy(sender).pivot(receiver).agg(F.sum("n")).fillna(0)


def interaction_sums(counts: DataFrame, sender: str = "sender", receiver: str = "receiver") -> DataFrame:
    """(group, outbound, inbound): what each group sends and receives in all."""
    both = F.explode(F.array(F.struct(F.col(sender).cast("string").alias("group"), F.col("n").alias("out"), F.lit(0).alias("into")), F.struct(F.col(receiver).cast("string").alias("group"), F.lit(0).alias("out"), F.col("n").alias("into"))))
    return counts.select(both.alias("s")).groupBy("s.group").agg(F.sum("s.out").alias("outbound"), F.sum("s.into").alias("inbound"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, n), the most frequent first."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def spread(df: DataFrame, column: str, percentile: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """The largest value of a column and a percentile of it."""
    return df.groupBy(*by).agg(F.max(column).alias("largest"), F.percentile(column, F.lit(percentile)).alias("percentile"))


def clusters(df: DataFrame, column: str, bad: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Rows whose cluster has a name that isn't among bad, and at least so many of those rows. Clusters are counted first; rows aren't moved while they are few."""
    name = F.col(column)
    named = df.filter(name.isNotNull() & (F.length(name.cast("string")) > 0) & ~name.isin(*bad))
    large = named.groupBy(name).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(column)
    return having(named, large, column)


def annotate(cells: DataFrame, *tables: DataFrame, key: str = "cell_id", other: str = "barcode") -> DataFrame:
    """cells with the columns of each table, joined by key and its column ``other``; NULL where it has no row."""
    for t in tables:
        side = t.withColumn("__key", F.col(other).cast("string")).drop(other)
        cells = cells.join(side, F.col(key).cast("string") == F.col("__key"), "left").drop("__key")
    return cells


def sample_quality(molecules: DataFrame, panel: DataFrame, flags: Sequence[str] = (), minimum: float = 30, quality_col: str = "qv", cell: str = "cell_id", gene: str = "feature_name", by: str = "sample") -> DataFrame:
    """A row per sample: n_genes of its panel (sample, gene), n_cells, total_transcripts, those kept by quality and panel, and whether each flagged feature is on the panel."""
    own = panel.groupBy(by).agg(F.count_distinct(gene).alias("n_genes"), *[F.max(F.col(gene) == g).alias(f"{g}_present") for g in flags])
    on = panel.select(by, gene).distinct().withColumn("__on", F.lit(True))
    good = (F.col(quality_col) > minimum) & F.col("__on")
    rows = molecules.join(on, [by, gene], "left")
    seen = rows.groupBy(by).agg(F.count_distinct(F.when(~is_unassigned(F.col(cell)), F.col(cell))).alias("n_cells"), F.count("*").alias("total_transcripts"), F.count_if(good).alias("kept_transcripts"))
    return own.join(seen, by, "left").select(by, "n_genes", "n_cells", "total_transcripts", "kept_transcripts", *[f"{g}_present" for g in flags]).orderBy(by)


def nucleus_association(molecules: DataFrame, panel: DataFrame, minimum: float = 30, quality_col: str = "qv", gene: str = "feature_name", exclude: Sequence[str] = ("UNASSIGNED",), **options) -> DataFrame:
    """Association over confident nuclei of one sample: quality and panel filter, nuclei of middling size, then npmi."""
    good = on_panel(quality(molecules, minimum, quality_col, strict=True), panel.select(F.col(panel.columns[0]).alias(gene)).distinct(), gene)
    return npmi(confident(good, minimum, exclude=exclude, quality_col=quality_col)[0], gene=gene, **options)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) by equal widths; 0 and bins + 1 hold what is below and above."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
