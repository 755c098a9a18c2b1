"""The operators applied to the driver's tables, each beside its SQL.

Molecules are derived from events; statistics use features that a cell holds at least
once. Computed doubles are rounded to 9 places on both sides, as sums depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import labels
from cellweave.functions.scalars import point_wkt, relu_symmetric, to_number
from cellweave.operators import geometry, graph, near, partition, prune, refine, report, scores, stats, stitch
from cellweave.operators.components import connected_components
from cellweave.plans import pipeline
from cellweave.plans.catalogue import ORACLES, QUERIES, query
from cellweave.sources import tables
from cellweave.streaming import cooccurrence
from cellweave.util import checkpoint

__all__ = ["ORACLES", "QUERIES"]

THRESHOLD = -0.1


def r9(*names: str) -> dict:
    return {n: F.round(n, 9) for n in names}


def r6(*names: str) -> dict:
    """For what is computed from rounded numbers, where halves of the ninth place occur."""
    return {n: F.round(n, 6) for n in names}


def mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.molecules_of_events(spark, sf_dir)


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mol(spark, sf_dir).filter(~labels.is_unassigned(F.col("cell_id")))


def pairs(spark: SparkSession, sf_dir: str, grid: bool = True) -> DataFrame:
    return stats.npmi(assigned(spark, sf_dir), min_count=1, grid=grid)


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, so that both engines compare the same numbers with a threshold; counted once, however often it is used."""
    return checkpoint(stats.upper(pairs(spark, sf_dir, grid=False)).withColumns(r9("npmi")))


def loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mol(spark, sf_dir).filter(labels.is_unassigned(F.col("cell_id")))


MOL = """mol AS (SELECT event_id AS transcript_id, event_type || '_' || (CAST(json_extract(props, '$.k') AS INT) % 12) AS feature_name,
  CASE WHEN event_id % 10 = 0 THEN '-1' ELSE CAST(user_id AS VARCHAR) END AS cell_id, value AS x,
  (epoch_us(ts) % 86400000000) / 1e6 / 172.8 AS y, CAST(day(ts) AS DOUBLE) AS z FROM events)"""
NPMI = (
    MOL
    + """, cg AS (SELECT DISTINCT cell_id AS c, feature_name AS g FROM mol WHERE cell_id <> '-1'),
tot AS (SELECT count(DISTINCT c) AS tc FROM cg), one AS (SELECT g, count(*) AS n FROM cg GROUP BY g),
two AS (SELECT a.g AS gi, b.g AS gj, count(*) AS n FROM cg a JOIN cg b USING (c) GROUP BY ALL),
np AS (SELECT a.g AS gene_i, b.g AS gene_j, a.n / tc AS P_i, b.n / tc AS P_j, coalesce(t.n, 0) / tc AS P_ij, coalesce(t.n, 0) / b.n AS P_i_given_j, coalesce(t.n, 0) / a.n AS P_j_given_i,
  CASE WHEN t.n > 0 THEN ln((t.n / tc) / ((a.n / tc) * (b.n / tc))) END AS PMI,
  CASE WHEN t.n > 0 AND t.n < tc THEN ln((t.n / tc) / ((a.n / tc) * (b.n / tc))) / -ln(t.n / tc) END AS NPMI, coalesce(t.n, 0) AS count_ij
  FROM one a CROSS JOIN one b CROSS JOIN tot LEFT JOIN two t ON t.gi = a.g AND t.gj = b.g),
up AS (SELECT gene_i, gene_j, round(NPMI, 9) AS npmi FROM np WHERE gene_i < gene_j AND NPMI IS NOT NULL)"""
)
#: Pair sums of the entities of a CTE eg(e, g) with distinct rows.
SUMS = """ent AS (SELECT e, count(*) AS k, count(*) * (count(*) - 1) / 2 AS kk FROM eg GROUP BY e),
pv AS (SELECT a.e, npmi AS v, CASE WHEN npmi > 0.05 THEN npmi - 0.05 WHEN npmi < -0.05 THEN npmi + 0.05 ELSE 0 END AS r FROM eg a JOIN eg b ON a.e = b.e AND a.g < b.g JOIN up ON gene_i = a.g AND gene_j = b.g),
s AS (SELECT ent.e, ent.k, ent.kk, count(v) AS n_seen, count(*) FILTER (v > 0.05) AS n_pos, count(*) FILTER (v < 0) AS n_neg, coalesce(sum(-v) FILTER (v < 0), 0) AS sum_neg,
  coalesce(sum(r) FILTER (r > 0), 0) AS rp, coalesce(sum(-r) FILTER (r < 0), 0) AS rn FROM ent LEFT JOIN pv ON ent.e = pv.e GROUP BY ALL)"""
CELLS = "eg AS (SELECT DISTINCT cell_id AS e, feature_name AS g FROM mol WHERE cell_id <> '-1' AND cell_id IN (SELECT cell_id FROM mol GROUP BY 1 HAVING count(*) >= 10))"


def cell_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.pair_sums(scores.cells(mol(spark, sf_dir), 10, exclude=("-1",)), upper(spark, sf_dir))


# Sources, filters, counts


@query("molecules", f"WITH {MOL} SELECT transcript_id, feature_name, cell_id, x, y, z FROM mol")
def _(spark, d):
    return mol(spark, d)


@query("quality_filter", f"WITH {MOL} SELECT transcript_id, feature_name FROM mol WHERE x >= 30 AND cell_id <> '-1'")
def _(spark, d):
    return stats.without(stats.quality(mol(spark, d), 30, "x"), ("-1",)).select("transcript_id", "feature_name")


@query("panel_filter", f"WITH {MOL} SELECT transcript_id, feature_name FROM mol WHERE contains(feature_name, '_1')")
def _(spark, d):
    panel = mol(spark, d).filter(F.col("feature_name").contains("_1")).select("feature_name").distinct()
    return stats.on_panel(mol(spark, d), panel).select("transcript_id", "feature_name")


@query(
    "confident_cells",
    f"""WITH {MOL}, n AS (SELECT * FROM mol WHERE x >= 20 AND cell_id <> '-1' AND transcript_id % 3 <> 0), s AS (SELECT cell_id, count(*) AS n FROM n GROUP BY 1),
b AS (SELECT quantile_cont(n, 0.2) AS lo, quantile_cont(n, 0.8) AS hi FROM s) SELECT transcript_id, cell_id FROM n WHERE cell_id IN (SELECT cell_id FROM s, b WHERE n BETWEEN lo AND hi)""",
)
def _(spark, d):
    rows = mol(spark, d).withColumn("overlaps_nucleus", (F.col("transcript_id") % 3 != 0).cast("int"))
    return stats.confident(rows, 20, exclude=("-1",), quality_col="x")[0].select("transcript_id", "cell_id")


@query("cell_gene_counts", f"WITH {MOL} SELECT cell_id, feature_name, count(*) AS count FROM mol WHERE cell_id <> '-1' GROUP BY ALL")
def _(spark, d):
    return stats.cell_gene_counts(mol(spark, d), exclude=("-1",))


@query("cell_totals", f"WITH {MOL} SELECT cell_id, count(*) AS n_transcripts, count(DISTINCT feature_name) AS n_genes FROM mol WHERE cell_id <> '-1' GROUP BY 1")
def _(spark, d):
    return stats.cell_totals(stats.cell_gene_counts(mol(spark, d), exclude=("-1",)))


@query(
    "roi_subset",
    f"""WITH {MOL}, b AS (SELECT * FROM mol WHERE x BETWEEN 10 AND 12 AND y BETWEEN 100 AND 300) SELECT transcript_id, cell_id FROM mol
WHERE (cell_id <> '-1' AND cell_id IN (SELECT cell_id FROM b)) OR (cell_id = '-1' AND transcript_id IN (SELECT transcript_id FROM b))""",
)
def _(spark, d):
    return stats.region(mol(spark, d), (10, 12), (100, 300)).select("transcript_id", "cell_id")


@query(
    "entity_kind",
    f"""WITH {MOL}, l AS (SELECT transcript_id, CASE transcript_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'DROP' WHEN 2 THEN 'UNASSIGNED_' || cell_id WHEN 3 THEN cell_id || '-1' WHEN 4 THEN 'UNASSIGNED' ELSE cell_id END AS label FROM mol)
SELECT transcript_id, CASE WHEN label IS NULL THEN 'unknown' WHEN label = 'DROP' THEN 'drop' WHEN starts_with(label, 'UNASSIGNED_') THEN 'component' WHEN contains(label, '-') THEN 'partial' ELSE 'cell' END AS kind,
CASE WHEN label IS NULL THEN 'unknown' WHEN label IN ('DROP', 'UNASSIGNED', '-1') THEN 'drop' WHEN starts_with(label, 'UNASSIGNED_') THEN 'pseudocell' WHEN contains(label, '-') THEN 'partial_cell' ELSE 'whole_cell' END AS report FROM l""",
)
def _(spark, d):
    return _labelled(spark, d).select("transcript_id", labels.entity_kind(F.col("label")).alias("kind"), labels.report_kind(F.col("label")).alias("report"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    cell, k = F.col("cell_id"), F.col("transcript_id") % 7
    label = F.when(k == 0, None).when(k == 1, "DROP").when(k == 2, F.concat(F.lit("UNASSIGNED_"), cell)).when(k == 3, F.concat(cell, F.lit("-1"))).when(k == 4, "UNASSIGNED").otherwise(cell)
    return mol(spark, d).withColumn("label", label)


@query(
    "stage_counts",
    f"""WITH {MOL}, l AS (SELECT 'cell_id' AS stage, cell_id AS label FROM mol UNION ALL SELECT 'label', CASE transcript_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'DROP' WHEN 2 THEN 'UNASSIGNED_' || cell_id WHEN 3 THEN cell_id || '-1' WHEN 4 THEN 'UNASSIGNED' ELSE cell_id END FROM mol),
k AS (SELECT stage, CASE WHEN label IS NULL THEN 'd' WHEN label IN ('DROP', 'UNASSIGNED', '-1') THEN 'd' WHEN starts_with(label, 'UNASSIGNED_') THEN 'c' WHEN contains(label, '-') THEN 'p' ELSE 'w' END AS kind FROM l)
SELECT stage, count(*) FILTER (kind = 'd') AS unassigned, count(*) FILTER (kind = 'w') AS whole_cell, count(*) FILTER (kind = 'p') AS partial_cell, count(*) FILTER (kind = 'c') AS pseudocell, count(*) AS total FROM k GROUP BY stage""",
)
def _(spark, d):
    return report.stage_counts(_labelled(spark, d), ["cell_id", "label"])


@query("label_agreement", f"WITH {MOL} SELECT count(*) AS n, round(avg(CASE WHEN transcript_id % 7 IN (5, 6) THEN 1.0 WHEN transcript_id % 7 = 0 THEN 0.0 ELSE 0.0 END), 9) AS agreement FROM mol")
def _(spark, d):
    return report.agreement(_labelled(spark, d), "cell_id", "label").withColumns(r9("agreement"))


@query("value_histogram", f"WITH {MOL} SELECT CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 100 THEN 21 ELSE floor(x / 5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM mol GROUP BY 1")
def _(spark, d):
    return report.histogram(mol(spark, d), "x", 0, 100, 20)


# Association


@query("npmi_pairs", f"WITH {NPMI} SELECT gene_i, gene_j, round(P_i, 9) AS P_i, round(P_j, 9) AS P_j, round(P_ij, 9) AS P_ij, round(P_i_given_j, 9) AS P_i_given_j, round(P_j_given_i, 9) AS P_j_given_i, round(PMI, 9) AS PMI, round(NPMI, 9) AS NPMI, count_ij FROM np")
def _(spark, d):
    return pairs(spark, d).withColumns(r9("P_i", "P_j", "P_ij", "P_i_given_j", "P_j_given_i", "PMI", "NPMI"))


@query("npmi_top_pairs", f"WITH {NPMI} SELECT gene_i, gene_j, npmi, row_number() OVER (ORDER BY npmi DESC, gene_i, gene_j) AS place FROM up QUALIFY place <= 10")
def npmi_top_pairs(spark, d):
    from pyspark.sql.window import Window as W

    top = upper(spark, d).orderBy(F.desc("npmi"), "gene_i", "gene_j").limit(10)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("npmi"), "gene_i", "gene_j")))


@query("market_npmi", """WITH b AS (SELECT DISTINCT o_custkey AS c, p_type || l_returnflag || (p_size % 5) AS g FROM (SELECT o_custkey, p_type, l_returnflag, p_size, count(*) OVER (PARTITION BY o_custkey, p_type || l_returnflag || (p_size % 5)) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WHERE n >= 2), t AS (SELECT count(DISTINCT c) AS tc FROM b), o AS (SELECT g, count(*) AS n FROM b GROUP BY g),
p AS (SELECT x.g AS gene_i, y.g AS gene_j, count(*) AS n FROM b x JOIN b y ON x.c = y.c AND x.g < y.g GROUP BY ALL)
SELECT gene_i, gene_j, p.n AS count_ij, round(ln((p.n / tc) / ((i.n / tc) * (j.n / tc))) / -ln(p.n / tc), 9) AS NPMI FROM p JOIN o i ON i.g = gene_i JOIN o j ON j.g = gene_j, t""")
def _(spark, d):
    read = lambda n, *c: spark.read.parquet(f"{d}/{n}.parquet").select(*c)
    rows = read("lineitem", "l_orderkey", "l_partkey", "l_returnflag").join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("part", "p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("g", F.concat("p_type", "l_returnflag", (F.col("p_size") % 5).cast("string")))
    return stats.npmi(rows, "o_custkey", "g", 2, grid=False).select("gene_i", "gene_j", "count_ij", F.round("NPMI", 9).alias("NPMI"))


RANKED = NPMI + """, rk AS (SELECT gene_i, gene_j, count_ij, coalesce(round(NPMI, 9), -1) AS NPMI, least(P_i_given_j, P_j_given_i) AS cond_prob, count_ij < 5 OR coalesce(round(NPMI, 9), -1) <= -0.1 AS dropped FROM np WHERE gene_i <> gene_j)"""


def ranked(spark, d):
    return stats.rankings(pairs(spark, d).filter("gene_i <> gene_j").withColumns(r9("NPMI")))


@query("pair_rankings", f'WITH {RANKED} SELECT gene_i, gene_j, count_ij, NPMI, round(cond_prob, 9) AS cond_prob, dropped AS "drop", CASE WHEN dropped THEN 0.0 ELSE round(pow(NPMI, 3) * pow(cond_prob, 2), 9) END AS score FROM rk')
def _(spark, d):
    return ranked(spark, d).select("gene_i", "gene_j", "count_ij", "NPMI", F.round("cond_prob", 9).alias("cond_prob"), "drop", F.round("score", 9).alias("score"))


GATES = RANKED + """, gd AS (SELECT *, row_number() OVER (PARTITION BY gene_i ORDER BY NPMI DESC, gene_j) AS rn, row_number() OVER (PARTITION BY gene_i ORDER BY cond_prob DESC, gene_j) AS rc, count(*) OVER (PARTITION BY gene_i) AS n FROM rk WHERE count_ij >= 5),
gates AS (SELECT gene_i, max(NPMI) FILTER (rn = least(5, n)) AS a, max(cond_prob) FILTER (rc = least(5, n)) AS b FROM gd GROUP BY 1)"""


@query("gene_thresholds", f"WITH {GATES} SELECT gene_i, greatest(0.01, least(0.1, a)) AS NPMI_thresh, greatest(0.001, least(0.01, b)) AS cond_prob_thresh FROM gates")
def _(spark, d):
    return stats.thresholds(ranked(spark, d))


@query("streamed_npmi", f"WITH {NPMI} SELECT gene_i, gene_j, npmi FROM up")
def _(spark, d):
    state = cooccurrence.counts(assigned(spark, d))
    return stats.upper(cooccurrence.npmi_of_counts(state, min_count=1, grid=False)).withColumns(r9("npmi"))


# Scores


@query("cell_scores", f"WITH {NPMI}, {CELLS}, {SUMS} SELECT e AS entity, k AS n_genes, round(CASE WHEN kk > 0 THEN n_pos / kk END, 9) AS purity, round(CASE WHEN kk > 0 THEN sum_neg / kk END, 9) AS conflict FROM s")
def _(spark, d):
    return scores.cell_scores(cell_sums(spark, d)).withColumn("n_genes", F.col("n_genes").cast("long")).withColumns(r9("purity", "conflict"))


@query(
    "cell_scores_relu",
    (f"""WITH {NPMI}, {CELLS}, {SUMS} SELECT e AS entity, k AS n_genes, round(CASE WHEN kk > 0 THEN rp / kk END, 9) AS purity, round(CASE WHEN kk > 0 THEN rn / kk END, 9) AS conflict,
round(CASE WHEN kk > 0 THEN rp + rn END, 9) AS signal_strength, round(CASE WHEN kk > 0 AND rp + rn > 1e-8 THEN rp / (rp + rn) END, 9) AS relative_purity, round(CASE WHEN kk > 0 AND rp + rn > 1e-8 THEN rn / (rp + rn) END, 9) AS relative_conflict FROM s"""),
)
def _(spark, d):
    return scores.cell_scores_relu(cell_sums(spark, d)).withColumns(r9("purity", "conflict", "signal_strength", "relative_purity", "relative_conflict"))


@query("purity_flags", (f"WITH {NPMI}, {CELLS}, {SUMS}, p AS (SELECT e, round(n_pos / nullif(kk, 0), 9) AS purity, round(sum_neg / nullif(kk, 0), 9) AS conflict FROM s), b AS (SELECT quantile_cont(purity, 0.8) AS tp, quantile_cont(conflict, 0.8) AS tc FROM p) SELECT e AS entity, coalesce(purity >= tp, false) AS is_pure, coalesce(conflict >= tc, false) AS is_conflict FROM p, b"))
def _(spark, d):
    s = scores.cell_scores(cell_sums(spark, d)).withColumns(r9("purity", "conflict"))
    return scores.flag(scores.flag(s, "purity", "is_pure"), "conflict", "is_conflict").select("entity", "is_pure", "is_conflict")


ALL_METRICS = f"WITH {NPMI}, {CELLS}, {SUMS}, p AS (SELECT e, round(n_pos / nullif(kk, 0), 9) AS purity, round(sum_neg / nullif(kk, 0), 9) AS conflict, CASE WHEN kk > 0 THEN rp / kk END AS pr, CASE WHEN kk > 0 THEN rn / kk END AS cr, CASE WHEN kk > 0 THEN rp + rn END AS signal, CASE WHEN rp + rn > 1e-8 THEN rp / (rp + rn) END AS rel_p, CASE WHEN rp + rn > 1e-8 THEN rn / (rp + rn) END AS rel_c FROM s)"


def _library(spark, d):
    return mol(spark, d).groupBy("cell_id").agg(F.count("*").alias("library_size"))


@query("cell_metrics", f"{ALL_METRICS} SELECT m.cell_id, library_size, purity AS cell_purity, conflict AS conflict_score FROM (SELECT cell_id, count(*) AS library_size FROM mol GROUP BY 1) m LEFT JOIN p ON p.e = m.cell_id")
def _(spark, d):
    s = scores.score_cells(mol(spark, d), upper(spark, d), exclude=("-1",))
    out = scores.attach(_library(spark, d), s)
    return out.select("cell_id", "library_size", *[F.round(c, 9).alias(c) for c in ("cell_purity", "conflict_score")])


@query("cell_metrics_relu", f"{ALL_METRICS} SELECT m.cell_id, library_size, round(pr, 9) AS cell_purity_relu, round(cr, 9) AS cell_conflict_relu, round(signal, 9) AS signal_strength, round(rel_p, 6) AS relative_purity, round(rel_c, 6) AS relative_conflict FROM (SELECT cell_id, count(*) AS library_size FROM mol GROUP BY 1) m LEFT JOIN p ON p.e = m.cell_id")
def _(spark, d):
    s = scores.score_cells_relu(mol(spark, d), upper(spark, d), exclude=("-1",))
    out = scores.attach(_library(spark, d), s)
    return out.select("cell_id", "library_size", "cell_purity_relu", "cell_conflict_relu", "signal_strength", "relative_purity", "relative_conflict").withColumns(r9("cell_purity_relu", "cell_conflict_relu", "signal_strength") | r6("relative_purity", "relative_conflict"))


@query("quality_summary_relu", f"{ALL_METRICS} SELECT count(*) AS n_entities, " + ", ".join(f"round(avg({c}), 6) AS mean_{m}, round(quantile_cont({c}, 0.8), 6) AS p80_{m}, round(quantile_cont({c}, 0.95), 6) AS p95_{m}" for m, c in (("cell_purity_relu", "pr"), ("cell_conflict_relu", "cr"), ("signal_strength", "signal"), ("relative_purity", "rel_p"))) + " FROM p")
def _(spark, d):
    names = ["cell_purity_relu", "cell_conflict_relu", "signal_strength", "relative_purity"]
    out = report.quality_summary(scores.score_cells_relu(mol(spark, d), upper(spark, d), exclude=("-1",)), names)
    return out.withColumns(r6(*[f"{k}_{m}" for m in names for k in ("mean", "p80", "p95")]))


@query("coherence", (f"WITH {NPMI}, {CELLS}, {SUMS} SELECT e AS entity, round(coalesce(n_pos / nullif(n_seen, 0), 0) - coalesce(sum_neg / nullif(n_neg, 0), 0), 6) AS c, round(coalesce(rp / nullif(n_seen, 0), 0) - coalesce(rn / nullif(n_seen, 0), 0), 6) AS c_relu FROM s"))
def _(spark, d):
    sums = cell_sums(spark, d)
    plain, relu = scores.coherence(sums).select("entity", F.round("C", 6).alias("c")), scores.coherence_relu(sums).select("entity", F.round("C", 6).alias("c_relu"))
    return plain.join(relu, "entity")


@query("gene_set_stats", (f"WITH {NPMI}, {CELLS}, {SUMS} SELECT ent.e AS entity, k AS n_genes, round(sum(v), 6) AS sum, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, count(v) AS n_pairs FROM ent LEFT JOIN pv ON ent.e = pv.e GROUP BY ent.e, k"))
def _(spark, d):
    return scores.pair_statistics(scores.cells(mol(spark, d), 10, exclude=("-1",)), upper(spark, d)).withColumns(r6("sum", "p25", "p50", "p75"))


@query("quality_summary", (f"WITH {NPMI}, {CELLS}, {SUMS}, p AS (SELECT n_pos / nullif(kk, 0) AS purity, sum_neg / nullif(kk, 0) AS conflict FROM s) SELECT count(*) AS n_entities, round(avg(purity), 9) AS mean_purity, round(quantile_cont(purity, 0.8), 9) AS p80_purity, round(quantile_cont(purity, 0.95), 9) AS p95_purity, round(avg(conflict), 9) AS mean_conflict, round(quantile_cont(conflict, 0.8), 9) AS p80_conflict, round(quantile_cont(conflict, 0.95), 9) AS p95_conflict FROM p"))
def _(spark, d):
    names = [f"{s}_{m}" for m in ("purity", "conflict") for s in ("mean", "p80", "p95")]
    return report.quality_summary(scores.cell_scores(cell_sums(spark, d)), ["purity", "conflict"]).withColumns(r9(*names))


# Pruning

PASS1 = """bad AS (SELECT a.e, a.g AS i, b.g AS j FROM eg a JOIN eg b USING (e) JOIN np ON gene_i = a.g AND gene_j = b.g AND a.g <> b.g WHERE round(NPMI, 9) < -0.1),
r(e, removed) AS (SELECT DISTINCT e, CAST([] AS VARCHAR[]) FROM eg UNION ALL
  SELECT e, list_append(removed, rm) FROM (SELECT q.e, any_value(q.removed) AS removed, arg_min(q.i, (-q.n, q.i)) AS rm FROM (
    SELECT r.e, r.removed, b.i, count(*) AS n FROM r JOIN bad b ON b.e = r.e WHERE NOT list_contains(r.removed, b.i) AND NOT list_contains(r.removed, b.j) GROUP BY ALL) q GROUP BY q.e)),
gone AS (SELECT e, unnest(arg_max(removed, len(removed))) AS g FROM r GROUP BY e)"""
ALL_CELLS = "eg AS (SELECT DISTINCT cell_id AS e, feature_name AS g FROM mol WHERE cell_id <> '-1')"


@query("prune_pass1", f"WITH RECURSIVE {NPMI}, {ALL_CELLS}, {PASS1} SELECT e AS entity, g AS gene FROM gone")
def _(spark, d):
    return prune.removals(stats.gene_sets(assigned(spark, d), "cell_id"), upper(spark, d), THRESHOLD)


TWO = (
    NPMI
    + f", {ALL_CELLS}, {PASS1}, "
    + PASS1.replace("bad", "bad2").replace("gone", "gone2").replace("eg ", "eg2 ").replace("FROM eg2 UNION", "FROM eg2 UNION").replace("r(e", "r2(e").replace("FROM r JOIN", "FROM r2 r JOIN").replace("FROM r GROUP", "FROM r2 GROUP").replace("JOIN eg2 b USING", "JOIN eg2 b USING")
)
TWO = TWO.replace("bad2 AS (", "eg2 AS (SELECT e || '-1' AS e, g FROM gone), bad2 AS (")
LABELS = f"""{TWO}, two_pass AS (SELECT transcript_id, feature_name, x, y, z, cell_id, CASE WHEN g1.g IS NULL THEN cell_id ELSE cell_id || '-1' END AS p1,
  CASE WHEN cell_id = '-1' THEN 'unassigned_input' WHEN g1.g IS NULL THEN 'core' ELSE 'partial_p1' END AS s1,
  CASE WHEN g1.g IS NULL THEN cell_id WHEN g2.g IS NULL THEN cell_id || '-1' ELSE '-1' END AS p2,
  CASE WHEN g1.g IS NULL THEN 'unchanged' WHEN g2.g IS NULL THEN 'partial_p2' ELSE 'unassigned_from_partial' END AS s2
  FROM mol LEFT JOIN gone g1 ON g1.e = cell_id AND g1.g = feature_name LEFT JOIN gone2 g2 ON g2.e = cell_id || '-1' AND g2.g = feature_name)"""


@query("prune_two_pass", f"WITH RECURSIVE {LABELS} SELECT transcript_id, p1 AS cell_id_npmi_cons_p1, s1 AS npmi_cons_p1_status, p2 AS cell_id_npmi_cons_p2, s2 AS npmi_cons_p2_status FROM two_pass")
def _(spark, d):
    return prune.prune_molecules(mol(spark, d), upper(spark, d)).select("transcript_id", "cell_id_npmi_cons_p1", "npmi_cons_p1_status", "cell_id_npmi_cons_p2", "npmi_cons_p2_status")


@query("prune_residual_conflicts", "SELECT 0 AS n")
def _(spark, d):
    sets, w = stats.gene_sets(assigned(spark, d), "cell_id"), upper(spark, d)
    gone = prune.removals(sets, w, THRESHOLD).groupBy("entity").agg(F.collect_set("gene").alias("gone"))
    left = sets.join(gone, "entity", "left").select("entity", F.array_except("genes", F.coalesce("gone", F.array().cast("array<string>"))).alias("genes"))
    return prune.residual_conflicts(left, w, THRESHOLD).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("n"))


@query(
    "diagnostic_report",
    f"""WITH RECURSIVE {LABELS}, st AS (SELECT cell_id AS cell, unnest(list_filter(['original', CASE WHEN s1 = 'core' THEN 'core_pass1' END, CASE WHEN s1 = 'partial_p1' THEN 'partial_pass1' END, CASE WHEN s2 = 'partial_p2' THEN 'partial_pass2' END, CASE WHEN s2 = 'unassigned_from_partial' THEN 'unassigned_from_partial' END], lambda q: q IS NOT NULL)) AS step, feature_name AS g FROM two_pass WHERE s1 <> 'unassigned_input'),
n AS (SELECT cell, step, count(*) AS n_rows, count(DISTINCT g) AS n_genes FROM st GROUP BY ALL), dg AS (SELECT DISTINCT cell, step, g FROM st),
v AS (SELECT a.cell, a.step, npmi AS v FROM dg a JOIN dg b ON a.cell = b.cell AND a.step = b.step AND a.g < b.g JOIN up ON gene_i = a.g AND gene_j = b.g)
SELECT n.cell, n.step, n_rows, n_genes, round(sum(v), 6) AS sum, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, count(v) AS n_pairs FROM n LEFT JOIN v ON n.cell = v.cell AND n.step = v.step GROUP BY ALL""",
)
def _(spark, d):
    w = upper(spark, d)
    return report.diagnostics(prune.prune_molecules(mol(spark, d), w), w).withColumns(r6("sum", "p25", "p50", "p75"))


# Graphs

KNN = """le AS (SELECT transcript_id AS id, feature_name, x, y, z FROM mol WHERE cell_id = '-1'),
kn AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS length FROM le a JOIN le b ON a.id <> b.id AND b.x BETWEEN a.x - 10.1 AND a.x + 10.1 WHERE length <= 10
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(length, 6), b.id) <= 8),
ue AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(length) AS length FROM kn GROUP BY ALL)"""


def knn(spark, d):
    return graph.radius_knn(loose(spark, d), 8, 10.0)


@query("knn_edges", f"WITH {MOL}, {KNN} SELECT src, dst, round(length, 9) AS length FROM kn")
def _(spark, d):
    return knn(spark, d).withColumns(r9("length"))


@query(
    "knn_points3d",
    """WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
SELECT a.id AS src, b.id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS length FROM p a JOIN p b ON a.id <> b.id
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(length, 6), b.id) <= 5""",
)
def _(spark, d):
    return graph.radius_knn(_points(spark, d), 5, 0.1, key="id").withColumns(r9("length"))


def _points(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


@query("undirected_degree", f"WITH {MOL}, {KNN} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ue UNION ALL SELECT dst FROM ue) GROUP BY 1")
def _(spark, d):
    return graph.degrees(graph.undirected(knn(spark, d)))


ASSOC = f"{GATES}, {KNN}, ea AS (SELECT ue.*, a.feature_name AS gene_src, b.feature_name AS gene_dst, coalesce(rk.NPMI, 0) AS npmi, coalesce(rk.cond_prob, 0) AS cond_prob FROM ue JOIN le a ON a.id = src JOIN le b ON b.id = dst LEFT JOIN rk ON NOT dropped AND gene_i = a.feature_name AND gene_j = b.feature_name)"


def associated(spark, d):
    return graph.associate(graph.undirected(knn(spark, d)), loose(spark, d), ranked(spark, d))


@query("edge_assoc", f"WITH {ASSOC} SELECT src, dst, round(length, 9) AS length, gene_src, gene_dst, npmi, round(cond_prob, 9) AS cond_prob FROM ea")
def _(spark, d):
    return associated(spark, d).withColumns(r9("length", "cond_prob"))


@query(
    "pruned_edges",
    f"""WITH {ASSOC}, t AS (SELECT ea.*, coalesce(greatest(0.01, least(0.1, a)), 0.1) AS tn, coalesce(greatest(0.001, least(0.01, b)), 0.01) AS tc FROM ea LEFT JOIN gates ON gates.gene_i = gene_src),
f AS (SELECT *, npmi > tn AND cond_prob > tc AND length < 5 AS strong FROM t) SELECT src, dst, npmi, CAST(strong AS INT) AS connect FROM f WHERE strong OR NOT (npmi <= -0.1 OR cond_prob <= 0.001 OR length >= 9)""",
)
def _(spark, d):
    return graph.prune_edges(associated(spark, d), stats.thresholds(ranked(spark, d)), (5.0, 9.0)).select("src", "dst", "npmi", "connect")


CC = "rc(node, reach) AS (SELECT id, id FROM le UNION SELECT rc.node, e.d FROM rc JOIN (SELECT src AS s, dst AS d FROM ue UNION ALL SELECT dst, src FROM ue) e ON rc.reach = e.s), cc AS (SELECT node, min(reach) AS component FROM rc GROUP BY node)"


@query("components", f"WITH RECURSIVE {MOL}, {KNN}, {CC} SELECT node, component FROM cc WHERE node IN (SELECT src FROM ue UNION SELECT dst FROM ue)")
def _(spark, d):
    return connected_components(knn(spark, d))


@query(
    "component_summary",
    f"""WITH RECURSIVE {MOL}, {KNN}, {CC}, o AS (SELECT component, m.* FROM cc JOIN mol m ON node = transcript_id WHERE node IN (SELECT src FROM ue UNION SELECT dst FROM ue)),
v AS (SELECT component, label, n FROM (SELECT component, 'L' || (transcript_id % 4) AS label, count(*) AS n FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, label) = 1)
SELECT o.component, count(*) AS n_nodes, count(DISTINCT feature_name) AS n_unique_genes, round(avg(x), 9) AS centroid_x, round(avg(y), 9) AS centroid_y, any_value(v.label) AS assigned_cell_id, round(any_value(v.n) / count(*), 9) AS cell_id_purity FROM o JOIN v ON v.component = o.component GROUP BY o.component HAVING count(*) >= 5""",
)
def _(spark, d):
    nodes = loose(spark, d).withColumn("cell_id", F.concat(F.lit("L"), (F.col("transcript_id") % 4).cast("string")))
    out = graph.component_summary(connected_components(knn(spark, d)), nodes, min_size=5).withColumns(r9("centroid_x", "centroid_y", "cell_id_purity"))
    return out.select("component", "n_nodes", "n_unique_genes", "centroid_x", "centroid_y", "assigned_cell_id", "cell_id_purity")


COMPONENT_SUMS = f"{NPMI}, {KNN}, {CC}, oc AS (SELECT component, feature_name FROM cc JOIN mol ON node = transcript_id WHERE node IN (SELECT src FROM ue UNION SELECT dst FROM ue)), eg AS (SELECT DISTINCT component AS e, feature_name AS g FROM oc), {SUMS}, nn AS (SELECT component AS e, count(*) AS n_nodes FROM oc GROUP BY 1)"


@query(
    "scored_components",
    f"""WITH RECURSIVE {COMPONENT_SUMS} SELECT e AS component, n_nodes, k AS n_unique_genes, round(coalesce(rp / nullif(kk, 0), 0), 9) AS purity, round(coalesce(rn / nullif(kk, 0), 0), 9) AS conflict, round(CASE WHEN kk > 0 THEN rp + rn ELSE 0 END, 9) AS signal_strength,
round(CASE WHEN kk > 0 AND rp + rn > 1e-8 THEN rp / (rp + rn) ELSE 0 END, 6) AS relative_purity, round(CASE WHEN kk > 0 AND rp + rn > 1e-8 THEN rn / (rp + rn) ELSE 0 END, 6) AS relative_conflict FROM s JOIN nn USING (e)""",
)
def _(spark, d):
    out = graph.scored_components(connected_components(knn(spark, d)), loose(spark, d), upper(spark, d))
    return out.select("component", "n_nodes", "n_unique_genes", "purity", "conflict", "signal_strength", "relative_purity", "relative_conflict").withColumns(r9("purity", "conflict", "signal_strength") | r6("relative_purity", "relative_conflict"))


@query("component_purity", f"WITH RECURSIVE {COMPONENT_SUMS} SELECT e AS component, n_nodes, k AS n_unique_genes, round(coalesce(n_pos / nullif(kk, 0), 0), 9) AS purity, round(coalesce(sum_neg / nullif(kk, 0), 0), 9) AS conflict FROM s JOIN nn USING (e) WHERE n_nodes >= 2")
def _(spark, d):
    out = graph.scored_components(connected_components(knn(spark, d)), loose(spark, d), upper(spark, d), use_relu=False, min_size=2)
    return out.select("component", "n_nodes", "n_unique_genes", "purity", "conflict").withColumns(r9("purity", "conflict"))


@query(
    "unassigned_components",
    f"""WITH RECURSIVE {NPMI}, {KNN}, {CC}, sz AS (SELECT component, count(*) AS n, row_number() OVER (ORDER BY component) - 1 AS i FROM cc GROUP BY 1),
lc AS (SELECT node, 'UNASSIGNED_' || i AS id, n, feature_name FROM cc JOIN sz USING (component) JOIN mol ON transcript_id = node), eg AS (SELECT DISTINCT id AS e, feature_name AS g FROM lc WHERE n >= 5), {PASS1},
q AS (SELECT lc.*, CASE WHEN n < 5 THEN 'drop_small_comp' WHEN gone.g IS NOT NULL THEN 'drop_npmi_pruned_gene' ELSE 'keep_unassigned_comp' END AS s FROM lc LEFT JOIN gone ON gone.e = lc.id AND gone.g = lc.feature_name)
SELECT transcript_id, q.id AS unassigned_comp_id, s AS unassigned_qc_status, CAST(n AS DOUBLE) AS unassigned_comp_size, CASE WHEN s IS NULL THEN cell_id WHEN s = 'keep_unassigned_comp' THEN q.id ELSE 'DROP' END AS cell_id_final FROM mol LEFT JOIN q ON node = transcript_id""",
)
def _(spark, d):
    out = graph.unassigned_components(mol(spark, d), upper(spark, d), "cell_id", k=8, radius=10.0, min_size=5, threshold=THRESHOLD)
    return out.select("transcript_id", "unassigned_comp_id", "unassigned_qc_status", "unassigned_comp_size", "cell_id_final")


# Geometry

ENTITY = "en AS (SELECT cell_id AS entity_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, list_sort(list(DISTINCT feature_name)) AS genes FROM mol WHERE cell_id <> '-1' GROUP BY 1)"


@query("entity_table", f"WITH {MOL}, {ENTITY} SELECT entity_id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, array_to_string(genes, ',') AS genes, 'cell' AS etype FROM en")
def _(spark, d):
    return stitch.entity_table(mol(spark, d), "cell_id").withColumn("genes", F.array_join("genes", ",")).withColumns(r9("x", "y", "z"))


def _suppliers(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    return s.withColumns({"x": (F.col("id") * 7919 % 1009).cast("double"), "y": ((F.col("id") * F.col("id") * 31 + F.col("id") * 17) % 1013).cast("double")})


@query(
    "delaunay_2d",
    """WITH p AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST((s_suppkey * 7919) % 1009 AS DOUBLE) AS x, CAST((s_suppkey * s_suppkey * 31 + s_suppkey * 17) % 1013 AS DOUBLE) AS y FROM supplier),
t AS (SELECT a.id AS a, b.id AS b, c.id AS c, (a.x - c.x) AS ax, (a.y - c.y) AS ay, (b.x - c.x) AS bx, (b.y - c.y) AS byy, c.x AS cx, c.y AS cy FROM p a JOIN p b ON a.id < b.id JOIN p c ON b.id < c.id),
o AS (SELECT *, ax * byy - bx * ay AS det FROM t WHERE abs(ax * byy - bx * ay) > 0),
u AS (SELECT *, cx + (byy * (ax * ax + ay * ay) - ay * (bx * bx + byy * byy)) / (2 * det) AS ux, cy + (ax * (bx * bx + byy * byy) - bx * (ax * ax + ay * ay)) / (2 * det) AS uy FROM o),
r AS (SELECT *, (ux - cx) * (ux - cx) + (uy - cy) * (uy - cy) AS rr FROM u), k AS (SELECT a, b, c FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE (p.x - ux) * (p.x - ux) + (p.y - uy) * (p.y - uy) < rr * (1 - 1e-9))),
e AS (SELECT a AS src, b AS dst FROM k UNION SELECT b, c FROM k UNION SELECT a, c FROM k) SELECT src, dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS length FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst""",
)
def _(spark, d):
    return geometry.delaunay_edges(_suppliers(spark, d), "id", ("x", "y")).withColumns(r9("length"))


@query(
    "delaunay_3d",
    """WITH v AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
n AS (SELECT label, count(*) AS n FROM v GROUP BY 1 HAVING count(*) > 3), p AS (SELECT label, x, y, z, min(id) AS id FROM v JOIN n USING (label) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY ALL),
t AS (SELECT a.label, a.id AS a, b.id AS b, c.id AS c, d.id AS d, a.x - d.x AS ax, a.y - d.y AS ay, a.z - d.z AS az, b.x - d.x AS bx, b.y - d.y AS byy, b.z - d.z AS bz, c.x - d.x AS cx, c.y - d.y AS cy, c.z - d.z AS cz, d.x AS dx, d.y AS dy, d.z AS dz
  FROM p a JOIN p b ON a.label = b.label AND a.id < b.id JOIN p c ON b.label = c.label AND b.id < c.id JOIN p d ON c.label = d.label AND c.id < d.id),
o AS (SELECT *, ax * (byy * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - byy * cx) AS det, (ax * ax + ay * ay + az * az) / 2 AS qa, (bx * bx + byy * byy + bz * bz) / 2 AS qb, (cx * cx + cy * cy + cz * cz) / 2 AS qc FROM t),
u AS (SELECT *, (qa * (byy * cz - bz * cy) - ay * (qb * cz - bz * qc) + az * (qb * cy - byy * qc)) / det AS ux, (ax * (qb * cz - bz * qc) - qa * (bx * cz - bz * cx) + az * (bx * qc - qb * cx)) / det AS uy,
  (ax * (byy * qc - qb * cy) - ay * (bx * qc - qb * cx) + qa * (bx * cy - byy * cx)) / det AS uz FROM o WHERE det <> 0),
k AS (SELECT label, a, b, c, d FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.label = u.label AND (p.x - dx - ux) * (p.x - dx - ux) + (p.y - dy - uy) * (p.y - dy - uy) + (p.z - dz - uz) * (p.z - dz - uz) < (ux * ux + uy * uy + uz * uz) * (1 - 1e-9))),
e AS (SELECT a AS src, b AS dst FROM k UNION SELECT a, c FROM k UNION SELECT a, d FROM k UNION SELECT b, c FROM k UNION SELECT b, d FROM k UNION SELECT c, d FROM k
  UNION SELECT p.id, v.id FROM v JOIN p ON v.label = p.label AND v.x = p.x AND v.y = p.y AND v.z = p.z WHERE v.id <> p.id)
SELECT src, dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS length FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst""",
)
def _(spark, d):
    return geometry.delaunay_edges(_points(spark, d).filter("label is not null"), "id", group="label").withColumns(r9("length"))


def _cells(spark, d):
    return mol(spark, d).groupBy("cell_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("library_size")).filter("cell_id <> '-1'")


@query("cell_centroids", f"WITH {MOL} SELECT cell_id, round(avg(x), 9) AS x, round(avg(y), 9) AS y, count(*) AS library_size FROM mol WHERE cell_id <> '-1' GROUP BY 1")
def _(spark, d):
    return _cells(spark, d).withColumns(r9("x", "y"))


@query("spatial_partition")
def _(spark, d):
    return geometry.bisect(_cells(spark, d), 8).select("cell_id", "partition")


@query("partition_hulls")
def _(spark, d):
    return geometry.hulls(geometry.bisect(_cells(spark, d), 8)).select("partition", F.size("ring").alias("corners"), "cx", "cy")


CHUNKS = f"""WITH {MOL}, c AS (SELECT cell_id, avg(x) AS x, avg(y) AS y FROM mol WHERE cell_id <> '-1' GROUP BY 1), pc AS (SELECT cell_id, x, y, CASE WHEN x > 50 THEN 1 ELSE 0 END + CASE WHEN y > 250 THEN 2 ELSE 0 END AS p FROM c),
ed AS (SELECT a.p, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM pc a JOIN pc b ON a.p = b.p AND a.cell_id <> b.cell_id WHERE NOT EXISTS (SELECT 1 FROM pc q WHERE q.p = a.p AND q.cell_id NOT IN (a.cell_id, b.cell_id) AND (b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) <= 0)),
hu AS (SELECT p, sum((ax + bx) * (ax * byy - bx * ay)) / (3 * sum(ax * byy - bx * ay)) AS cx, sum((ay + byy) * (ax * byy - bx * ay)) / (3 * sum(ax * byy - bx * ay)) AS cy, count(*) AS corners FROM ed GROUP BY p HAVING count(*) >= 3),
st AS (SELECT * FROM mol WHERE cell_id = '-1'),
wi AS (SELECT transcript_id, min(hu.p) AS p FROM st, hu WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.p = hu.p AND (bx - ax) * (st.y - ay) - (byy - ay) * (st.x - ax) <= 0) GROUP BY 1),
nc AS (SELECT transcript_id, arg_min(hu.p, ((cx - st.x) * (cx - st.x) + (cy - st.y) * (cy - st.y), hu.p)) AS p FROM st, hu GROUP BY 1),
ch AS (SELECT mol.transcript_id, mol.cell_id, coalesce(pc.p, wi.p, nc.p) AS "partition" FROM mol LEFT JOIN pc USING (cell_id) LEFT JOIN wi USING (transcript_id) LEFT JOIN nc USING (transcript_id))"""


def _quarters(spark, d):
    """Cells by quarter of the plane: partitions that SQL can name."""
    return checkpoint(_cells(spark, d).withColumn("partition", (F.col("x") > 50).cast("int") + 2 * (F.col("y") > 250).cast("int")))


def _chunks(spark, d):
    parts = _quarters(spark, d)
    return partition.chunk(mol(spark, d), parts, geometry.hulls(parts))


@query("chunked_molecules", f'{CHUNKS} SELECT transcript_id, "partition" FROM ch')
def _(spark, d):
    return _chunks(spark, d).select("transcript_id", "partition")


@query("chunk_summary", f'{CHUNKS} SELECT "partition", count(*) AS n_transcripts, count(DISTINCT cell_id) AS n_cells FROM ch GROUP BY 1')
def _(spark, d):
    return partition.chunk_summary(_chunks(spark, d))


@query("graph_partition", "SELECT true AS balanced, true AS no_worse, count(DISTINCT user_id) AS n FROM events WHERE event_id % 10 <> 0")
def _(spark, d):
    """Whether partitions on the neighbour graph are within a tenth of their mean size (or one cell) and cut no more edges than bisection alone."""
    out, cut, first = partition.partition_cells(_cells(spark, d), 4, 5, slack=0.1)
    sizes = out.groupBy("partition").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    mean = F.col("n") / 4
    return sizes.select(((F.col("most") <= mean * 1.1 + 1) & (F.col("least") >= mean * 0.9 - 1) & (F.col("parts") == 4)).alias("balanced"), F.lit(cut <= first).alias("no_worse"), "n")


@query("unbounded_knn", f"""WITH {MOL}, c AS (SELECT cell_id, avg(x) AS x, avg(y) AS y FROM mol WHERE cell_id <> '-1' GROUP BY 1)
SELECT a.cell_id AS src, b.cell_id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS length FROM c a JOIN c b ON a.cell_id <> b.cell_id
QUALIFY row_number() OVER (PARTITION BY a.cell_id ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6), b.cell_id) <= 6""")
def _(spark, d):
    return partition.knn(_cells(spark, d), 6).withColumns(r6("length"))


@query("point_in_hull", f"WITH {MOL} SELECT transcript_id, x > 10 AND x < 40 AND y > 100 AND y < 300 AND x + y / 10 < 60 AS within FROM mol")
def _(spark, d):
    corners = [(10.0, 100.0), (40.0, 100.0), (40.0, 200.0), (30.0, 300.0), (10.0, 300.0)]
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in corners])
    return mol(spark, d).select("transcript_id", geometry.inside_hull(F.col("x"), F.col("y"), ring).alias("within"))


@query("partition_edge_cut", f"WITH {MOL}, {KNN} SELECT count(*) FILTER (src % 4 <> dst % 4) AS edge_cut FROM ue")
def _(spark, d):
    parts = loose(spark, d).select("transcript_id", (F.col("transcript_id") % 4).alias("partition"))
    return geometry.edge_cut(graph.undirected(knn(spark, d)), parts, "transcript_id")


@query("cell_polygons", "WITH v AS (SELECT o_custkey AS cell_id, o_orderkey AS seq, o_totalprice AS x FROM orders) SELECT cell_id, count(*) AS corners, round(arg_min(x, seq), 9) AS first_x FROM v GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("cell_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("vertex_x"), F.col("o_totalprice").alias("vertex_y"))
    return tables.polygons(o).select("cell_id", F.size("ring").cast("long").alias("corners"), F.round(F.get("ring", F.lit(0))["x"], 9).alias("first_x"))


# Merging, splitting, reassignment

NEAR_CELLS = f"{ENTITY}, ce AS (SELECT a.entity_id AS src, b.entity_id AS dst FROM en a JOIN en b ON a.entity_id < b.entity_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 4)"


def _near_cells(spark, d):
    e = checkpoint(stitch.entity_table(mol(spark, d), "cell_id"))
    met = near.pairs_within(e.select(F.col("entity_id").alias("b"), "x", "y", "z"), 4.0, graph.XYZ)
    return e, met.select(F.col("a").alias("src"), F.col("b").alias("dst"))


GAINS = f"""{NEAR_CELLS}, eg AS (SELECT entity_id AS e, unnest(genes) AS g FROM en UNION SELECT DISTINCT src || '|' || dst, g FROM (SELECT src, dst, unnest(genes) AS g FROM ce JOIN en ON entity_id IN (src, dst))), {SUMS},
c AS (SELECT e, k, coalesce(rp / nullif(n_seen, 0), 0) - coalesce(rn / nullif(n_seen, 0), 0) AS c FROM s),
dc AS (SELECT src, dst, round(u.c - 1.0 / (a.k + b.k) - greatest(a.c - 1.0 / a.k, b.c - 1.0 / b.k), 9) AS delta_c FROM ce JOIN c u ON u.e = src || '|' || dst JOIN c a ON a.e = src JOIN c b ON b.e = dst)"""


@query("delta_c_edges", f"WITH {NPMI}, {GAINS} SELECT src, dst, delta_c FROM dc")
def _(spark, d):
    e, edges = _near_cells(spark, d)
    return stitch.gains(edges, e, upper(spark, d)).withColumns(r9("delta_c"))


@query(
    "presence_gains",
    f"""WITH {NPMI}, {GAINS}, pc AS (SELECT e, k, coalesce(n_pos / nullif(kk, 0), 0) AS pu, coalesce(sum_neg / nullif(kk, 0), 0) AS own, coalesce(sum_neg / nullif(n_neg, 0), 0) AS mean FROM s)
SELECT src, dst, CASE WHEN a.k = 1 AND b.k = 1 THEN CAST('-inf' AS DOUBLE) ELSE round(u.pu - u.mean - 1.0 / (a.k + b.k) - greatest(a.pu - a.own - 1.0 / a.k, b.pu - b.own - 1.0 / b.k), 9) END AS delta_c FROM ce JOIN pc u ON u.e = src || '|' || dst JOIN pc a ON a.e = src JOIN pc b ON b.e = dst""",
)
def _(spark, d):
    e, edges = _near_cells(spark, d)
    return stitch.gains_of_presence(edges, e, upper(spark, d)).withColumns(r9("delta_c"))


@query(
    "stitch_one_shot",
    f"""WITH RECURSIVE {NPMI}, {GAINS}, good AS (SELECT src AS a, dst AS b, delta_c FROM dc WHERE delta_c >= 0 UNION ALL SELECT dst, src, delta_c FROM dc WHERE delta_c >= 0),
rc(node, reach) AS (SELECT entity_id, entity_id FROM en UNION SELECT rc.node, good.b FROM rc JOIN good ON rc.reach = good.a)
SELECT entity_id, (SELECT max(delta_c) FROM good WHERE a = entity_id) AS deltaC_max, min(reach) AS stitched_cc_id FROM rc JOIN en ON node = entity_id GROUP BY entity_id""",
)
def _(spark, d):
    e, edges = _near_cells(spark, d)
    gained = stitch.gains(edges, e, upper(spark, d)).withColumns(r9("delta_c"))
    return stitch.stitch_once(e.select("entity_id"), gained, "entity_id").withColumns(r9("deltaC_max"))


def _parts(spark, d):
    w = upper(spark, d)
    return checkpoint(prune.prune_molecules(mol(spark, d), w).filter(~labels.is_unassigned(F.col("cell_id_npmi_cons_p2")))), w


@query("stitch_hierarchical")
def _(spark, d):
    m, w = _parts(spark, d)
    return stitch.stitch(stitch.entity_table(m, "cell_id_npmi_cons_p2"), w, radius=5.0)


@query("stitch_invariant", "SELECT 0 AS n")
def _(spark, d):
    """No stitched entity holds two cells."""
    m, w = _parts(spark, d)
    e = checkpoint(stitch.entity_table(m, "cell_id_npmi_cons_p2"))
    out = stitch.stitch(e, w, radius=5.0).join(e.select("entity_id", "etype"), "entity_id")
    two = out.filter("etype = 'cell'").groupBy("stitched").count().filter("count > 1")
    return two.agg(F.count("*").cast("int").alias("n"))


SPLIT = """sk AS (SELECT a.transcript_id AS s, b.transcript_id AS d, a.cell_id AS la, b.cell_id AS lb FROM mol a JOIN mol b ON a.transcript_id <> b.transcript_id AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 AND abs(a.z - b.z) <= 6
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 6 QUALIFY row_number() OVER (PARTITION BY a.transcript_id ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6), b.transcript_id) <= 20),
se AS (SELECT s, d FROM sk WHERE la = lb UNION SELECT d, s FROM sk WHERE la = lb),
rs(node, reach) AS (SELECT transcript_id, transcript_id FROM mol UNION SELECT rs.node, se.d FROM rs JOIN se ON rs.reach = se.s),
sc AS (SELECT node, min(reach) AS c FROM rs GROUP BY node), ss AS (SELECT cell_id, c, count(*) AS n FROM sc JOIN mol ON node = transcript_id GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, c) AS r FROM ss)"""


@query("spatial_split", f"WITH RECURSIVE {MOL}, {SPLIT} SELECT transcript_id, CASE WHEN r > 1 THEN mol.cell_id || '-' || r ELSE mol.cell_id END AS cell_id_spatial FROM mol JOIN sc ON node = transcript_id JOIN sr ON sr.cell_id = mol.cell_id AND sr.c = sc.c")
def _(spark, d):
    return refine.split(mol(spark, d), "cell_id", k=20, radius=6.0).select("transcript_id", "cell_id_spatial")


NEAREST = f"{ENTITY}, ne AS (SELECT m.transcript_id, arg_min(en.entity_id, (sqrt((m.x - en.x) * (m.x - en.x) + (m.y - en.y) * (m.y - en.y) + (m.z - en.z) * (m.z - en.z)), en.entity_id)) AS entity_id, min(sqrt((m.x - en.x) * (m.x - en.x) + (m.y - en.y) * (m.y - en.y) + (m.z - en.z) * (m.z - en.z))) AS distance FROM mol m JOIN en ON true WHERE m.cell_id = '-1' AND sqrt((m.x - en.x) * (m.x - en.x) + (m.y - en.y) * (m.y - en.y) + (m.z - en.z) * (m.z - en.z)) <= 40 GROUP BY 1)"


@query("nearest_entity", f"WITH {MOL}, {NEAREST} SELECT transcript_id, entity_id, round(distance, 9) AS distance FROM ne")
def _(spark, d):
    return refine.nearest(loose(spark, d), stitch.entity_table(mol(spark, d), "cell_id"), 40.0).withColumns(r9("distance"))


@query("reassign", f"WITH {MOL}, {NEAREST} SELECT m.transcript_id, coalesce(ne.entity_id, m.cell_id) AS cell_id_finetuned_2 FROM mol m LEFT JOIN ne ON ne.transcript_id = m.transcript_id")
def _(spark, d):
    m = mol(spark, d)
    return refine.reassign(m, stitch.entity_table(m, "cell_id"), "cell_id", radius=40.0, only_partial_component=False).select("transcript_id", "cell_id_finetuned_2")


@query("reassignment_stats", f"WITH {MOL}, {NEAREST} SELECT (SELECT count(*) FROM mol WHERE cell_id = '-1') AS n_unassigned, count(*) AS n_reassigned, round(avg(distance), 9) AS mean_distance, round(max(distance), 9) AS max_distance FROM ne")
def _(spark, d):
    l = loose(spark, d)  # noqa: E741
    return refine.reassignment_stats(refine.nearest(l, stitch.entity_table(mol(spark, d), "cell_id"), 40.0), l).withColumns(r9("mean_distance", "max_distance"))


@query("pipeline_6stage")
def _(spark, d):
    s = pipeline.Settings(component_size=5, component_radius=10.0, component_prune=-0.1, stitch_radius=5.0, split_radius=6.0, reassign_radius=10.0)
    return pipeline.refine_labels(mol(spark, d), checkpoint(upper(spark, d)), s).select("transcript_id", *pipeline.STAGES)


@query("pipeline_invariants", f"WITH {MOL} SELECT count(*) AS n, 0 AS relabelled_drops FROM mol")
def _(spark, d):
    """Every molecule is still there, and stitching relabels no dropped one."""
    s = pipeline.Settings(component_size=5, component_radius=10.0, component_prune=-0.1, stitch_radius=5.0, split_radius=6.0, reassign_radius=None)
    out = pipeline.refine_labels(mol(spark, d), checkpoint(upper(spark, d)), s)
    return out.agg(F.count_distinct("transcript_id").alias("n"), F.count_if((F.col("cell_id_final") == "DROP") & (F.col("cell_id_finetuned") != "DROP")).cast("int").alias("relabelled_drops"))


# Reports and scalars


@query("fdr_bh", "WITH p AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ((event_id * 7919) % 10007) / 10007.0 END AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM p WHERE p IS NOT NULL) SELECT id, round(least(1, min(CAST(p AS DOUBLE) * m / k) OVER (ORDER BY k DESC)), 9) AS q FROM r UNION ALL SELECT id, NULL FROM p WHERE p IS NULL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 50 != 0, (F.col("event_id") * 7919 % 10007) / 10007.0).cast("double").alias("p"))
    return stats.benjamini_hochberg(e).select("id", F.round("q", 9).alias("q"))


@query("interaction_counts", "SELECT event_type AS sender, CAST(user_id % 5 AS BIGINT) AS receiver, count(*) AS n FROM events WHERE value < 20 GROUP BY ALL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("sender"), (F.col("user_id") % 5).alias("receiver"), F.col("value").alias("p"))
    return report.interaction_counts(e, alpha=20)


@query("scalar_functions", f"WITH {MOL} SELECT transcript_id, round(CASE WHEN v > 3 THEN v - 3 WHEN v < -3 THEN v + 3 ELSE 0 END, 9) AS relu, try_cast(feature_name AS DOUBLE) AS number, CASE WHEN isfinite(v) THEN round(v, 9) END AS finite FROM (SELECT *, x - 50 AS v FROM mol)")
def _(spark, d):
    v = F.col("x") - 50
    return mol(spark, d).select("transcript_id", F.round(relu_symmetric(v, 3.0), 9).alias("relu"), to_number(F.col("feature_name")).alias("number"), F.round(to_number(v), 9).alias("finite"))


@query("noise_pairs", f"WITH {NPMI} SELECT gene_i, gene_j, npmi FROM up WHERE npmi > -0.1 AND npmi < -0.05")
def _(spark, d):
    return upper(spark, d).filter("npmi > -0.1 and npmi < -0.05")


@query("bottom_pairs", f"WITH {NPMI} SELECT gene_i, gene_j, npmi, row_number() OVER (ORDER BY npmi, gene_i, gene_j) AS place FROM up QUALIFY place <= 10")
def _(spark, d):
    return stats.extremes(upper(spark, d), 10, "npmi", largest=False)


@query("noise_partners", f"WITH {NPMI}, w AS (SELECT gene_i, gene_j FROM up WHERE npmi > -0.1 AND npmi < -0.02 AND (gene_i IN ('click_1', 'view_2') OR gene_j IN ('click_1', 'view_2'))) SELECT DISTINCT gene FROM (SELECT gene_i AS gene FROM w UNION ALL SELECT gene_j FROM w) WHERE gene NOT IN ('click_1', 'view_2')")
def _(spark, d):
    return stats.noise_partners(upper(spark, d), ["click_1", "view_2"], -0.1, -0.02)


@query("cluster_filter", f"WITH {MOL}, k AS (SELECT transcript_id, feature_name AS cluster FROM mol WHERE NOT contains(feature_name, '_1')) SELECT transcript_id, cluster FROM k WHERE cluster IN (SELECT cluster FROM k GROUP BY 1 HAVING count(*) >= 20)")
def _(spark, d):
    rows = mol(spark, d).select("transcript_id", F.col("feature_name").alias("cluster"))
    bad = [r["cluster"] for r in rows.filter(F.col("cluster").contains("_1")).select("cluster").distinct().collect()]  # of the panel's features
    return report.clusters(rows, "cluster", bad, 20)


@query("annotations", "SELECT c_custkey AS cell_id, n_name AS supervised, r_name AS unsupervised FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 4) ON n_nationkey = c_custkey LEFT JOIN region ON r_regionkey = c_custkey")
def _(spark, d):
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    one = read("nation").filter("n_nationkey > 4").select(F.col("n_nationkey").alias("barcode"), F.col("n_name").alias("supervised"))
    two = read("region").select(F.col("r_regionkey").alias("barcode"), F.col("r_name").alias("unsupervised"))
    return report.annotate(read("customer").select(F.col("c_custkey").alias("cell_id")), one, two)


def _interactions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("sender"), (F.col("user_id") % 5).alias("receiver"), F.col("value").alias("p"))
    return report.interaction_counts(e, alpha=20)


@query("interaction_sums", """WITH e AS (SELECT event_type AS s, CAST(user_id % 5 AS VARCHAR) AS r FROM events WHERE value < 20) SELECT "group", CAST(sum(o) AS BIGINT) AS outbound, CAST(sum(i) AS BIGINT) AS inbound FROM (SELECT s AS "group", 1 AS o, 0 AS i FROM e UNION ALL SELECT r, 0, 1 FROM e) GROUP BY 1""")
def _(spark, d):
    return report.interaction_sums(_interactions(spark, d))


@query("interaction_matrix", "SELECT event_type AS sender, " + ", ".join(f'count(*) FILTER (user_id % 5 = {k}) AS "{k}"' for k in range(5)) + " FROM events WHERE value < 20 GROUP BY 1")
def _(spark, d):
    return report.interaction_matrix(_interactions(spark, d))


@query("value_frequencies", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def _(spark, d):
    return report.frequencies(spark.read.parquet(f"{d}/events.parquet"), "event_type")


@query("value_spread", "SELECT event_type, max(value) AS largest, round(quantile_cont(value, 0.99), 6) AS percentile FROM events GROUP BY 1")
def _(spark, d):
    return report.spread(spark.read.parquet(f"{d}/events.parquet"), "value", 0.99, ["event_type"]).withColumns(r6("percentile"))


def _samples(spark, d):
    rows = mol(spark, d).withColumn("sample", F.concat(F.lit("s"), (F.col("transcript_id") % 3).cast("string")))
    return rows, rows.filter(~F.col("feature_name").endswith("_3")).select("sample", "feature_name").distinct()


@query("sample_quality", f"""WITH {MOL}, m AS (SELECT *, 's' || (transcript_id % 3) AS sample FROM mol), p AS (SELECT DISTINCT sample, feature_name FROM m WHERE NOT ends_with(feature_name, '_3'))
SELECT m.sample, (SELECT count(*) FROM p WHERE p.sample = m.sample) AS n_genes, count(DISTINCT cell_id) FILTER (cell_id <> '-1') AS n_cells, count(*) AS total_transcripts, count(*) FILTER (x > 30 AND NOT ends_with(feature_name, '_3')) AS kept_transcripts,
(SELECT count(*) > 0 FROM p WHERE p.sample = m.sample AND feature_name = 'click_1') AS click_1_present, (SELECT count(*) > 0 FROM p WHERE p.sample = m.sample AND feature_name = 'click_3') AS click_3_present FROM m GROUP BY m.sample""")
def _(spark, d):
    rows, panel = _samples(spark, d)
    return report.sample_quality(rows, panel, ["click_1", "click_3"], 30, "x")


@query(
    "nucleus_association",
    f"""WITH {MOL}, g AS (SELECT * FROM mol WHERE x > 20 AND NOT ends_with(feature_name, '_3') AND cell_id <> '-1' AND transcript_id % 3 <> 0), sz AS (SELECT cell_id, count(*) AS n FROM g GROUP BY 1), b AS (SELECT quantile_cont(n, 0.2) AS lo, quantile_cont(n, 0.8) AS hi FROM sz),
cg AS (SELECT DISTINCT cell_id AS c, feature_name AS g FROM g WHERE cell_id IN (SELECT cell_id FROM sz, b WHERE n BETWEEN lo AND hi)), t AS (SELECT count(DISTINCT c) AS tc FROM cg), o AS (SELECT g, count(*) AS n FROM cg GROUP BY 1),
two AS (SELECT a.g AS gene_i, b.g AS gene_j, count(*) AS n FROM cg a JOIN cg b ON a.c = b.c AND a.g < b.g GROUP BY ALL)
SELECT gene_i, gene_j, two.n AS count_ij, CASE WHEN two.n < tc THEN round(ln((two.n / tc) / ((i.n / tc) * (j.n / tc))) / -ln(two.n / tc), 9) END AS NPMI FROM two JOIN o i ON i.g = gene_i JOIN o j ON j.g = gene_j, t""",
)
def _(spark, d):
    rows = mol(spark, d).withColumn("overlaps_nucleus", (F.col("transcript_id") % 3 != 0).cast("int"))
    panel = rows.filter(~F.col("feature_name").endswith("_3")).select("feature_name").distinct()
    out = report.nucleus_association(rows, panel, 20, "x", exclude=("-1",), min_count=1, grid=False)
    return out.select("gene_i", "gene_j", "count_ij", F.round("NPMI", 9).alias("NPMI"))


@query("label_predicates", f"WITH {MOL} SELECT transcript_id, transcript_id % 7 IN (5, 6) AND cell_id <> '-1' AS whole, transcript_id % 7 IN (2, 3) OR (transcript_id % 7 IN (5, 6) AND false) AS part FROM mol")
def _(spark, d):
    label = F.col("label")
    return _labelled(spark, d).select("transcript_id", labels.is_whole_cell(label).alias("whole"), labels.is_partial_or_pseudocell(label).alias("part"))


@query("wkt_points", f"WITH {MOL} SELECT transcript_id, x, y FROM mol")
def _(spark, d):
    text = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    return mol(spark, d).select("transcript_id", text.alias("t")).select("transcript_id", *point_wkt(F.col("t")))
