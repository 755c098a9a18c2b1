import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from cellweave import skew, util
from cellweave.operators import delaunay, graph, partition, prune, report, scores, stats, stitch
from cellweave.operators.components import connected_components
from cellweave.sources import synthetic, tables

PAIRS = "gene_i string, gene_j string, npmi double"


def points(spark, p):
    d = p.shape[1]
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, " + ", ".join(f"{c} double" for c in "xyz"[:d]))


def tiled(spark, p):
    return {(r[0], r[1]) for r in delaunay.delaunay_edges(points(spark, p), "id", list("xyz"[: p.shape[1]])).select("src", "dst").collect()}


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(delaunay, "WHOLE", 100)
    monkeypatch.setattr(delaunay, "TILE", 80)


@pytest.mark.parametrize("kind", ["plane", "space", "clusters", "flat", "line", "twins"])
def test_tiles_make_the_whole_triangulation(spark, small_tiles, kind):
    rng = np.random.default_rng(4)
    p = {
        "plane": rng.random((600, 2)),
        "space": rng.random((500, 3)),
        "clusters": np.concatenate([c + 0.01 * rng.normal(size=(250, 2)) for c in rng.random((2, 2))]),
        "flat": np.column_stack([rng.random((400, 2)), np.full(400, 7.0)]),
        "line": np.outer(rng.permutation(300), [1.0, 2.0, 3.0]),
        "twins": np.repeat(rng.random((200, 2)), 2, axis=0),
    }[kind]
    assert tiled(spark, p) == set(delaunay.delaunay(p))


def test_tiles_of_layers(spark, small_tiles):
    """Points in layers lie on common spheres; all but a few edges are those of the whole."""
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.random((400, 2)) * 20, rng.integers(0, 4, 400)])
    got, want = tiled(spark, p), set(delaunay.delaunay(p))
    assert len(got ^ want) <= 0.02 * len(want)


def test_triangulation_of_a_lattice_covers_it():
    p = np.array([(x, y) for x in range(20) for y in range(20)], float)
    found = delaunay.simplices(p)
    assert np.abs(np.linalg.det(p[found[:, 1:]] - p[found[:, :1]])).sum() / 2 == pytest.approx(361, abs=0.1)


def test_large_groups_by_name(spark, small_tiles):
    rng = np.random.default_rng(6)
    p, q = rng.random((150, 2)), rng.random((40, 2))
    rows = [(i, *map(float, x), "a") for i, x in enumerate(p)] + [(1000 + i, *map(float, x), None) for i, x in enumerate(q)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = {(r[0], r[1]) for r in delaunay.delaunay_edges(df, "id", ("x", "y"), "g").select("src", "dst").collect()}
    assert got == set(delaunay.delaunay(p)) | {(1000 + a, 1000 + b) for a, b in delaunay.delaunay(q)}


# Partitions


def test_neighbours_without_a_radius(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random((60, 2)), rng.random((5, 2)) * 1000])
    df = points(spark, p).withColumnRenamed("id", "cell_id")
    got = {}
    for r in partition.knn(df, 4).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    far = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    assert got == {i: set(np.argsort(far[i])[:4].tolist()) for i in range(len(p))}
    alpha = partition.alpha_estimate(df, 4, 2.0, ("x", "y"), "cell_id").first()[0]
    assert alpha == pytest.approx(2 * np.median(np.sort(far, axis=1)[:, :4]))
    with pytest.raises(ValueError):
        partition.knn(df, len(p))


def test_partitions_follow_the_graph(spark):
    rng = np.random.default_rng(1)
    centres = rng.random((8, 2)) * 100
    df = points(spark, np.concatenate([c + rng.normal(size=(25, 2)) * 3 for c in centres])).withColumnRenamed("id", "cell_id")
    out, cut, first = partition.partition_cells(df, 4, 5, slack=0.2)
    sizes = [r["count"] for r in out.groupBy("partition").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 200 and max(sizes) <= 60 and min(sizes) >= 40 and cut <= first


def test_chunks_of_odd_molecules(spark):
    parts = spark.createDataFrame([("a", 0), ("b", 1)], "cell_id string, partition int")
    shapes = spark.createDataFrame([(0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 1.0, 1.0), (1, [(5.0, 0.0), (7.0, 0.0), (7.0, 2.0)], 6.3, 0.7)], "partition int, ring array<struct<x:double,y:double>>, cx double, cy double")
    rows = [(1, "a", 9.0, 9.0), (2, "-1", 1.0, 1.0), (3, "-1", 9.0, 1.0), (4, None, None, 1.0), (5, "c", 6.5, 0.5)]
    got = {r["transcript_id"]: r["partition"] for r in partition.chunk(spark.createDataFrame(rows, "transcript_id long, cell_id string, x double, y double"), parts, shapes).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: None, 5: 1}


# Scores, gates and hooks


def test_gates_default_to_the_upper_bounds(spark):
    edges = spark.createDataFrame([(1, 2, 0.1, "a", "b", 0.15, 0.05)], "src long, dst long, length double, gene_src string, gene_dst string, npmi double, cond_prob double")
    none = spark.createDataFrame([], "gene_i string, NPMI_thresh double, cond_prob_thresh double")
    assert graph.prune_edges(edges, none).first()["connect"] == 1


def test_features_off_the_panel_do_not_count(spark):
    w = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.4), ("b", "c", 0.3)], PAIRS)
    e = lambda extra: spark.createDataFrame([("p", ["a", "b", *extra]), ("q", ["c", *extra])], "entity_id string, genes array<string>")
    edge = spark.createDataFrame([("p", "q")], "src string, dst string")
    for f in (stitch.gains, stitch.gains_of_presence):
        assert f(edge, e([]), w).first()["delta_c"] == f(edge, e(["x1", "x2"]), w).first()["delta_c"]
    single = spark.createDataFrame([("p", ["a"]), ("q", ["b"])], "entity_id string, genes array<string>")
    assert stitch.gains_of_presence(edge, single, w).first()["delta_c"] == float("-inf")


def test_a_pruner_of_ones_own(spark):
    rows = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c1"), (3, "a", "-1")], "transcript_id long, feature_name string, cell_id string")
    w = spark.createDataFrame([("a", "b", 0.9)], PAIRS)
    drop_a = lambda sets, npmi, threshold: sets.select("entity", F.explode("genes").alias("gene")).filter("gene = 'a'")
    got = {r["transcript_id"]: r["cell_id_npmi_cons_p2"] for r in prune.prune_molecules(rows, w, pruner=drop_a).collect()}
    assert got == {1: "-1", 2: "c1", 3: "-1"}


def test_pairs_of_a_large_panel_are_shuffled(spark, monkeypatch):
    sets = spark.createDataFrame([("e", ["a", "b", "c"])], "entity string, genes array<string>")
    w = spark.createDataFrame([("a", "b", 0.5), ("b", "c", -0.5), ("a", "z", 0.1)], PAIRS)
    want = sorted(map(tuple, stats.with_values(sets, w).collect()))
    monkeypatch.setattr(stats, "FEW_PAIRS", 1)
    assert sorted(map(tuple, stats.with_values(sets, w).collect())) == want == [("e", "a", "b", 0.5), ("e", "b", "c", -0.5)]


def test_scores_are_attached(spark):
    cells = spark.createDataFrame([("c1", 1), ("c2", 2), (None, 3)], "cell_id string, n int")
    s = spark.createDataFrame([("c1", 0.5, True)], "entity string, purity double, pure boolean")
    got = {r["cell_id"]: (r["cell_purity"], r["n"]) for r in scores.attach(cells, s, columns={"purity": "cell_purity"}).collect()}
    assert got == {"c1": (0.5, 1), "c2": (None, 2), None: (None, 3)}


def test_component_report_is_in_order(spark):
    nodes = spark.createDataFrame([(i, g, "c", float(i), 0.0, 0.0) for i, g in enumerate("abcabzz")], "transcript_id long, feature_name string, cell_id string, x double, y double, z double")
    comps = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4)], "node long, component long")
    w = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.4)], PAIRS)
    out = graph.scored_components(comps, nodes, w, use_relu=False).collect()
    assert [r["component"] for r in out] == [4, 0, 2] and [r["n_unique_genes"] for r in out] == [1, 2, 2] and [r["purity"] for r in out] == [0.0, 1.0, 0.0]


# Reports


def test_clusters_and_annotations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("", 4), (None, 5), ("bad", 6), ("bad", 7)], "k string, cell_id long")
    assert {r["cell_id"] for r in report.clusters(df, "k", ["bad"], 2).collect()} == {1, 2}
    assert {r["cell_id"] for r in report.clusters(df, "k", least=1).collect()} == {1, 2, 3, 6, 7}
    side = spark.createDataFrame([("1", "x")], "barcode string, note string")
    assert {r["cell_id"]: r["note"] for r in report.annotate(df.select("cell_id"), side).collect()}[1] == "x"


def test_samples_are_the_same_rows_each_time(spark):
    a, b = ([r["id"] for r in report.sample(spark.range(1000).repartition(n), 20, "id", 3).collect()] for n in (2, 7))
    assert a == b and len(a) == 20 and a != [r["id"] for r in report.sample(spark.range(1000), 20, "id", 4).collect()]


# Sources


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    one = sorted(map(tuple, synthetic.molecules(spark, 200, seed=3).collect()))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert sorted(map(tuple, synthetic.molecules(spark, 200, seed=3).collect())) == one
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert one != sorted(map(tuple, synthetic.molecules(spark, 200, seed=4).collect()))
    x = np.array([r[3] for r in one])
    assert abs(x.mean()) < 30 and 70 < x.std() < 130 and {r[2] for r in one} <= {str(i) for i in range(40)}
    assert synthetic.pair_table(spark, 5).count() == 20 and stats.rankings(synthetic.pair_table(spark, 5)).count() == 20
    frag = synthetic.fragment(spark, ["a", "b", "c"], "f", (1, 2, 3), drop=5, seed=1)
    assert frag.select("feature_name").distinct().count() == 1 and frag.count() == 80
    assert synthetic.augmented(["a"], ["x", "y"], 5) in (["a", "x", "y"], ["a", "y", "x"])


def test_json_sink(spark, tmp_path):
    tables.write_json(spark.createDataFrame([("g", 1)], "gene string, n int"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).collect()[0]["gene"] == "g"


# Checkpoints


def test_superseded_checkpoints_are_deleted(spark):
    import os

    def files():
        top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return {d for d, _, _ in os.walk(top) if os.path.basename(d).startswith("rdd-")}

    util.ensure_checkpoint_dir(spark)
    old = files()
    df = util.checkpoint(spark.range(5).toDF("id"))
    assert len(files() - old) == 1
    util.release(df, spark.range(3).toDF("id"))
    assert files() == old
    found = connected_components(spark.range(1, 40).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")))
    assert found.count() == 40 and len(files() - old) == 1


def test_a_hot_key_has_salts(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("k"), "id")
    hot = skew.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 2000, 100)
    assert hot.count() == 2 and skew.dealt(rows, hot, "k", F.col("id")).select("k", "__salt").distinct().count() == 20


def test_queries_read_whole_tables(spark):
    from cellweave.plans.queries import QUERIES

    ids = {r[0] for c in ("src", "dst") for r in QUERIES["delaunay_2d"](spark, DATA).select(c).collect()}
    assert len(ids) == spark.read.parquet(f"{DATA}/supplier.parquet").count()


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    p = np.random.default_rng(2).random((300, 3)) * [1, 1, 3]
    df = points(spark, p).withColumnRenamed("id", "transcript_id")
    want = sorted(map(tuple, graph.radius_knn(df, 5, 0.8).collect()))
    monkeypatch.setattr(graph, "CROWD", 10)
    assert sorted(map(tuple, graph.radius_knn(df, 5, 0.8).collect())) == want and len(want) == 1500


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_adjusted_values_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "BLOCK", block)
    r = np.random.default_rng(3)
    p = [None if i % 11 == 0 else float(round(x, 2)) for i, x in enumerate(r.random(50) ** 2)] + [float("nan")]
    got = {x["id"]: x["q"] for x in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id long, p double")).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None and x == x)
    least = 1.0
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        least = min(least, x * len(known) / rank)
        assert got.pop(i) == pytest.approx(least)
    assert set(got.values()) == {None}
    assert stats.benjamini_hochberg(spark.createDataFrame([], "id long, p double")).count() == 0
