import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import labels
from cellweave.operators import geometry, graph, prune, refine, report, scores, stats, stitch
from cellweave.operators.components import connected_components
from cellweave.plans import pipeline
from cellweave.sources import tables
from cellweave.streaming import cooccurrence

MOL = "transcript_id long, feature_name string, cell_id string, x double, y double, z double"


def random_molecules(spark, n=120, seed=0):
    r = random.Random(seed)
    rows = [(i, f"g{r.randrange(8)}", r.choice(["-1", "a", "b", "c"]), r.random() * 6, r.random() * 6, r.random() * 2) for i in range(n)]
    return spark.createDataFrame(rows, MOL), rows


def test_components_match_a_search(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    near = {}
    for a, b in edges[:150]:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            todo = [v]
            while todo:
                u = todo.pop()
                if u not in want:
                    want[u] = v
                    todo += near[u]
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 300).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    assert {x["component"] for x in connected_components(chain).collect()} == {0}


@pytest.mark.parametrize("k,radius", [(3, 1.0), (8, 0.7)])
def test_neighbours_match_brute_force(spark, k, radius):
    df, rows = random_molecules(spark)
    df = df.unionByName(spark.createDataFrame([(900, "g0", "a", None, 1.0, 1.0), (901, "g0", "a", *rows[0][3:])], MOL))
    rows = [*rows, (901, "g0", "a", *rows[0][3:])]
    got = {(e["src"], e["dst"]) for e in graph.radius_knn(df, k, radius).collect()}
    want = set()
    for a in rows:
        near = sorted((round(float(np.linalg.norm(np.subtract(a[3:], b[3:]))), 6), b[0]) for b in rows if b[0] != a[0] and np.linalg.norm(np.subtract(a[3:], b[3:])) <= radius)
        want |= {(a[0], b) for _, b in near[:k]}
    assert got == want


def test_greedy_by_hand():
    assert prune.greedy(["a", "a", "b"], ["b", "c", "c"]) == ["a", "b"]  # a tie goes to the first name
    assert prune.greedy([], []) == []
    assert prune.greedy(["h", "h", "h"], ["x", "y", "z"]) == ["h"]


def test_two_passes(spark):
    npmi = spark.createDataFrame([("a", "b", -0.5), ("a", "c", -0.5), ("b", "c", 0.4)], "gene_i string, gene_j string, npmi double")
    m = spark.createDataFrame([(1, "a", "X"), (2, "b", "X"), (3, "c", "X"), (4, "a", "-1"), (5, "b", None)], "transcript_id long, feature_name string, cell_id string")
    got = {r["transcript_id"]: (r["cell_id_npmi_cons_p1"], r["npmi_cons_p1_status"], r["cell_id_npmi_cons_p2"], r["npmi_cons_p2_status"]) for r in prune.prune_molecules(m, npmi).collect()}
    assert got == {1: ("X-1", "partial_p1", "X-1", "partial_p2"), 2: ("X", "core", "X", "unchanged"), 3: ("X", "core", "X", "unchanged"), 4: ("-1", "unassigned_input", "-1", "unchanged"), 5: (None, "unassigned_input", None, "unchanged")}


def test_npmi_by_hand(spark):
    rows = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("4", "c")]
    df = spark.createDataFrame(rows, "cell_id string, feature_name string")
    got = {(r["gene_i"], r["gene_j"]): r for r in stats.npmi(df, min_count=1).collect()}
    assert len(got) == 9
    ab = got["a", "b"]
    assert (ab["count_ij"], ab["P_ij"], ab["P_i_given_j"]) == (2, 0.5, 1.0)
    assert ab["PMI"] == pytest.approx(np.log(0.5 / (0.75 * 0.5)))
    assert ab["NPMI"] == pytest.approx(np.log(0.5 / 0.375) / -np.log(0.5))
    assert got["a", "c"]["NPMI"] is None
    neg = {(r["gene_i"], r["gene_j"]): r["NPMI"] for r in stats.npmi(df, min_count=1, set_neg_one=True).collect()}
    assert neg["a", "c"] == -1.0
    everywhere = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")], "cell_id string, feature_name string")
    assert all(r["NPMI"] is None for r in stats.npmi(everywhere, min_count=1).collect())  # P_ij = 1
    assert stats.npmi(df.limit(0), min_count=1).count() == 0


def test_scores_below_two_features(spark):
    sets = spark.createDataFrame([("one", ["a"]), ("none", []), ("two", ["a", "b"])], "entity string, genes array<string>")
    npmi = spark.createDataFrame([("a", "b", -0.2)], "gene_i string, gene_j string, npmi double")
    sums = scores.pair_sums(sets, npmi)
    cell = {r["entity"]: (r["purity"], r["conflict"]) for r in scores.cell_scores(sums).collect()}
    assert cell == {"one": (None, None), "none": (None, None), "two": (0.0, 0.2)}
    assert {r["entity"]: r["C"] for r in scores.coherence(sums).collect()} == {"one": 0.0, "none": 0.0, "two": -0.2}


@pytest.mark.parametrize("d,n", [(2, 30), (3, 12)])
def test_delaunay_matches_empty_spheres(d, n):
    for seed in range(4):
        p = np.random.default_rng(seed).random((n, d))
        want = set()
        for s in itertools.combinations(range(n), d + 1):
            v = p[list(s)]
            c = v[0] + np.linalg.solve(2 * (v[1:] - v[0]), ((v[1:] - v[0]) ** 2).sum(axis=1))
            if all(((p[k] - c) ** 2).sum() >= ((v[0] - c) ** 2).sum() for k in range(n) if k not in s):
                want |= set(itertools.combinations(s, 2))
        assert set(geometry.delaunay(p)) == want


def test_delaunay_in_the_plane_takes_every_point(spark):
    from cellweave.plans.queries import QUERIES

    p = np.random.default_rng(7).random((14, 2))
    df = spark.createDataFrame([(10 + i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    want = {}
    for s in itertools.combinations(range(len(p)), 3):
        a, b, c = p[list(s)]
        o = c + np.linalg.solve(2 * np.array([a - c, b - c]), [((a - c) ** 2).sum(), ((b - c) ** 2).sum()])
        if all(((p[k] - o) ** 2).sum() >= ((a - o) ** 2).sum() for k in range(len(p)) if k not in s):
            want |= {(10 + i, 10 + j): float(np.hypot(*(p[i] - p[j]))) for i, j in itertools.combinations(s, 2)}
    got = {(r["src"], r["dst"]): r["length"] for r in geometry.delaunay_edges(df, "id", ("x", "y")).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)

    sf = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()}
    edges = [(r["src"], r["dst"]) for r in QUERIES["delaunay_2d"](spark, sf).collect()]
    assert max(ids) > 60 and {i for e in edges for i in e} == ids
    assert 2 * len(ids) - 3 <= len(edges) <= 3 * len(ids) - 6


def test_delaunay_of_degenerate_points(spark):
    assert geometry.delaunay(np.array([[0.0, 0], [2, 2], [1, 1], [1, 1]])) == [(0, 2), (1, 2), (2, 3)]
    flat = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [3, 3, 0]])
    assert set(geometry.delaunay(flat)) >= {(0, 1), (0, 2), (1, 2)}
    assert geometry.delaunay_edges(spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id long, x double, y double"), "id", ("x", "y")).count() == 0
    with pytest.raises(ValueError):
        geometry.simplex_edges(np.zeros(3))


def test_hull_holds_its_points(spark):
    p = np.random.default_rng(3).random((60, 2))
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in p], "partition int, x double, y double")
    h = geometry.hulls(df)
    ring = np.array([(c["x"], c["y"]) for c in h.first()["ring"]])
    assert np.array_equal(ring, geometry.convex_hull(p))
    inner = df.crossJoin(h.select("ring")).filter(geometry.inside_hull(F.col("x"), F.col("y"), F.col("ring"))).count()
    assert inner == len(p) - len(ring)


def test_partitions_are_balanced(spark):
    r = np.random.default_rng(4).random((400, 2))
    df = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(r)], "cell_id string, x double, y double")
    n = [x["count"] for x in geometry.bisect(df, 6).groupBy("partition").count().collect()]
    assert len(n) == 6 and sum(n) == 400 and max(n) <= 1.3 * 400 / 6


def merged(names, kinds, genes, edges, w):
    return stitch.agglomerate(names, kinds, genes, edges, w, 0.0, 0.05, True, True)


def test_cells_never_merge_and_components_are_independent():
    rng = np.random.default_rng(5)
    for seed in range(20):
        r = random.Random(seed)
        n, g = 24, 10
        w = rng.uniform(-0.4, 0.4, (g, g))
        w = np.round((w + w.T) / 2, 1)
        names, kinds = [f"e{i:02}" for i in range(n)], [r.choice(["cell", "partial", "component"]) for _ in range(n)]
        genes = [np.array(sorted(r.sample(range(g), r.randrange(1, 6)))) for _ in range(n)]
        edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(40)})
        whole = merged(names, kinds, genes, edges, w)
        by = {}
        for name, kind, label in zip(names, kinds, whole, strict=True):
            by.setdefault(label, []).append(kind)
        assert all(k.count("cell") <= 1 for k in by.values())
        edges = [(a, b) for a, b in edges if not (kinds[a] == kinds[b] == "cell")]
        group = list(range(n))
        for _ in range(n):
            for a, b in edges:
                group[a] = group[b] = min(group[a], group[b])
        apart = [None] * n
        for c in set(group):
            at = [i for i in range(n) if group[i] == c]
            own = [(at.index(a), at.index(b)) for a, b in edges if group[a] == c]
            for i, label in zip(at, merged([names[i] for i in at], [kinds[i] for i in at], [genes[i] for i in at], own, w), strict=True):
                apart[i] = label
        assert apart == whole


def test_gain_is_the_same_in_spark(spark):
    npmi = [("a", "b", 0.3), ("a", "c", -0.2), ("b", "c", 0.1), ("c", "d", -0.4)]
    panel = stitch.Panel([dict(zip(("gene_i", "gene_j", "npmi"), r, strict=True)) for r in npmi])
    ent = spark.createDataFrame([("p", ["a", "b"]), ("q", ["c"]), ("r", ["c", "d"])], "entity_id string, genes array<string>")
    edges = spark.createDataFrame([("p", "q"), ("p", "r"), ("q", "r")], "src string, dst string")
    w = spark.createDataFrame(npmi, "gene_i string, gene_j string, npmi double")
    genes = {r["entity_id"]: panel.numbers(r["genes"]) for r in ent.collect()}
    for relu in (True, False):
        for r in stitch.gains(edges, ent, w, use_relu=relu).collect():
            assert r["delta_c"] == pytest.approx(stitch.gain_of(genes[r["src"]], genes[r["dst"]], panel.matrix, 0.05, relu, True))


def test_split_and_reassign(spark):
    rows = [(1, "g", "A", 0.0, 0.0, 0.0), (2, "g", "A", 0.5, 0.0, 0.0), (3, "g", "A", 9.0, 0.0, 0.0), (4, "g", "DROP", 9.2, 0.0, 0.0), (5, "g", "-1", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, MOL)
    got = {r["transcript_id"]: r["cell_id_spatial"] for r in refine.split(df, "cell_id", k=5, radius=1.0).collect()}
    assert got == {1: "A", 2: "A", 3: "A-2", 4: "DROP", 5: "-1"}
    ent = spark.createDataFrame([("A-2", 9.0, 0.0, 0.0, "partial"), ("A", 9.2, 0.0, 0.0, "cell")], "entity_id string, x double, y double, z double, etype string")
    for only, want in ((True, "A-2"), (False, "A")):
        out = {r["transcript_id"]: r["o"] for r in refine.reassign(df, ent, "cell_id", "o", 1.0, only).collect()}
        assert out == {1: "A", 2: "A", 3: "A", 4: want, 5: "-1"}


def test_number_rows_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(100)], "k string").repartition(7)
    got = {r["k"]: r["n"] for r in tables.number_rows(df, ["k"], "n").collect()}
    assert got == {f"k{i:03}": i for i in range(100)}
    raw = spark.createDataFrame([(1, " g ", "84.0", "1.5", "x", 0.95)], "id long, gene string, cell string, x string, y string, nuclei_probs double")
    r = tables.normalise(raw, {"id": "transcript_id", "gene": "feature_name", "cell": "cell_id"}, 0.9).first()
    assert (r["feature_name"], r["cell_id"], r["x"], r["y"], r["z"], r["overlaps_nucleus"]) == ("g", "84", 1.5, None, 0.0, 1)
    with pytest.raises(ValueError):
        tables.normalise(raw)
    parts = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "partition int, cell_id string")
    summary = {r["partition"]: (r["n_transcripts"], r["n_cells"]) for r in tables.write_chunks(parts, str(tmp_path / "c")).collect()}
    assert summary == {0: (2, 2), 1: (1, 1)} and tables.read_parquet(spark, str(tmp_path / "c")).count() == 3
    tables.write_csv(parts, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "partition int, cell_id string").count() == 3


def test_kinds(spark):
    rows = [(None,), ("DROP",), ("UNASSIGNED_3",), ("7-1",), ("7",), ("-1",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "l string").select(labels.entity_kind(F.col("l")), labels.report_kind(F.col("l")), labels.is_unassigned(F.col("l"))).collect()]
    assert got == [("unknown", "unknown", True), ("drop", "drop", True), ("component", "pseudocell", False), ("partial", "partial_cell", False), ("cell", "whole_cell", False), ("partial", "drop", True)]


def test_pipeline_keeps_every_molecule(spark):
    df, rows = random_molecules(spark)
    w = spark.createDataFrame([("g0", "g1", -0.3), ("g1", "g2", 0.3), ("g0", "g2", 0.2), ("g3", "g4", -0.2)], "gene_i string, gene_j string, npmi double")
    s = pipeline.Settings(component_size=2, component_radius=1.0, stitch_radius=3.0, split_radius=1.0, reassign_radius=1.0)
    out = pipeline.refine_labels(df, w, s)
    again = pipeline.refine_labels(df.repartition(5), w, s)
    a = sorted(tuple(r) for r in out.select("transcript_id", *pipeline.STAGES).collect())
    assert len(a) == len(rows) and a == sorted(tuple(r) for r in again.select("transcript_id", *pipeline.STAGES).collect())
    counts = {r["stage"]: r for r in report.stage_counts(out, pipeline.STAGES).collect()}
    assert all(r["total"] == len(rows) for r in counts.values())
    empty = pipeline.refine_labels(df.limit(0), w, s)
    assert empty.count() == 0


def test_stream_gives_the_same_association(spark, tmp_path):
    df, _ = random_molecules(spark, 300)
    df.write.parquet(str(tmp_path / "in"))
    stream = cooccurrence.counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts_of_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = cooccurrence.npmi_of_counts(spark.table("counts_of_test"), min_count=1)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stats.npmi(df, min_count=1).collect()))
