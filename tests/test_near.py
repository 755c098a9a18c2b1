"""Neighbours found tile by tile, held against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.operators import graph, near, refine, stitch

MOL = "transcript_id long, feature_name string, cell_id string, x double, y double, z double"


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(near, "TILE", 64)
    monkeypatch.setattr(near, "GUESTS", 40)


def crowd(seed, n, places=None):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 1, (n // 2, 3)), rng.uniform(-8, 8, (n - n // 2, 3))]).round(1)
    return p if places is None else p[rng.integers(0, places, n)]


def test_search_finds_all_up_to_the_kth():
    q, p = crowd(1, 300), crowd(2, 500)
    d = np.sqrt((((q[:, None] - p[None]) ** 2)[:, :, 0] + ((q[:, None] - p[None]) ** 2)[:, :, 1]) + ((q[:, None] - p[None]) ** 2)[:, :, 2])
    for k, radius in ((1, 2.0), (7, 1.5), (40, 30.0), (700, 3.0)):
        limit = np.minimum(np.sort(d, axis=1)[:, min(k, len(p)) - 1] if k <= len(p) else np.inf, radius)
        want = {(i, j) for i, j in zip(*np.nonzero(d <= (limit[:, None] if np.ndim(limit) else limit)), strict=True)}
        got = [(i, j) for batch in near.search(q, p, k, radius) for i, j in zip(batch[0], batch[1], strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_tiles_reach_all_within_the_radius():
    p = crowd(3, 400)
    cuts = near.Cuts(p, 16)
    home = dict(zip(*cuts.reached(p, 0.0), strict=True))
    assert len(home) == len(p) and len(set(home.values())) > 8
    reached = set(zip(*cuts.reached(p, 1.0), strict=True))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert all((j, home[i]) in reached for i, j in zip(*np.nonzero(d <= 1.0), strict=True))


def test_nearest_equals_all_pairs_and_keeps_ties(spark, small_tiles):
    q, p = crowd(4, 400, 150), crowd(5, 300, 120)
    mol = [(i, "g", "-1", *map(float, x)) for i, x in enumerate(q)] + [(1000, "g", "-1", None, 0.0, 0.0), (1001, "g", "-1", math.nan, 0.0, 0.0), (1002, "g", "-1", math.inf, 0.0, 0.0)]
    ent = [(f"e{i}", *map(float, x)) for i, x in enumerate(p)] + [("e", math.inf, 0.0, 0.0), ("f", None, 0.0, 0.0)]
    df, entities = spark.createDataFrame(mol, MOL), spark.createDataFrame(ent, "entity_id string, x double, y double, z double")
    for radius in (0.5, 3.0):
        want = {}
        for i, x in enumerate(q):
            found = min((math.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2), f"e{j}") for j, y in enumerate(p))
            if found[0] <= radius:
                want[i] = found[::-1]
        got = {r["transcript_id"]: (r["entity_id"], r["distance"]) for r in refine.nearest(df, entities, radius).collect()}
        assert got == want
    assert refine.nearest(df, entities.limit(0), 1.0).count() == 0 and refine.nearest(df.limit(0), entities, 1.0).count() == 0


def test_nearest_keeps_no_pairs(spark):
    """A crowd of entities around a crowd of molecules: 4 000 000 pairs, of which no row leaves a task but the nearest."""
    ent = spark.range(2000).selectExpr("cast(id as string) as entity_id", "id / 1000.0 as x", "0.0 as y", "0.0 as z")
    mol = spark.range(2000).selectExpr("id as transcript_id", "id / 1000.0 + 0.0001 as x", "0.0 as y", "0.0 as z")
    found = refine.nearest(mol, ent, 5.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert found.filter("entity_id = cast(transcript_id as string)").count() == 2000


def crowds(spark):
    ent = spark.range(500).selectExpr("cast(id as string) as entity_id", "id / 1000.0 as x", "0.0 as y", "0.0 as z", "'partial' as etype")
    return spark.range(500).selectExpr("id as transcript_id", "'-1' as cell_id", "id / 1000.0 + 0.0001 as x", "0.0 as y", "0.0 as z"), ent


def test_reassign_sorts_no_pairs(spark):
    mol, ent = crowds(spark)
    out = refine.reassign(mol, ent, "cell_id", "o", 5.0)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("o = cast(transcript_id as string)").count() == 500


def test_reassignment_stats_sort_no_pairs(spark):
    mol, ent = crowds(spark)
    out = refine.reassignment_stats(refine.nearest(mol, ent, 5.0), mol)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert (r["n_unassigned"], r["n_reassigned"]) == (500, 500) and r["max_distance"] == pytest.approx(1e-4)


def test_pairs_within_equal_all_pairs(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(near, "PAIRED", 32)
    monkeypatch.setattr(near, "BATCH", 50)
    p = crowd(6, 300, 130)
    rows = [(f"e{i}", *map(float, x)) for i, x in enumerate(p)] + [("n", None, 0.0, 0.0), ("i", math.inf, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "b string, x double, y double, z double")
    for radius in (0.3, 2.0):
        d = [(f"e{i}", f"e{j}", math.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2)) for i, x in enumerate(p) for j, y in enumerate(p) if f"e{i}" < f"e{j}"]
        want = sorted(x for x in d if x[2] <= radius)
        assert sorted(tuple(r) for r in near.pairs_within(df, radius, ("x", "y", "z")).collect()) == want and want
    assert near.pairs_within(df.limit(0), 1.0, ("x", "y", "z")).count() == 0


@pytest.mark.parametrize("f", [stitch.gains, lambda *a: stitch.gains(*a, use_relu=False), stitch.gains_of_presence])
def test_gains_by_matrix_equal_those_by_pairs(spark, monkeypatch, f):
    rng = np.random.default_rng(7)
    names = [f"g{i:02}" for i in range(21)]
    w = spark.createDataFrame([(a, b, float(rng.normal(0, 0.2))) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.7], "gene_i string, gene_j string, npmi double")
    ent = spark.createDataFrame([(f"e{i}", sorted(set(rng.choice([*names, "off"], int(rng.integers(0, 9))).tolist()))) for i in range(40)], "entity_id string, genes array<string>")
    edges = spark.createDataFrame([(f"e{i}", f"e{j}") for i in range(40) for j in range(i + 1, 40)], "src string, dst string")
    got = f(edges, ent, w)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["src"], r["dst"]): r["delta_c"] for r in got.collect()}
    monkeypatch.setattr(stitch, "DENSE", 2)
    want = {(r["src"], r["dst"]): r["delta_c"] for r in f(edges, ent, w).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 780
    none = w.limit(0)
    assert f(edges, ent, none).count() == 780


def dense_entities(spark, n):
    names = [f"g{i:02}" for i in range(40)]
    w = spark.createDataFrame([(a, b, ((7 * i + j) % 11 - 4) / 20) for i, a in enumerate(names) for j, b in enumerate(names) if a < b], "gene_i string, gene_j string, npmi double")
    ent = spark.createDataFrame([(f"e{i:04}", i / 1000, 0.0, 0.0, [g for j, g in enumerate(names) if (i >> (j % 5)) % 2 or j % 3 == 0]) for i in range(n)], "entity_id string, x double, y double, z double, genes array<string>")
    found = near.pairs_within(ent.withColumnRenamed("entity_id", "b"), 4.0, ("x", "y", "z"))
    return w, ent, found.selectExpr("a as src", "b as dst")


def test_presence_gains_of_a_crowd(spark):
    """All 179 700 pairs of a crowd: their pairs of features, over 60 000 000, are no rows."""
    w, ent, edges = dense_entities(spark, 600)
    got = stitch.gains_of_presence(edges, ent, w)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan
    assert got.count() == 600 * 599 // 2


def test_one_shot_stitching_of_a_crowd(spark):
    w, ent, edges = dense_entities(spark, 300)
    gained = stitch.gains(edges, ent, w)
    assert "Generate" not in gained._jdf.queryExecution().executedPlan().toString()
    gained = {(r["src"], r["dst"]): r["delta_c"] for r in gained.collect()}
    out = {r["entity_id"]: (r["stitched_cc_id"], r["deltaC_max"]) for r in stitch.stitch_once(ent.select("entity_id"), stitch.gains(edges, ent, w), "entity_id").collect()}
    assert len(out) == 300 and len(gained) == 300 * 299 // 2
    for (a, b), gain in gained.items():
        assert gain < 0 or out[a][0] == out[b][0] and min(out[a][1], out[b][1]) >= gain


def test_linked_has_the_components_of_the_neighbour_graph(spark, small_tiles):
    """Against the edges themselves, by way of a function of one's own; with many copies at one place, null labels and no coordinates."""
    for seed, places, k in ((8, 60, 3), (9, None, 5), (10, 4, 6)):
        p = crowd(seed, 400, places)
        rows = [(i, "g", None if i % 17 == 0 else f"c{i % 3}", *map(float, x)) for i, x in enumerate(p)] + [(900, "g", "c0", None, 0.0, 0.0)]
        df = spark.createDataFrame(rows, MOL)
        got, want = (refine.split(df, "cell_id", "o", k, 1.0, neighbors=f) for f in (graph.radius_knn, lambda *a: graph.radius_knn(*a)))
        assert sorted(map(tuple, got.select("transcript_id", "o").collect())) == sorted(map(tuple, want.select("transcript_id", "o").collect()))
        assert got.select("o").distinct().count() > 6 or places == 4


def test_split_ships_no_edge_between_labels(spark):
    """3000 molecules at one place, no two of a label: no edge leaves its task."""
    df = spark.range(3000).selectExpr("id as b", "cast(id as string) as label", "0.0 as x", "0.0 as y", "0.0 as z")
    assert near.linked(df, 20, 1.0, ("x", "y", "z")).count() == 0
    alike = near.linked(df.withColumn("label", F.lit("a")), 20, 1.0, ("x", "y", "z"))
    assert alike.count() == 2999 and alike.filter("dst = 0").count() == 2999


def test_tiles_where_nothing_is_near(spark):
    mol = spark.createDataFrame([(1, "g", "-1", 0.0, 0.0, 0.0), (2, "g", "a", 3.0, 3.0, 0.0)], MOL)
    ent = spark.createDataFrame([("e", 0.9, 0.9, 0.9)], "entity_id string, x double, y double, z double")
    assert refine.nearest(mol, ent, 1.0).count() == 0
    assert refine.split(mol, "cell_id", "o", 2, 1.0).select("o").distinct().count() == 2
    assert near.pairs_within(ent.withColumnRenamed("entity_id", "b"), 1.0, ("x", "y", "z")).count() == 0


def test_presence_gains_score_a_union_once(spark, monkeypatch):
    """44 850 pairs of entities with 32 unions: a batch scores each of them once, not each pair's."""
    w, ent, edges = dense_entities(spark, 300)
    scored, plain = spark.sparkContext.accumulator(0), stitch._presence_score

    def counted(sums, sets):
        scored.add(len(sets))
        return plain(sums, sets)

    want = {(r["src"], r["dst"]): r["delta_c"] for r in stitch.gains_of_presence(edges, ent, w).collect()}
    monkeypatch.setattr(stitch, "_presence_score", counted)
    got = {(r["src"], r["dst"]): r["delta_c"] for r in stitch.gains_of_presence(edges, ent, w).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 300 * 299 // 2
    assert 32 <= scored.value < len(got) / 10


@pytest.mark.parametrize("f", [2, 8, 21, 64, 65, 130])
def test_united_sets_are_those_of_python(f):
    rng = np.random.default_rng(f)
    names = [f"g{i:03}" for i in range(f)]
    sums = stitch._Sums([{"gene_i": a, "gene_j": b, "npmi": float(rng.normal(0, 0.2))} for a, b in zip(names, names[1:], strict=False)], 0.05, 0.05)
    lists = [[], names, *[[g for g in [*names, "off"] if rng.random() < 0.3] for _ in range(6)]]
    i, j = rng.integers(0, len(lists), (2, 300))
    for kind in (pa.binary(), pa.large_binary()):
        sides = [sums.packed(pa.array(lists, pa.list_(pa.string()))).take(pa.array(x)).cast(kind) for x in (i, j)]
        for part in (slice(0, 300), slice(37, 190), slice(5, 5)):
            sets, own = sums.united(*[s[part] for s in sides])
            assert len(sets) == len({tuple(x) for x in sets.tolist()}) and sets.shape[1] == f
            got = [{names[k] for k in np.flatnonzero(x)} for x in sets[own]]
            assert got == [{*lists[a], *lists[b]} - {"off"} for a, b in zip(i[part], j[part], strict=True)]
            assert len(sums.scores(stitch._presence_score, *[s[part] for s in sides])) == len(got)
