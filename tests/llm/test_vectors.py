import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import graph_dedup

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Links among distinct pairs of id and vector; the vectors of one id belong together."""
    vectors = sorted({(i, tuple(np.float32(x) for x in v)) for i, v, _ in rows})
    u = np.array([v for _, v in vectors], float)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    near = u @ u.T >= 0.98
    ids = np.array([i for i, _ in vectors])
    comp = ids.copy()
    while True:
        least = np.where(near | (ids[:, None] == ids), comp, ids.max()).min(axis=1)
        if (least == comp).all():
            break
        comp = least
    return sorted((int(i), int(n) - 1, int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), comp, strict=True))


def run(spark, rows, **options):
    return sorted(tuple(r)[:4] for r in graph_dedup.near_duplicates(spark.createDataFrame(rows, KIND), **options).collect())


@pytest.mark.parametrize("limit", [2048, 30])
def test_ids_with_several_vectors_lose_no_link(spark, limit):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 16))
    near = lambda v: (v + 0.01 * rng.normal(size=16)).astype(np.float32).tolist()
    rows = [(1, near(a), 0), (1, near(b), 0), (5, near(a), 0), (6, near(b), 0), (7, near(a), 0), (9, near(b), 0)]
    rows += [(20 + k, rng.normal(size=16).astype(np.float32).tolist(), 0) for k in range(60)]
    got = run(spark, rows, limit=limit)
    assert got == brute(rows) and {r[2] for r in got if r[0] < 10} == {1} and all(r[1] == 2 for r in got if r[0] < 10)


def test_equal_vectors_under_many_ids(spark):
    rng = np.random.default_rng(2)
    v, w = (x.astype(np.float32).tolist() for x in rng.normal(size=(2, 8)))
    rows = [(i, v, 0) for i in range(700)] + [(i, w, 0) for i in range(690, 1000)]
    assert run(spark, rows) == brute(rows)


def test_what_splits_leave_too_large_is_searched_whole(spark, monkeypatch):
    """A bucket that no split makes small keeps its links, in one task or block by block."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + 0.03 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(300)]
    for dense in (1 << 13, 64):
        monkeypatch.setattr(graph_dedup, "LEVELS", 0)
        monkeypatch.setattr(graph_dedup, "DENSE", dense)
        assert run(spark, rows, limit=20) == brute(rows)


def test_links_found_from_one_end_count_for_both():
    found = np.zeros((10, 10), bool)
    found[2, 7] = found[7, 9] = True
    comp = np.arange(10)
    both = found | found.T
    assert sorted(graph_dedup._spanning(both[:5], 0, 0, comp) + graph_dedup._spanning(both[5:], 0, 5, comp)) == [(2, 7), (7, 9)]
    assert comp[2] == comp[7] == comp[9] and len(set(comp.tolist())) == 8


def test_the_whole_table_beside_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in graph_dedup.near_duplicates(table).collect()}
    rows = table.filter("label is not null").select("vec_id", "label", F.col("embedding").alias("v")).collect()
    for label in {r["label"] for r in rows}:
        own = [r for r in rows if r["label"] == label and r["v"] and any(r["v"])]
        u = np.array([r["v"] for r in own], float)
        u /= np.sqrt((u * u).sum(axis=1))[:, None]
        assert [got[r["vec_id"]] for r in own] == ((u @ u.T >= 0.98).sum(axis=1) - 1).tolist()
