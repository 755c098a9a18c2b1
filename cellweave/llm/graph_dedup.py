"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards, each small enough for a
task; a shard's nearest candidates and some far ones are pruned robustly to a short
adjacency list, and the lists of a vector's shards are united. Every vector is then
searched for, greedily from its shard's medoid over the united lists; whatever lies in
range is expanded in turn, so that the search grows over the whole range. Hits are
verified by cosine in double precision. A sample of queries is compared with all
vectors, and the search is repeated with a wider beam while recall falls short. Where
that doesn't help, all vectors of a label are compared, block by block.

A dense group stays in one shard. One that is too large for a task takes no part in
the search: its vectors are compared with each other and with whatever else of their
label lies near enough, block by block, and only counts and a spanning set leave a task.

Equal vectors of a label are merged first, under a number of their own, and counted with
multiplicity. Links within a shard are kept as bits, a row for each query, and counted
where they are found; only a spanning set of them, and links across shards, leave the task.

Defined cases: a null label, and a null, empty, zero or non-finite vector or one with a
null component, link with nothing and are kept; a row with a null id links with nothing
and has a null component; rows that share id, label and vector are one vector; rows that
share an id alone are vectors of their own, each with its own links, in one component;
vectors of different lengths never link; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellweave.operators.components import connected_components
from cellweave.skew import dealt, hot_keys, repeated
from cellweave.util import checkpoint

THRESHOLD = 0.98
#: Vectors of a shard at most; centres of one split; a second shard within MARGIN of the best one's cosine.
SHARD, CENTRES, MARGIN, LEVELS = 2048, 64, 0.12, 8
#: Centres as near to each other as this are one, so that a dense group stays together; a shard with one centre isn't split further, nor one that LEVELS splits have left too large. One task holds DENSE vectors of a group, and in a bucket of more, near centres are one only where a share LINKED of their pairs link.
CLOSE, DENSE, WHOLE, LINKED = 0.9, 1 << 13, "!", 1 / 16
#: Rows that one task deals to centres.
SLICE = 20000
#: Candidates, far candidates, kept neighbours, and the slack of robust pruning.
NEAR, FAR, DEGREE, ALPHA = 48, 16, 24, 1.2
BEAM = 32
#: Queries of the audit, the recall it asks for, how often the beam is doubled for it, and the recall below which there is no result.
AUDIT, RECALL, WIDENINGS, REFUSED = 64, 0.97, 2, 0.9
#: Queries searched, and pairs verified, at once.
BLOCK, PAIRS = 256, 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _apart(units: np.ndarray, linked: float | None = None) -> np.ndarray:
    """The centres that aren't within CLOSE of one before them; where linked is given, also those near one whose group has less than a share LINKED of pairs that reach it."""
    keep: list[int] = []
    of = np.arange(len(units))
    for i, u in enumerate(units):
        near = units[keep] @ u
        if len(near) and near.max() >= CLOSE:
            of[i] = keep[int(near.argmax())]
        else:
            keep.append(i)
    if linked is not None:
        for c in list(keep):
            own = np.flatnonzero(of == c)
            x, y = np.triu_indices(len(own), 1)
            if len(x) and ((units[own] @ units[own].T)[x, y] >= linked).mean() < LINKED:
                keep += own[1:].tolist()
    return units[sorted(keep)]


def _dealer(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deals vectors to the centres that precede them in a partition sorted by (bucket, slice, is_vector)."""
        bucket, centres, units, end, small = None, [], None, "", False
        for batch in batches:
            names = np.asarray(batch.column(0).cast(pa.string()).to_pylist(), object)
            part = np.asarray(batch.column(1))
            new = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (part[1:] != part[:-1]))))
            vector = np.asarray(batch.column(2)) == 1
            for x, y in zip(new, [*new[1:], len(names)], strict=True):
                if bucket != (names[x], part[x]):
                    bucket, centres, units, end = (names[x], part[x]), [], None, ""
                seeds = np.flatnonzero(~vector[x:y]) + x
                if len(seeds):
                    centres.append(_matrix(batch.column(4).take(pa.array(seeds))))
                    small = batch.column(6)[int(seeds[0])].as_py() == 1
                rows = np.flatnonzero(vector[x:y]) + x
                if not len(rows):
                    continue
                if units is None:
                    units = _apart(_unit(np.concatenate(centres)), None if small else threshold)
                    end = WHOLE if len(units) == 1 else ""
                index = pa.array(rows)
                near = _unit(_matrix(batch.column(4).take(index))) @ units.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :2]
                first = order[:, 0]
                out, at, main = [first], [np.arange(len(rows))], [np.asarray(batch.column(5).take(index))]
                if near.shape[1] > 1:
                    i = np.arange(len(rows))
                    close = np.flatnonzero(near[i, order[:, 1]] >= near[i, first] - MARGIN)
                    out, at, main = [*out, order[close, 1]], [*at, close], [*main, np.zeros(len(close), bool)]
                out, at, main = np.concatenate(out), np.concatenate(at), np.concatenate(main)
                take = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([pa.array([f"{names[x]}.{c}{end}" for c in out]), batch.column(3).take(take), batch.column(4).take(take), pa.array(main), batch.column(6).take(take)], ["bucket", "id", "vec", "main", "mult"])

    return run


def shards(reps: DataFrame, limit: int = SHARD, threshold: float = THRESHOLD) -> DataFrame:
    """bucket, id, vec, main, mult: each vector in its main shard and perhaps others. Only buckets over limit are split, and no dense group is.

    A bucket that ends with WHOLE has stayed over limit; what is over DENSE is compared block by block.
    """
    cols = ["bucket", "id", "vec", "main", "mult"]
    members = reps.withColumn("main", F.lit(True)).select(cols)
    done = None
    for _ in range(LEVELS):
        size = members.groupBy("bucket").agg(F.count("*").alias("n"))
        big = checkpoint(size.filter((F.col("n") > limit) & ~F.col("bucket").endswith(WHOLE)))
        if big.isEmpty():
            break
        small = members.join(big, "bucket", "left_anti")
        done = small if done is None else done.unionByName(small)
        big = big.withColumn("k", F.least(F.lit(CENTRES), F.ceil(3 * F.col("n") / limit))).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
        large = members.join(big, "bucket")
        place = F.pmod(F.xxhash64("id", "bucket"), F.lit(1 << 30))
        some = large.filter(F.col("main")).withColumn("place", place).filter(F.col("place") < (1 << 30) * 4 * (F.col("k") + 8) / F.col("n"))
        seeds = some.withColumn("r", F.row_number().over(W.partitionBy("bucket").orderBy("place", "id"))).filter(F.col("r") <= F.col("k"))
        seeds = seeds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        own = [F.col(c) for c in ("bucket", "part", "is_vector", "id", "vec", "main", "mult")]
        seeds = seeds.withColumn("mult", (F.col("n") <= DENSE).cast("long"))  # whether all near centres are merged
        both = seeds.withColumn("is_vector", F.lit(0)).select(own).unionByName(large.withColumn("part", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("is_vector", F.lit(1)).select(own))
        dealt = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "is_vector", "id").mapInArrow(_dealer(threshold), "bucket string, id long, vec array<double>, main boolean, mult long")
        # A vector may come to a shard from two others of the level above.
        members = checkpoint(dealt.groupBy("bucket", "id").agg(F.first("vec").alias("vec"), F.max("main").alias("main"), F.first("mult").alias("mult")))
    else:
        size = members.groupBy("bucket").agg(F.count("*").alias("n"))
        left = checkpoint(size.filter((F.col("n") > limit) & ~F.col("bucket").endswith(WHOLE)).select("bucket", F.lit(WHOLE).alias("end")))
        members = members.join(left, "bucket", "left").withColumn("bucket", F.concat("bucket", F.coalesce("end", F.lit("")))).select(cols)
    return members if done is None else done.unionByName(members)


def prune(units: np.ndarray, candidates: np.ndarray, at: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: of each row's candidates the nearest is kept, and those nearer to it (by alpha) than to the row are dropped, again and again. Padded with -1."""
    n, c = candidates.shape
    own = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", units[candidates], units[at])))
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(own, order, axis=1)
    v = units[candidates]
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))))
    live = candidates != at[:, None]
    live[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out, used = np.full((n, degree), -1), np.zeros(n, np.int64)
    rows = np.arange(n)
    for j in range(c):
        take = rows[live[:, j] & (used < degree)]
        if len(take):
            out[take, used[take]] = candidates[take, j]
            used[take] += 1
            live[take] &= alpha * apart[take, j] > own[take]
    return out


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of a shard, both ways."""
    group = group.sort_values("id", ignore_index=True)
    ids, n = group["id"].to_numpy(), len(group)
    if n < 2:
        return pd.DataFrame({"src": [], "dst": []}).astype("int64")
    units = _unit(np.stack(group["vec"].to_numpy())).astype(np.float32)
    rng, src, dst = np.random.default_rng(n), [], []
    for a in range(0, n, BLOCK):
        at = np.arange(a, min(n, a + BLOCK))
        sims = units[at] @ units.T
        k = min(NEAR + 1, n)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        far = rng.integers(0, n, (len(at), FAR))
        kept = prune(units, np.concatenate([near, far], axis=1), at)
        r, c = np.nonzero(kept >= 0)
        src.append(at[r])
        dst.append(kept[r, c])
    s, d = np.concatenate(src), np.concatenate(dst)
    return pd.DataFrame({"src": ids[np.concatenate([s, d])], "dst": ids[np.concatenate([d, s])]}).drop_duplicates()


class _Search:
    """Range-expanding greedy search of a block of queries over the adjacency of a shard and its rim."""

    def __init__(self, units: np.ndarray, lists: np.ndarray, entry: int, beam: int):
        self.units, self.lists, self.entry, self.beam = units, lists, entry, beam

    def run(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the queries and of the nodes found for them."""
        n, q = len(self.units), self.units[queries]
        b = np.arange(len(queries))
        seen = np.zeros((len(b), n), bool)
        ids = np.full((len(b), self.beam), -1)
        sims = np.full((len(b), self.beam), -2.0, np.float32)
        todo = np.zeros((len(b), self.beam), bool)
        ids[:, 0], sims[:, 0], todo[:, 0] = self.entry, q @ self.units[self.entry], True
        seen[:, self.entry] = True
        hit = np.zeros((len(b), n), bool)  # in range
        hit[:, self.entry] = sims[:, 0] >= least
        spread = np.zeros((len(b), n), bool)  # expanded
        active = b
        while len(active):
            best = np.argmax(np.where(todo[active], sims[active], -3), axis=1)
            node = ids[active, best]
            node, active = self._expanded(active, node, best, ids, sims, todo, seen, spread, hit, q, least)
            active = active[todo[active].any(axis=1)]
        # Whatever is in range is expanded, beam or no beam, until nothing new is.
        while True:
            at, node = np.nonzero(hit & ~spread)
            if not len(at):
                break
            for k in range(0, len(at), 16 * BLOCK):
                self._look(at[k : k + 16 * BLOCK], node[k : k + 16 * BLOCK], seen, spread, hit, q, least)
        return np.nonzero(hit)

    def _look(self, active, node, seen, spread, hit, q, least):
        spread[active, node] = True
        near = self.lists[node]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        s = np.full(near.shape, -2, np.float32)
        s[r, c] = np.einsum("nd,nd->n", self.units[near[r, c]], q[active[r]])
        r, c = np.nonzero(s >= least)
        hit[active[r], near[r, c]] = True
        return near, s

    def _expanded(self, active, node, best, ids, sims, todo, seen, spread, hit, q, least):
        todo[active, best] = False
        near, s = self._look(active, node, seen, spread, hit, q, least)
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], s], axis=1)
        all_todo = np.concatenate([todo[active], s > -2], axis=1)
        top = np.argpartition(-all_sims, self.beam - 1, axis=1)[:, : self.beam]
        ids[active], sims[active], todo[active] = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_sims, all_todo))
        return node, active


def _true(exact: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of positions link, in double precision, a bounded number at a time."""
    out = np.empty(len(x), bool)
    for k in range(0, len(x), PAIRS):
        out[k : k + PAIRS] = np.einsum("nd,nd->n", exact[x[k : k + PAIRS]], exact[y[k : k + PAIRS]]) >= threshold
    return out


def _spanning(hits: np.ndarray, low: int, row: int, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of the links of rows from ``row`` on with columns from ``low`` on, those that join components; comp is brought up to date."""
    join = []
    for i in range(len(hits)):
        y = np.flatnonzero(hits[i]) + low
        other = comp[y]
        if (other == comp[row + i]).all():
            continue
        parts, at = np.unique(other, return_index=True)
        join += [(row + i, j) for j, part in zip(y[at], parts, strict=True) if part != comp[row + i]]
        comp[np.isin(comp, parts)] = comp[row + i]
    return join


def _searcher(threshold: float, beam: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, n): n links of a that were counted here, or, with n = -1, a link across shards, or, with n = 0, a link that joins components."""
        group = group.sort_values(["member", "id"], ascending=[False, True], ignore_index=True)
        ids, mult = group["id"].to_numpy(), group["mult"].to_numpy()
        member, main = group["member"].to_numpy(bool), group["main"].to_numpy(bool)
        exact = _unit(np.stack(group["vec"].to_numpy()))
        units = exact.astype(np.float32)
        own = int(member.sum())
        order = np.argsort(ids, kind="stable")
        lists = [np.asarray(x, np.int64) if x is not None else np.empty(0, np.int64) for x in group["near"]]
        table = np.full((len(ids), max([1, *map(len, lists)])), -1)
        for i, x in enumerate(lists[:own]):
            spot = order[np.minimum(np.searchsorted(ids[order], x), len(ids) - 1)]
            spot = spot[ids[spot] == x]
            table[i, : len(spot)] = spot
        entry = int(np.argmax(units[:own] @ units[:own].mean(axis=0)))
        search = _Search(units, table, entry, beam)
        queries, across = np.flatnonzero(main), []
        n = len(queries)
        place = np.full(len(ids), -1)
        place[queries] = np.arange(n)
        found = np.zeros((n, -(-n // 8)), np.uint8)  # a bit for each pair of queries
        for a in range(0, n, BLOCK):
            some = queries[a : a + BLOCK]
            r, c = search.run(some, threshold - 1e-4)
            good = (some[r] != c) & _true(exact, some[r], c, threshold)
            r, c = r[good], c[good]
            inner = main[c]
            bits = np.zeros((len(some), n), bool)
            bits[r[inner], place[c[inner]]] = True
            found[a : a + BLOCK] = np.packbits(bits, axis=1)
            across.append(np.stack([ids[some[r[~inner]]], ids[c[~inner]]], axis=1))
        links, comp, join = np.zeros(n, np.int64), np.arange(n), []
        for a in range(0, n, BLOCK):  # a link may have been found from either end
            b = min(n, a + BLOCK)
            hits = np.unpackbits(found[a:b], axis=1, count=n).astype(bool)
            hits |= np.unpackbits(found[:, a // 8 : -(-b // 8)], axis=1, count=b - a).astype(bool).T
            links[a:b] = hits @ mult[queries]
            join += _spanning(hits, 0, a, comp)
        join = np.array(join, np.int64).reshape(-1, 2)
        counted = np.flatnonzero(links > 0)
        across = np.unique(np.sort(np.concatenate(across), axis=1), axis=0) if across else np.empty((0, 2), np.int64)
        mine = ids[queries]
        out = [(mine[counted], mine[counted], links[counted]), (mine[join[:, 0]], mine[join[:, 1]], np.zeros(len(join), np.int64)), (across[:, 0], across[:, 1], np.full(len(across), -1))]
        a, b, n = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": n})

    return run


def _searched(members: DataFrame, united: DataFrame, threshold: float, beam: int) -> DataFrame:
    """a, b, n as the searcher gives them. A shard's task has its members with their lists, and the members' neighbours elsewhere."""
    inside = members.join(united, members.id == united.src, "left").select("bucket", "id", "vec", "main", "mult", "near", F.lit(True).alias("member"))
    rim = inside.select("bucket", F.explode("near").alias("id")).distinct().join(members.select("bucket", "id"), ["bucket", "id"], "left_anti")
    vectors = members.filter("main").select("id", "vec", "mult")
    rim = rim.join(vectors, "id").select("bucket", "id", "vec", F.lit(False).alias("main"), "mult", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("member"))
    return inside.unionByName(rim).groupBy("bucket").applyInPandas(lambda g: _searcher(threshold, beam)(g), "a long, b long, n long")


def _ball(group: pd.DataFrame) -> pd.DataFrame:
    """The mean direction of a block and the largest angle to it."""
    units = _unit(np.stack(group["vec"].to_numpy()))
    mean = units.mean(axis=0)
    centre = mean / np.sqrt(mean @ mean) if mean.any() else units[0]
    radius = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
    return pd.DataFrame({"label": group["label"].iloc[:1], "host": group["block"].iloc[:1], "centre": [centre.tolist()], "radius": [radius]})


def _comparer(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Rows (a, b, n) as the searcher gives them, of the links of a block's vectors with its guests and, in its first slice, with each other."""
        group = group.sort_values(["home", "id"], ascending=[False, True], ignore_index=True)
        ids, mult = group["id"].to_numpy(), group["mult"].to_numpy()
        exact = _unit(np.stack(group["vec"].to_numpy()))
        units = exact.astype(np.float32)
        home, first = int(group["home"].sum()), group["slice"].iloc[0] == 0
        low = 0 if first else home
        links, comp, join = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for a in range(0, home, BLOCK):
            b = min(home, a + BLOCK)
            sims = units[a:b] @ units[low:].T
            hits = sims >= threshold
            r, c = np.nonzero(np.abs(sims - threshold) < 1e-4)
            hits[r, c] = _true(exact, a + r, low + c, threshold)
            if first:
                hits[np.arange(b - a), np.arange(a, b)] = False
            links[a:b] += hits @ mult[low:]
            links[home:] += mult[a:b] @ hits[:, home - low :]
            join += _spanning(hits, low, a, comp)
        join = np.array(join, np.int64).reshape(-1, 2)
        counted = np.flatnonzero(links > 0)
        x, y = ids[np.concatenate([counted, join[:, 0]])], ids[np.concatenate([counted, join[:, 1]])]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "n": np.concatenate([links[counted], np.zeros(len(join), np.int64)])})

    return run


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, n as the searcher gives them, of all links of the rows that have a block. rows: label, block, id, vec, mult.

    A block's guests are the rows without a block and those of later blocks that lie
    within its ball and the threshold's angle; none that could link is left out.
    """
    kind = "a long, b long, n long"
    hosts = checkpoint(rows.filter("block is not null").groupBy("label", "block").applyInPandas(_ball, "label string, host string, centre array<double>, radius double"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    cosine = F.aggregate(F.zip_with("vec", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / norm
    slack = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) <= F.col("radius") + slack
    guests = rows.join(hosts, "label").filter(F.col("block").isNull() | (F.col("block") > F.col("host"))).filter(near).select("host", "id", "vec", "mult")
    slices = checkpoint(guests.groupBy("host").agg(F.ceil(F.count("*") / DENSE).cast("int").alias("slices")))
    own = rows.filter("block is not null").withColumnRenamed("block", "host").join(slices, "host", "left")
    own = own.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).select("host", "slice", "id", "vec", "mult", F.lit(True).alias("home"))
    guests = guests.join(slices, "host").select("host", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "vec", "mult", F.lit(False).alias("home"))
    return own.unionByName(guests).groupBy("host", "slice").applyInPandas(_comparer(threshold), kind)


def _blocks(name: str, n: str):
    """The block of a row of a group of n vectors: at most about DENSE of them."""
    return F.concat(F.col(name), F.lit("#"), F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / DENSE)).cast("string"))


def audit(reps: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT) -> float:
    """The share of true links that were found, over a bounded sample of queries held against all vectors, block by block.

    Half of the sample is drawn from all vectors and half from those with links.
    """
    place = F.xxhash64("id")
    chosen = reps.orderBy(place, "id").limit(queries // 2).select("id").unionByName(counts.filter("n > 0").orderBy(place, "id").limit(queries - queries // 2).select("id")).distinct()
    sample = [(r["id"], r["bucket"], np.asarray(r["vec"])) for r in reps.join(chosen, "id").collect()]
    if not sample:
        return 1.0
    shared = reps.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, ids, mult = batch.column(0).to_pylist(), np.asarray(batch.column(1)), np.asarray(batch.column(3))
            by: dict[str, np.ndarray] = {b: np.flatnonzero(np.array([x == b for x in buckets])) for b in {x[1] for x in shared.value} & set(buckets)}
            for q, b, v in shared.value:
                if b in by:
                    m = _unit(_matrix(batch.column(2).take(pa.array(by[b]))))
                    near = (m @ (v / np.sqrt((v * v).sum())) >= threshold) & (ids[by[b]] != q)
                    if near.any():
                        yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([int(mult[by[b]][near].sum())])], ["id", "true"])

    true = reps.select("bucket", "id", "vec", "mult").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    got = true.join(counts, "id", "left").agg(F.sum("true"), F.sum(F.least(F.coalesce("n", F.lit(0)), "true"))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, beam: int = BEAM, limit: int = SHARD) -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept, audited_recall."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & sound, F.lit(False))
    marked = rows.select("id", F.when(sound, F.concat(F.size("vec"), F.lit("/"), "label", F.lit("/"))).alias("bucket"), F.when(sound, F.col("vec")).alias("vec"))
    marked = marked.withColumn("hash", F.xxhash64("bucket", "vec"))
    # Each distinct vector has a number of its own, fixed by the checkpoint; the least of its ids names it in the end.
    merged = marked.filter("bucket is not null").groupBy("bucket", "vec", "hash").agg(F.min("id").alias("least"), F.count_distinct("id").alias("mult"), F.count("*").alias("rows"))
    merged = checkpoint(merged).withColumn("id", F.monotonically_increasing_id())
    reps = merged.select("id", "bucket", "vec", "mult")
    members = checkpoint(shards(reps.select("bucket", "id", "vec", "mult"), limit, threshold))
    huge = checkpoint(members.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("bucket").endswith(WHOLE) & (F.col("size") > DENSE)))
    dense = None
    if not huge.isEmpty():
        hosts = checkpoint(members.filter("main").join(huge, "bucket").select("id", _blocks("bucket", "size").alias("block")))
        rows = reps.join(hosts, "id", "left").select(F.col("bucket").alias("label"), "block", "id", "vec", "mult")
        dense = checkpoint(_compared(rows, threshold))
        members = checkpoint(members.join(huge, "bucket", "left_anti").join(hosts, "id", "left_anti").select(members.columns))
    edges = members.groupBy("bucket").applyInPandas(_build, "src long, dst long")
    united = checkpoint(edges.groupBy("src").agg(F.collect_set("dst").alias("near")))
    for turn in range(WIDENINGS + 2):
        if turn <= WIDENINGS:
            found = checkpoint(_searched(members, united, threshold, beam << turn))
            found = found if dense is None else found.unionByName(dense)
        else:
            sizes = reps.groupBy("bucket").agg(F.count("*").alias("size"))
            rows = reps.join(sizes, "bucket").select(F.col("bucket").alias("label"), _blocks("bucket", "size").alias("block"), "id", "vec", "mult")
            found = checkpoint(_compared(rows, threshold))
        across = found.filter("n = -1").select("a", "b").distinct()
        weight = reps.select(F.col("id").alias("w"), "mult")
        sides = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = sides.join(weight, sides.b == weight.w).groupBy(F.col("a").alias("id")).agg(F.sum("mult").alias("n"))
        counts = checkpoint(found.filter("n > 0").select(F.col("a").alias("id"), "n").unionByName(more).groupBy("id").agg(F.sum("n").alias("n")))
        recall = audit(reps, counts, threshold)
        if recall >= RECALL:
            break
    if recall < REFUSED:
        raise RuntimeError(f"the audit found {recall:.3f} of the links, less than {REFUSED}")
    total = merged.agg(F.sum("rows")).first()[0] or 0
    twins = hot_keys(merged.groupBy("hash").agg(F.sum("rows").alias("rows")), "hash", "rows", total)
    rows = dealt(marked, twins, "hash", F.col("id")).select(F.col("id").alias("vec_id"), "bucket", "vec", "__salt")
    rows = rows.join(repeated(merged.select("bucket", "vec", "hash", "id", "mult"), twins, "hash").drop("hash"), ["bucket", "vec", "__salt"], "left")
    rows = checkpoint(rows.select("vec_id", "id", "mult"))
    # An id with several vectors: these belong together.
    shared = rows.filter("id is not null").groupBy("vec_id").agg(F.min("id").alias("v0"), F.max("id").alias("v1")).filter("v0 <> v1").select("vec_id", "v0")
    ties = rows.join(shared, "vec_id").select(F.col("id").alias("a"), F.col("v0").alias("b"))
    comps = connected_components(found.filter("n <= 0").select("a", "b").unionByName(ties), "a", "b")
    named = checkpoint(merged.select("id", "least", "rows").join(comps, F.col("id") == F.col("node"), "left").select("id", "least", "rows", F.coalesce("component", "id").alias("comp")))
    groups = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("vectors"))
    large = hot_keys(groups, "comp", "vectors", total)
    named = dealt(named, large, "comp", F.col("id")).join(repeated(groups.select("comp", "component_id"), large, "comp"), ["comp", "__salt"]).join(counts, "id", "left").select("id", "rows", "component_id", "n")
    again = hot_keys(named, "id", "rows", total)
    out = dealt(rows, again, "id", F.col("vec_id")).join(repeated(named.drop("rows"), again, "id"), ["id", "__salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    n = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("mult"), F.lit(1)) - 1
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("audited_recall"))


ORACLE = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(node, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY node)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
