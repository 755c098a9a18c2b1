"""Nearest neighbours without their pairs: tiles of about TILE points, each searched by itself.

The cuts of the tiles come from a bounded sample of the points; where they lie changes no
result. A point is at home in one tile, and goes as a guest to each tile that has it
within the radius. In a task, leaves of points are held against leaves of points, the
nearest boxes first, until none can hold anything nearer; distances are differences of
coordinates, as in SQL. Points at one place are searched as one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cellweave.util import checkpoint

#: Points of a tile, about; points sampled for the cuts; tiles at most.
TILE, SAMPLE, MAX_TILES = 1 << 15, 1 << 16, 1 << 12
#: Guests of a tile that one task holds; more are dealt to several tasks.
GUESTS = 1 << 18
#: Points of a tile all of whose pairs are wanted.
PAIRED = 1 << 9
#: Points of a leaf, and pairs that are put together at once, about.
LEAF, BATCH = 48, 1 << 18


class Cuts:
    """A tree of cuts: node n has the children 2n + 1 (up to the cut) and 2n + 2; the nodes without a cut are tiles."""

    def __init__(self, sample: np.ndarray, tiles: int):
        depth = max(0, int(np.ceil(np.log2(max(1, min(tiles, MAX_TILES))))))
        self.axis, self.cut = np.full((2 << depth) - 1, -1), np.zeros((2 << depth) - 1)
        todo = [(0, sample, depth)]
        while todo:
            node, p, left = todo.pop()
            if left == 0 or len(p) < 2:
                continue
            k = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            cut = float(np.median(p[:, k]))
            low = p[:, k] <= cut
            if low.all():
                low = p[:, k] < cut
                cut = float(p[low, k].max()) if low.any() else cut
            if not low.any() or low.all():
                continue
            self.axis[node], self.cut[node] = k, cut
            todo += [(2 * node + 1, p[low], left - 1), (2 * node + 2, p[~low], left - 1)]

    def reached(self, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of all tiles up to radius from a row's point, in any direction."""
        row, node, rows, tiles = np.arange(len(p)), np.zeros(len(p), np.int64), [], []
        while len(row):
            leaf = self.axis[node] < 0
            rows.append(row[leaf])
            tiles.append(node[leaf])
            row, node = row[~leaf], node[~leaf]
            x, cut = p[row, self.axis[node]], self.cut[node]
            slack = radius * (1 + 1e-9) + 1e-9 * np.abs(x) if radius else 0.0
            low, high = x - slack <= cut, x + slack > cut
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
        return np.concatenate(rows), np.concatenate(tiles)


def cuts_of(points: DataFrame, coords: Sequence[str], tile: int | None = None) -> tuple[Cuts, int]:
    """Cuts into tiles of about that many of the points, and how many points there are."""
    rows = points.select(*coords)
    n = rows.count()
    some = rows if n <= SAMPLE else rows.sample(fraction=SAMPLE / n, seed=1)
    found = some.limit(2 * SAMPLE).toArrow()
    p = np.column_stack([found.column(c).to_numpy() for c in coords]) if found.num_rows else np.empty((0, len(coords)))
    return Cuts(p, -(-n // (tile or TILE))), n


def placed(df: DataFrame, coords: Sequence[str]) -> DataFrame:
    """The rows with finite coordinates, as doubles: others are near nothing."""
    df = df.withColumns({c: F.col(c).cast("double") for c in coords}).dropna(subset=list(coords))
    for c in coords:
        df = df.filter(F.abs(c) < float("inf"))
    return df


def on_tiles(df: DataFrame, cuts: Cuts, coords: Sequence[str], radius: float) -> DataFrame:
    """df with a row for each tile it reaches, and ``tile``."""
    schema = T.StructType([*df.schema.fields, T.StructField("tile", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in coords])
            row, tile = cuts.reached(p, radius)
            for k in range(0, len(row), 1 << 16):
                some = pa.Table.from_batches([b]).take(pa.array(row[k : k + (1 << 16)]))
                yield from some.append_column("tile", pa.array(tile[k : k + (1 << 16)])).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def leaves(p: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Rows of p in leaves of up to most points, cut at the middle of the longest side."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            if len(rows):
                out.append(rows)
            continue
        own = p[rows]
        k = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, k], len(rows) // 2)
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return out


def search(queries: np.ndarray, points: np.ndarray, k: int, radius: float, slack: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) in batches that hold whole queries: each query's points up to radius and up to its k-th nearest's distance and slack."""
    if not len(points) or not len(queries):
        return
    homes, dims = leaves(points), range(points.shape[1])
    low = np.array([points[rows].min(axis=0) for rows in homes])
    high = np.array([points[rows].max(axis=0) for rows in homes])
    sizes = np.array([len(rows) for rows in homes])
    out = []
    for asked in leaves(queries):
        q = queries[asked]
        gap = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0.0)
        gap = np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-12)
        near = np.flatnonzero(gap <= radius)
        near = near[np.argsort(gap[near], kind="stable")]
        held = np.cumsum(sizes[near])
        at, worst, rows, far = 0, radius, np.empty(0, np.int64), np.empty((len(q), 0))
        want = 4 * k + 2 * LEAF
        while at < len(near) and gap[near[at]] <= worst:
            end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + want)))
            end = min(end, at + int(np.searchsorted(gap[near[at:]], worst, "right")))
            more = np.concatenate([homes[j] for j in near[at:end]])
            total = 0.0
            for c in dims:
                d = q[:, c, None] - points[more, c][None, :]
                total = total + d * d
            rows, far = np.concatenate([rows, more]), np.concatenate([far, np.sqrt(total)], axis=1)
            at, want = end, 2 * want
            if len(rows) >= k:
                limit = np.minimum(np.partition(far, k - 1, axis=1)[:, k - 1] + slack, radius)
                worst = float(limit.max())
                keep = (far <= limit[:, None]).any(axis=0)
                rows, far = rows[keep], far[:, keep]
        limit = np.minimum(np.partition(far, k - 1, axis=1)[:, k - 1] + slack, radius) if far.shape[1] >= k else np.full(len(q), radius)
        i, j = np.nonzero(far <= limit[:, None])
        if len(i):
            out.append((asked[i], rows[j], far[i, j]))
        if sum(len(x[0]) for x in out) >= BATCH:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
            out = []
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def distinct(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, place of each row): the distinct rows of p."""
    if not len(p):
        return p, np.empty(0, np.int64)
    order = np.lexsort(p.T)
    new = np.concatenate([[True], (p[order][1:] != p[order][:-1]).any(axis=1)])
    own = np.empty(len(p), np.int64)
    own[order] = np.cumsum(new) - 1
    return p[order][new], own


def ranks(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, equal for equal ones."""
    return np.unique(values.to_numpy(), return_inverse=True)[1].reshape(-1)


def _salted(rows: DataFrame, guests: DataFrame, by: str) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with ``salt``: the guests of a tile that has over GUESTS are dealt, the rows at home repeated for each salt."""
    counts = guests.groupBy("tile").agg(F.count("*").alias("n")).filter(F.col("n") > GUESTS).collect()  # a row per tile at most
    if not counts:
        return rows.withColumn("salt", F.lit(0)), guests.withColumn("salt", F.lit(0)), False
    pairs = [x for r in counts for x in (F.lit(r["tile"]), F.lit(-(-r["n"] // GUESTS)))]
    salts = F.coalesce(F.create_map(*pairs)[F.col("tile")], F.lit(1))
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1))), guests.withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")), True


def nearest_of(queries: DataFrame, points: DataFrame, radius: float, coords: Sequence[str]) -> DataFrame:
    """(a, b, length): the nearest b up to radius from each a, of queries (a, coordinates) and points (b, coordinates); ties by b.

    Of points at one place only the one with the least b is searched.
    """
    cols = list(coords)
    rows = placed(queries.select("a", *cols), cols)
    places = placed(points.select("b", *cols), cols).groupBy(*cols).agg(F.min("b").alias("b"))
    places = checkpoint(places.select("b", *cols))
    cuts, n = cuts_of(rows, cols)
    guests = on_tiles(places, cuts, cols, radius)
    rows, guests, salted = _salted(on_tiles(rows, cuts, cols, 0.0), guests, "b")
    kind_a, kind_b = rows.schema["a"].dataType.simpleString(), places.schema["b"].dataType.simpleString()
    both = rows.select("a", F.lit(None).cast(kind_b).alias("b"), *cols, "tile", "salt").unionByName(guests.select(F.lit(None).cast(kind_a).alias("a"), "b", *cols, "tile", "salt"))

    def run(t: pa.Table) -> pa.Table:
        p = np.column_stack([t.column(c).to_numpy() for c in cols])
        guest = t.column("b").is_valid().to_numpy()
        home, other = np.flatnonzero(~guest), np.flatnonzero(guest)
        asked, own = distinct(p[home])
        names = ranks(t.column("b").take(pa.array(other))) if len(other) else np.empty(0, np.int64)
        best, far = np.full(len(asked), -1), np.zeros(len(asked))
        for i, j, d in search(asked, p[other], 1, radius):
            order = np.lexsort((names[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.concatenate([[True], i[1:] != i[:-1]])
            best[i[first]], far[i[first]] = j[first], d[first]
        got = np.flatnonzero(best[own] >= 0)
        return pa.table({"a": t.column("a").take(pa.array(home[got])), "b": t.column("b").take(pa.array(other[best[own[got]]])), "length": far[own[got]]})

    found = _by_tile(both, n, run, f"a {kind_a}, b {kind_b}, length double")
    if not salted:
        return found
    best = found.groupBy("a").agg(F.min(F.struct("length", "b")).alias("m"))
    return best.select("a", "m.b", "m.length")


def pairs_within(points: DataFrame, radius: float, coords: Sequence[str]) -> DataFrame:
    """(a, b, length) of all pairs a < b up to radius apart, of points (b, coordinates). They are returned as they are found and never held together."""
    cols = list(coords)
    rows = placed(points.select("b", *cols), cols)
    cuts, n = cuts_of(rows, cols, PAIRED)
    home, guests, _ = _salted(on_tiles(rows, cuts, cols, 0.0), on_tiles(rows, cuts, cols, radius), "b")
    both = home.withColumn("home", F.lit(True)).unionByName(guests.withColumn("home", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        p, at_home, names = np.column_stack([t.column(c).to_numpy() for c in cols]), t.column("home").to_numpy(), t.column("b").combine_chunks()
        order = ranks(t.column("b"))
        (asked, i_rows, i_from, i_n), (known, j_rows, j_from, j_n) = (_places_with(p, np.flatnonzero(side)) for side in (at_home, ~at_home))
        for i, j, d in search(asked, known, len(known) + 1, radius):
            pair, a = _spread(i_from[i], i_n[i])
            a, j, d = i_rows[a], j[pair], d[pair]
            ends = np.cumsum(j_n[j])
            first = 0
            while first < len(a):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BATCH, "right")))
                pair, b = _spread(j_from[j[first:last]], j_n[j[first:last]])
                u, v, length = a[first:last][pair], j_rows[b], d[first:last][pair]
                keep = order[u] < order[v]
                yield pa.record_batch({"a": names.take(pa.array(u[keep])), "b": names.take(pa.array(v[keep])), "length": length[keep]})
                first = last

    kind = rows.schema["b"].dataType.simpleString()
    return _by_tile(both, n, run, f"a {kind}, b {kind}, length double", PAIRED)


def linked(points: DataFrame, k: int, radius: float, coords: Sequence[str]) -> DataFrame:
    """(src, dst): edges with the components of the graph of each point's k nearest others up to radius away that have its label.

    points: (b, label, coordinates). Others of any label count among the k; distances are
    rounded to 6 places, and ties go to the smaller b. A tile's edges are united where they
    are found and leave it as a star for each component, so that they are no more than its points.
    At one place the k + 1 least b are all that anyone's neighbours can be.
    """
    cols = list(coords)
    rows = placed(points.select("b", "label", *cols).dropna(subset=["b"]), cols)
    cuts, n = cuts_of(rows, cols)
    least = rows.withColumn("r", F.row_number().over(W.partitionBy(*cols).orderBy("b"))).filter(F.col("r") <= k + 1).drop("r")
    # Those at home in a crowded tile are dealt, and each of its tasks has all its guests.
    guests, home, _ = _salted(on_tiles(least, cuts, cols, radius), on_tiles(rows, cuts, cols, 0.0), "b")
    both = home.withColumn("home", F.lit(True)).unionByName(guests.withColumn("home", F.lit(False)))

    def run(t: pa.Table) -> pa.Table:
        p, at_home = np.column_stack([t.column(c).to_numpy() for c in cols]), t.column("home").to_numpy()
        _, named, order = np.unique(t.column("b").to_numpy(), return_index=True, return_inverse=True)
        order = order.reshape(-1)
        label = t.column("label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        (asked, h_rows, h_from, h_n), (known, g_rows, g_from, g_n) = (_places_with(p, np.flatnonzero(side)) for side in (at_home, ~at_home))
        ends = [], []
        for i, j, d in search(asked, known, k + 1, radius, 2e-6):
            i, pos, row = _first(i, np.floor(d * 1e6 + 0.5), j, g_from, g_n, g_rows, order, k + 1)
            some, begin, many = np.unique(i, return_index=True, return_counts=True)
            place, h = _spread(h_from[some], h_n[some])
            h = h_rows[h]
            step = max(1, BATCH // (k + 1))
            for first in range(0, len(h), step):
                mine, at = h[first : first + step], place[first : first + step]
                a, e = _spread(begin[at], many[at])
                own = order[mine[a]] == order[row[e]]
                counted = np.zeros(len(mine), bool)
                counted[a[own]] = True
                keep = ~own & ((pos[e] < k) | counted[a]) & (label[mine[a]] == label[row[e]]) & (label[mine[a]] >= 0)
                ends[0].append(order[mine[a[keep]]])
                ends[1].append(order[row[e[keep]]])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in ends)
        root = united(len(named), u, v)
        node = np.flatnonzero(root != np.arange(len(root)))
        ids = t.column("b")
        return pa.table({"src": ids.take(pa.array(named[node])), "dst": ids.take(pa.array(named[root[node]]))})

    kind = rows.schema["b"].dataType.simpleString()
    return _by_tile(both, n, run, f"src {kind}, dst {kind}")


def _first(i: np.ndarray, far: np.ndarray, place: np.ndarray, begin: np.ndarray, n: np.ndarray, rows: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, position, row) of the first k rows at the places of each i, by far and then by order."""
    by = np.lexsort((far, i))
    i, far, place = i[by], far[by], place[by]
    new = np.concatenate([[True], i[1:] != i[:-1]])
    tie = new | np.concatenate([[True], far[1:] != far[:-1]])
    held = np.cumsum(n[place]) - n[place]
    before = held[np.maximum.accumulate(np.where(tie, np.arange(len(i)), 0))] - held[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
    i, far, place = i[before < k], far[before < k], place[before < k]
    pair, at = _spread(begin[place], n[place])
    i, far, row = i[pair], far[pair], rows[at]
    by = np.lexsort((order[row], far, i))
    i, row = i[by], row[by]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], i[1:] != i[:-1]]), np.arange(len(i)), 0))
    pos = np.arange(len(i)) - start
    return i[pos < k], pos[pos < k], row[pos < k]


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _places_with(p: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct points of some rows of p, those rows by place, and where each place's begin and how many they are."""
    places, own = distinct(p[rows])
    n = np.bincount(own, minlength=len(places))
    return places, rows[np.argsort(own, kind="stable")], np.cumsum(n) - n, n


def _spread(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, position) for the n[k] positions from begin[k] of each k."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + begin[k]


def _by_tile(rows: DataFrame, n: int, run: Callable, schema: str, tile: int | None = None) -> DataFrame:
    # A number of partitions of its own, as tiles are little data and much work.
    parts = max(1, min(MAX_TILES, 2 * -(-n // (tile or TILE))))
    return rows.repartition(parts, "tile", "salt").groupBy("tile", "salt").applyInArrow(run, schema)
