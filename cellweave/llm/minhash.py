"""Near-duplicates by b-bit MinHash.

Each text's set of word shingles gets K minima, in bands that give the
candidate buckets (more and shorter ones for thresholds under 85 %); the low B bits of the minima are packed into a signature, and the
similarity of a candidate pair is estimated from the count of equal B-bit groups,
corrected for chance agreement. What passes the estimate is confirmed on full sets.

Pairs are never all emitted. Equal sets are merged first. In a first round every row
of a bucket offers its best few neighbours only; confirmed links are joined into
components. In a second round pairs within a component need no test; all others that
pass the estimate are tested on full sets inside their bucket, which emits only the
links that join components. A hot bucket is one task's work in neither round: the
first salts buckets over SLICE rows by id, each salt holding the bucket's leader too,
so that what is near the leader is joined across salts; the second deals buckets over
CELL rows or CELL_SHINGLES out to cells of at most two slices, with bounded memory and
no pair left out. Joins on a bucket, a digest or a leader are salted where it is hot.

Texts are read again only where a pair needs them: the ids that do are broadcast while
they are few, and joined by a shuffle of texts beyond that.

Defined cases: a null or wordless text has n_shingles 0 and links with nothing; a row
whose id is null links with nothing, has a null component and is kept; rows that share
an id count as one document in the links; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shingles import coefficients, mix, shingle_sets
from cellweave.operators.components import connected_components
from cellweave.skew import SLICE, dealt, having, hot_keys, lacking, repeated
from cellweave.util import checkpoint, release

K, B, ROWS = 144, 4, 6
BANDS = K // ROWS
#: Minima and rows of a band below LOWER percent: at 80, 32 bands of 5 miss 3e-6 of the pairs, where 24 of 6 would miss 7e-4.
LOWER, LOWER_K, LOWER_ROWS = 85, 160, 5
#: Of the estimate, as K minima of B bits give it near the threshold; pairs are dropped this many below it.
DEVIATIONS = 4.0
#: Neighbours in a sorted bucket that the first round looks at.
REACH = 16
#: Rows of a bucket that one cell of the second round takes from a slice.
CELL = 4096
#: Shingles of a bucket that one cell takes from a slice.
CELL_SHINGLES = 1 << 21


def shape(percent: int) -> tuple[int, int]:
    """Minima, and rows of a band, for a threshold."""
    return (K, ROWS) if percent >= LOWER else (LOWER_K, LOWER_ROWS)


@cache
def _coefficients(k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = (coefficients(k, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return a, (coefficients(k, 4) >> np.uint64(32)).astype(np.uint32), coefficients(rows, 5)


def signature(sets: list[np.ndarray], count: int = K, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (count * B / 8 bytes a row) and band keys of nonempty sets."""
    mul, add, band = _coefficients(count, rows)
    sizes = np.array([len(s) for s in sets])
    minima = np.empty((len(sets), count), np.uint32)
    i = 0
    while i < len(sets):  # a few sets at a time, so that the work stays in the cache
        j, n = i + 1, sizes[i]
        while j < len(sets) and n + sizes[j] <= 32768:
            n += sizes[j]
            j += 1
        x = np.concatenate([(s >> np.uint64(32)).astype(np.uint32) for s in sets[i:j]])
        at = np.concatenate(([0], np.cumsum(sizes[i:j])[:-1]))
        for k in range(count):
            minima[i:j, k] = np.minimum.reduceat(x * mul[k] + add[k], at)
        i = j
    low = (minima & np.uint32((1 << B) - 1)).astype(np.uint8)
    packed = low[:, ::2] | (low[:, 1::2] << np.uint8(B))
    wide = minima.reshape(len(sets), count // rows, rows).astype(np.uint64)
    keys = mix((wide * band).sum(axis=2, dtype=np.uint64) + np.arange(count // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.ascontiguousarray(packed), keys.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from signatures (rows of uint64), corrected for collisions of B bits."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    other = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance, k = 2.0**-B, a.shape[-1] * 64 // B
    return ((k - other) / k - chance) / (1 - chance)


def cut(similarity: float, k: int = K) -> float:
    chance = 2.0**-B
    c = chance + (1 - chance) * similarity
    return similarity - DEVIATIONS * (c * (1 - c) / k) ** 0.5 / (1 - chance)


def _features(count: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digests, sets, rows = np.zeros(part.num_rows, np.int64), [None] * part.num_rows, [], []
                for k, s in enumerate(shingle_sets(part.column(1))):
                    if len(s):
                        n[k], digests[k] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        sets.append(s)
                        rows.append(k)
                sig, keys = [None] * part.num_rows, [None] * part.num_rows
                if sets:
                    packed, bands = signature(sets, count, width)
                    for r, p, q in zip(rows, packed, bands, strict=True):
                        sig[r], keys[r] = p.tobytes(), q
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digests, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "digest", "sig", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in shingle_sets(part.column(1))], pa.list_(pa.int64()))], ["id", "shingles"])


def _runs_of(batches: Iterator[pa.RecordBatch], width: int):
    """Whole runs of equal keys of a sorted partition, gathered to batches; ``width`` leading columns make the key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(width))
        same = np.ones(batch.num_rows, bool)
        for c in range(width):
            same &= np.asarray(batch.column(c)) == last[c]
        begin = int(np.argmax(same)) if same.any() else batch.num_rows  # sorted, so the last run is one stretch
        whole = begin > 0 or (kept and tuple(kept[-1].column(c)[kept[-1].num_rows - 1].as_py() for c in range(width)) != last)
        if whole:
            yield pa.Table.from_batches([*kept, batch.slice(0, begin)]).combine_chunks()
            kept = [batch.slice(begin)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _words(column) -> np.ndarray:
    """Fixed-width binary values as rows of uint64."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(len(column), -1)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _near(least: float, percent: int):
    """First round: each row with its best of the REACH next rows of its bucket, and with the bucket's first row.

    The run is read batch by batch: memory is that of a batch, whatever a bucket's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None  # the last REACH rows
        lead = None  # the first row of the run that the tail ends with
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([tail, batch] if tail is not None else [batch]).combine_chunks()
            old = tail.num_rows if tail is not None else 0
            key, ids, n = (np.asarray(t.column(c)) for c in range(3))
            sig = _words(t.column(3))
            total = len(key)
            best, mate = np.full(total, -1.0), np.zeros(total, np.int64)
            for s in range(1, min(REACH, total - 1) + 1):
                i = np.flatnonzero(key[:-s] == key[s:])
                if not len(i):
                    break
                i = i[i + s >= old]  # pairs within the tail have been seen
                j = i + s
                e = estimated(sig[i], sig[j])
                e[(100 * np.minimum(n[i], n[j]) < percent * np.maximum(n[i], n[j])) | (ids[i] == ids[j])] = -1
                for p, q in ((i, j), (j, i)):
                    up = e > best[p]
                    best[p[up]], mate[p[up]] = e[up], q[up]
            at = np.flatnonzero(best >= least)
            if len(at):
                yield _pairs(ids[at], ids[mate[at]])
            first = np.concatenate(([True], key[1:] != key[:-1]))
            head = np.maximum.accumulate(np.where(first, np.arange(total), 0))
            i = np.arange(old, total)
            hid, hn, hsig = ids[head[i]].copy(), n[head[i]].copy(), sig[head[i]].copy()
            if lead is not None:
                on = (head[i] == 0) & (key[i] == lead[0])
                hid[on], hn[on], hsig[on] = lead[1], lead[2], lead[3]
            good = (estimated(sig[i], hsig) >= least) & (ids[i] != hid) & (100 * np.minimum(n[i], hn) >= percent * np.maximum(n[i], hn))
            if good.any():
                yield _pairs(ids[i[good]], hid[good])
            z = head[total - 1]
            lead = lead if lead is not None and z == 0 and lead[0] == key[0] else (key[z], ids[z], n[z], sig[z].copy())
            tail = t.slice(max(0, total - REACH)).to_batches()[0]

    return run


class _Cell:
    """The rows of one cell: a bucket, or two slices of a large one.

    A pair belongs to the first band in which its documents meet; other cells pass it by.
    """

    def __init__(self, t: pa.Table, percent: int, least: float):
        take = lambda name: np.asarray(t.column(name))
        self.ids, self.n, self.comp, self.part = take("id"), take("n"), take("comp"), take("part")
        self.band, self.across = int(t.column("band")[0].as_py()), t.column("lo")[0] != t.column("hi")[0]
        self.sig = _words(t.column("sig"))
        bands = t.column("bands").combine_chunks()
        self.bands = np.asarray((bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands).flatten()).reshape(len(self.ids), -1)[:, : self.band]
        self.percent, self.least = percent, least

    def partners(self, i: int, comp: np.ndarray) -> np.ndarray:
        """The rows after i that are of another component, near enough in size and by estimate, and meet i here first."""
        j = np.arange(i + 1, len(self.ids))
        good = (comp[j] != comp[i]) & (100 * np.minimum(self.n[j], self.n[i]) >= self.percent * np.maximum(self.n[j], self.n[i]))
        if self.across:
            good &= self.part[j] != self.part[i]
        j = j[good]
        if len(j):
            j = j[estimated(self.sig[j], self.sig[i]) >= self.least]
        return j[~(self.bands[j] == self.bands[i]).any(axis=1)] if len(j) else j


def _cells(batches: Iterator[pa.RecordBatch]):
    """The table of each cell of a sorted partition."""
    for t in _runs_of(batches, 3):
        key, lo, hi = (np.asarray(t.column(c)) for c in range(3))
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        for x, y in zip(new, [*new[1:], len(key)], strict=True):
            if y - x > 1:
                yield t.slice(x, y - x)


def _unsettled(least: float, percent: int):
    """Of each cell the rows that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            cell = _Cell(t, percent, least)
            keep = np.zeros(len(cell.ids), bool)
            for i in range(len(cell.ids) - 1):
                j = cell.partners(i, cell.comp)
                if len(j):
                    keep[i] = True
                    keep[j] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _settled(least: float, percent: int):
    """Of each cell links, confirmed on full sets, that join all of its components that are linked here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            cell = _Cell(t, percent, least)
            sets = [np.asarray(x.values) for x in t.column("shingles")]
            begin = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark, comp, a, b = np.zeros(int(codes.max()) + 1, np.int64), cell.comp.copy(), [], []
            for i in range(len(cell.ids) - 1):
                j = cell.partners(i, comp)
                if not len(j):
                    continue
                mark[codes[begin[i] : begin[i + 1]]] = 1
                for k in range(0, len(j), 256):
                    some = j[k : k + 256]
                    both = np.add.reduceat(mark[np.concatenate([codes[begin[x] : begin[x + 1]] for x in some])], np.concatenate(([0], np.cumsum(cell.n[some])[:-1])))
                    for x in some[100 * both >= percent * (cell.n[some] + cell.n[i] - both)]:
                        if comp[x] != comp[i]:
                            comp[comp == comp[x]] = comp[i]
                            a.append(cell.ids[i])
                            b.append(cell.ids[x])
                mark[codes[begin[i] : begin[i + 1]]] = 0
            if a:
                yield _pairs(np.array(a), np.array(b))

    return run


def _confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. rows: id, text.

    A document that is in very many pairs, as a hot bucket's leader is, is joined by salts.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("times"))
    need = checkpoint(need)
    sets = having(rows, need.select("id"), "id").mapInArrow(_sets, "id long, shingles array<long>")
    sets = checkpoint(sets)
    hot = hot_keys(need, "id", "times", 2 * pairs.count(), SLICE)
    out, both = pairs, F.size(F.array_intersect("s_a", "s_b"))
    for side, other in ("ab", "ba"):
        own = repeated(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"s_{side}")), hot, side)
        out = dealt(out, hot, side, F.col(other)).join(own, [side, "__salt"]).drop("__salt")
    return out.filter(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= percent * union of their full sets;
    component_id is the smallest id reachable by links, kept marks doc_id = component_id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Checkpointed, so that the numbers of its rows are fixed.
    found = checkpoint(rows.mapInArrow(_features(*shape(percent)), "id long, n long, digest binary, sig binary, bands array<long>")).withColumn("row", F.monotonically_increasing_id())
    sound = found.filter("digest is not null and id is not null")
    # Most digests have one row, which stands for itself; of the others the row with the least id does.
    copies = sound.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    copies = checkpoint(copies.select("digest", F.col("first.id").alias("rep"), F.col("first.row").alias("rep_row"), "rows"))
    twin = hot_keys(copies, "digest", "rows", found.count(), SLICE)
    sets = dealt(found.select("id", "n", "digest", "row"), twin, "digest", F.col("row")).join(repeated(copies.drop("rows"), twin, "digest"), ["digest", "__salt"], "left")
    known = F.col("id").isNotNull() & F.col("digest").isNotNull()
    sets = checkpoint(sets.select("id", "n", F.when(known, F.coalesce("rep", "id")).alias("rep"), "row", F.when(known, F.col("row") != F.coalesce("rep_row", "row")).alias("copy")))
    lone = checkpoint(lacking(sound, sets.filter("copy").select(F.col("row").alias("r")), F.col("row") == F.col("r")).drop("row"))
    release(found)
    least = cut(percent / 100, shape(percent)[0])
    narrow = lone.select("id", "n", F.posexplode("bands").alias("band", "key"))
    busy = checkpoint(narrow.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("head")).filter("rows > 1"))
    total = busy.agg(F.sum("rows")).first()[0] or 0
    hot = hot_keys(busy, "key", "rows", total, SLICE)
    sized = busy.select("key", "head", F.ceil(F.col("rows") / SLICE).cast("int").alias("salts"))
    multi = dealt(narrow, hot, "key", F.col("id")).join(repeated(sized, hot, "key"), ["key", "__salt"])
    multi = multi.withColumn("leads", (F.col("salts") > 1) & (F.col("id") == F.col("head"))).drop("head", "__salt")
    multi = checkpoint(multi)  # buckets of one row are most, and have gone here
    salt = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")))
    salted = multi.withColumn("salt", F.explode(salt)).withColumn("run", F.when(F.col("salts") > 1, F.xxhash64("key", "salt")).otherwise(F.col("key")))
    met = checkpoint(multi.select("id").distinct())
    features = checkpoint(having(lone.select("id", "sig", "bands"), met, "id"))
    banded = salted.join(features.select("id", "sig"), "id").select("run", "id", "n", "sig", "leads")
    first = banded.repartition("run").sortWithinPartitions("run", F.desc("leads"), "n", "id").select("run", "id", "n", "sig").mapInArrow(_near(least, percent), "a long, b long")
    tested = checkpoint(first.distinct())
    links = checkpoint(_confirmed(tested, rows, percent))
    comps = connected_components(links, "a", "b")

    spread = multi.join(comps, multi.id == comps.node, "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("comp"))
    open_ = spread.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("rows"), F.sum("n").alias("size")).filter("c0 <> c1")
    open_ = checkpoint(open_.select("key", F.ceil(F.greatest(F.col("rows") / CELL, F.col("size") / CELL_SHINGLES)).cast("int").alias("slices")))
    cells = dealt(spread, hot, "key", F.col("id")).join(repeated(open_, hot, "key"), ["key", "__salt"]).drop("__salt")
    cells = cells.join(features, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = cells.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "band", "id", "n", "comp", "part", "sig", "bands")
    cell = ["key", "lo", "hi"]
    kind = "key long, lo int, hi int, band int, id long, n long, comp long, part int, sig binary, bands array<long>"
    unsettled = checkpoint(cells.repartition(*cell).sortWithinPartitions(*cell, "id").mapInArrow(_unsettled(least, percent), kind))
    if not unsettled.isEmpty():
        full = having(rows, unsettled.select("id").distinct(), "id").mapInArrow(_sets, "id long, shingles array<long>")
        rows_ = unsettled.join(full, "id").select(*unsettled.columns, "shingles")
        more = checkpoint(rows_.repartition(*cell).sortWithinPartitions(*cell, "id").mapInArrow(_settled(least, percent), "a long, b long").distinct())
        links = links.unionByName(more)
        comps = connected_components(links, "a", "b")

    # An id in several rows is one node: its sets' representatives and itself belong together.
    shared = sets.filter("rep is not null").groupBy("id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 <> r1")
    if not shared.isEmpty():
        ties = sets.join(shared, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        comps = connected_components(links.unionByName(ties), "a", "b")
    out = sets.join(comps, sets.rep == comps.node, "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group the document with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return lacking(docs, gone, F.col(f"`{id_col}`") == F.col("__gone"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
u AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
m AS (SELECT s.doc_id, len(s.s) AS n, u.rep FROM s LEFT JOIN u ON list_sort(s.s) = u.s),
x AS (SELECT rep, n, unnest(s) AS g FROM u),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT rep, rep FROM u UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM m LEFT JOIN c ON m.rep = c.node
"""
