"""Best-fit packing of tokenised documents by swap-based local search.

Documents become ids of a public byte-level BPE vocabulary and an end id; longer ones
are cut into full pieces, the first taking the remainder. A full piece is a sequence
of its own. The others are dealt evenly over shards of SHARD pieces; in each shard a
best-fit-decreasing start is improved by moving documents and by exchanging one for
one or two for one between underfull sequences, each step increasing the sum of
squared fills, until sequences empty or no step is left. A step is looked for among all
underfull sequences. A task packs one shard after another, so the number of tasks stays
below TASKS at any size. What is still underfull in any shard is then pooled and packed
again.

Defined cases: a null or empty text is the end id alone; the vocabulary's special
strings are ids of their own, as the vocabulary file says; rows with a null or repeated
id are packed like any others; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.util import checkpoint

LIMIT = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces that are packed together, and tasks at most.
SHARD, TASKS = 16384, 8192
#: Sequences with this many places free or more are packed once more.
SLACK = 8


@cache
def _encoders(vocabulary: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [re.escape(t.content) for t in exact.get_added_tokens_decoder().values()]
    # What goes to the exact library: special strings, long blanks, and characters whose classes could differ.
    return exact, fast, re.compile("|".join([*special, rf"\s{{{LONG}}}", "[^\0-\x1b\x20-ɏ]"]))


#: Characters of a word or a blank from which a text isn't given to the fast library, whose patterns recurse.
LONG = 512


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids that ``tokenizers`` gives.

    Latin text without special strings or long runs goes through tiktoken with the same
    vocabulary: the same ids, four times as fast.
    """
    exact, fast, beyond = _encoders(vocabulary)
    if beyond.search(text) or (len(text) >= LONG and max(map(len, text.split()), default=0) >= LONG):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def _cutter(vocabulary: str, limit: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, text in enumerate(part.column(1)):
                    own = np.array([*encode(text.as_py() or "", vocabulary), end], "<u4")
                    a, b, k = 0, (len(own) - 1) % limit + 1, 0
                    while a < len(own):
                        row.append(r)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b].tobytes()))
                        if with_ids:
                            ids.append(own[a:b].astype(np.int32))
                        a, b, k = b, b + limit, k + 1
                out = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_cutter(vocabulary, limit, end, with_ids), kind)


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices. A bit mask of the free places in use finds the tightest bin."""
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask, bins = 0, []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        above = mask >> n
        if above:
            f = n + (above & -above).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                mask ^= 1 << f
        else:
            f, b = limit, len(bins)
            bins.append([])
        bins[b].append(int(i))
        free[f - n].append(b)
        mask |= 1 << (f - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Move and exchange documents between underfull bins, each step increasing the sum of squared fills.

    Starting from the emptiest bin, its documents go, in this order of preference, into
    another bin's free places, or there against one smaller document, or two of them
    against one document. Stops at the lower bound, or after a pass without a step.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    need = -(-sum(fill) // limit)
    moved = True
    while moved and sum(map(bool, bins)) > need:
        low = sorted((b for b in range(len(bins)) if 0 < fill[b] < limit), key=lambda b: fill[b])
        search = _Places(low, bins, size, fill, limit)
        moved = False
        for a in low:
            while bins[a] and search.step(a):
                moved = True
    return [b for b in bins if b]


class _Places:
    """Underfull bins by their free places, and their documents by what fits in their stead.

    A document of n places that leaves bin a raises the sum of squares where the other
    bin's free places, or those and the document that gives way, are n or more and under
    limit - fill of a + n. Entries that a step has made untrue are dropped when met; what
    a step has made true is found in the next pass.
    """

    def __init__(self, low: list[int], bins: list[list[int]], size: list[int], fill: list[int], limit: int):
        self.bins, self.size, self.fill, self.limit = bins, size, fill, limit
        self.rooms: list[list[int]] = [[] for _ in range(limit + 1)]
        self.slots: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
        for b in low:
            free = limit - fill[b]
            self.rooms[free].append(b)
            for s in {size[y] for y in bins[b]}:
                self.slots[free + s].append((-s, b))
        for slot in self.slots:
            slot.sort()  # the smallest document last

    def _span(self, a: int, n: int) -> range:
        return range(n, min(self.limit, self.limit - self.fill[a] + n - 1) + 1)

    def room(self, a: int, n: int) -> int | None:
        """A bin for n places of a, the tightest first."""
        for free in self._span(a, n):
            here = self.rooms[free]
            for k in range(len(here) - 1, -1, -1):
                b = here[k]
                if not self.bins[b] or self.limit - self.fill[b] != free:
                    here.pop(k)
                elif b != a:
                    return b
        return None

    def slot(self, a: int, n: int) -> tuple[int, int] | None:
        """A bin and its document, smaller than n, that gives way to n places of a."""
        for total in self._span(a, n):
            here = self.slots[total]
            for k in range(len(here) - 1, -1, -1):
                s, b = -here[k][0], here[k][1]
                if s >= n:
                    break
                if self.limit - self.fill[b] + s != total:
                    here.pop(k)
                    continue
                y = next((y for y in self.bins[b] if self.size[y] == s), None) if b != a else None
                if y is not None:
                    return b, y
        return None

    def step(self, a: int) -> bool:
        """One step that takes something out of bin a, if there is one."""
        own = {}
        for x in self.bins[a]:
            own.setdefault(self.size[x], []).append(x)
        sizes = sorted(own, reverse=True)
        for n in sizes:
            b = self.room(a, n)
            if b is not None:
                return self._exchange(a, own[n][:1], b, [])
            hit = self.slot(a, n)
            if hit is not None:
                return self._exchange(a, own[n][:1], hit[0], [hit[1]])
        tried = set()
        for i, m in enumerate(sizes):
            for n in sizes[i if len(own[m]) > 1 else i + 1 :]:
                if m + n <= self.limit and m + n not in tried:
                    tried.add(m + n)
                    hit = self.slot(a, m + n)
                    if hit is not None:
                        return self._exchange(a, own[m][:2] if m == n else [own[m][0], own[n][0]], hit[0], [hit[1]])
        return False

    def _exchange(self, a: int, xs: list[int], b: int, ys: list[int]) -> bool:
        for x in xs:
            self.bins[a].remove(x)
        for y in ys:
            self.bins[b].remove(y)
        self.bins[a] += ys
        self.bins[b] += xs
        gain = sum(self.size[x] for x in xs) - sum(self.size[y] for y in ys)
        self.fill[a] -= gain
        self.fill[b] += gain
        return True


def pack_lengths(lengths: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Bins of indices with lengths of at most limit in each."""
    return improve(best_fit(lengths, limit), lengths, limit)


def _shards(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition in tables of the given number; the last one may be smaller."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        while n >= rows:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:rows].reset_index(drop=True)
            held, n = [whole.iloc[rows:]], n - rows
    if n:
        yield pd.concat(held, ignore_index=True)


def _packer(limit: int, base: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_id = base + (TaskContext.get().partitionId() << 40)
        for shard in _shards(batches, rows):
            shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
            bins = pack_lengths(shard["length"].to_numpy(), limit)
            order = np.concatenate([np.array(b) for b in bins])
            sizes = np.array([len(b) for b in bins])
            out = shard.iloc[order].copy()
            length, number = out["length"].to_numpy(), np.repeat(np.arange(len(bins)), sizes)
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            before = np.cumsum(length) - length
            out["offset"] = before - before[first][number]
            out["fill"] = np.add.reduceat(length, first)[number]
            out["sequence_id"] = next_id + number
            next_id += len(bins)
            yield out

    return run


def _packed(rows: DataFrame, n: int, shard: int, limit: int, base: int) -> DataFrame:
    """rows dealt evenly over tasks, whatever their ids, and packed there in shards of at most shard rows."""
    plain = rows.drop("offset", "fill", "sequence_id")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", offset long, fill long, sequence_id long"
    return plain.repartition(max(1, min(TASKS, -(-n // shard)))).mapInPandas(_packer(limit, base, shard), kind)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    cut = checkpoint(pieces(docs, id_col, text_col, vocabulary, limit, end, with_ids))
    full = cut.filter(F.col("length") == limit).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    small = cut.filter(F.col("length") < limit)
    first = checkpoint(_packed(small, small.count(), shard, limit, 0))
    loose = first.filter(F.col("fill") <= limit - SLACK)
    again = _packed(loose, loose.count(), shard, limit, 1 << 62)
    cols = [*cut.columns, "sequence_id", "offset"]
    return full.select(cols).unionByName(first.filter(F.col("fill") > limit - SLACK).select(cols)).unionByName(again.select(cols))
