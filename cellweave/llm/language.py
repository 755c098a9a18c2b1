"""Language identification of words in code-switched text by a linear-chain CRF.

A word's features are its affixes, its letter n-grams and whether a lexicon of the
training words holds it; transitions between the languages of neighbouring words are
learned with them by maximising the conditional likelihood. Words get their marginals
by forward-backward, and a document the language with the largest mean marginal.

The model is fitted on a bounded sample: of each language about SAMPLE_DOCS labelled
documents, and of each SAMPLE_RUNS runs of RUN words, at places that a hash sets.
Chains that switch between languages are spliced from these runs, as the labels are
those of whole documents. Everything else covers every word: a document is one chain.
Its blocks of CHAIN words are multiplied out side by side, and messages between blocks
make their marginals those of the whole chain.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is
every text where no labelled document was given; a null id is never used for training
and is not held out; every label is learned, and over MAX_LANGUAGES of them are an error,
as a table of all transitions goes to every task.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

SAMPLE_DOCS, SAMPLE_RUNS, RUN = 300, 4, 48
MAX_LANGUAGES = 512
#: Words of a block of a chain; the results don't depend on it.
CHAIN = 64
#: Letters of a word at most; longer runs of letters are several words.
LETTERS = 24
BUCKETS = 1 << 15
LEXICON = 2000
#: Training chains have TRAIN words; a word starts another language with this probability.
TRAIN, SWITCH = 32, 0.06
EPOCHS, RATE, DECAY = 12, 0.25, 1e-5
SEED = 11
UNKNOWN = "und"

_WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed feature buckets of each word and the word's number for each of them."""
    chars = np.array(words, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    lens = (chars > 0).sum(axis=1)
    wide = np.zeros((len(words), LETTERS + 2), np.uint64)  # a mark before and after the word
    wide[:, 1:-1] = chars
    wide[:, 0] = 1
    wide[np.arange(len(words)), lens + 1] = 2
    full = lens + 2
    place, feats, owner = np.arange(LETTERS + 2), [], []
    code = np.zeros_like(wide)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            code = code[:, : LETTERS + 3 - n] * np.uint64(0x9E3779B97F4A7C15) + wide[:, n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
            ok = place[: LETTERS + 3 - n] <= (full - n)[:, None]
            r, c = np.nonzero(ok)
            h = code[r, c] + np.uint64(n)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            feats.append((h >> np.uint64(49)).astype(np.int32))
            owner.append(r.astype(np.int32))
            if n > 1:  # affixes: the n-grams at the marks, as features of their own
                first = np.flatnonzero(c == 0)
                last = np.flatnonzero(c == (full - n)[r])
                for at, salt in ((first, 0x5851F42D), (last, 0x14057B7E)):
                    feats.append((((h[at] + np.uint64(salt)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(49)).astype(np.int32))
                    owner.append(r[at].astype(np.int32))
    return np.concatenate(feats), np.concatenate(owner)


class Model:
    """Emission weights of hashed features and lexicon words, start and transition weights."""

    def __init__(self, languages: list[str]):
        self.languages, k = languages, len(languages)
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.lexicon: dict[str, int] = {}
        self.lexical = np.zeros((1, k), np.float32)
        self.start, self.moves = np.zeros(k, np.float32), np.zeros((k, k), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        k = len(self.languages)
        out = np.zeros((len(words), k), np.float32)
        for at in range(0, len(words), 20000):
            some = words[at : at + 20000]
            f, owner = _features(some)
            for c in range(k):
                out[at : at + len(some), c] = np.bincount(owner, self.weights[f, c], len(some))
        at = np.array([self.lexicon.get(w, -1) for w in words])
        out[at >= 0] += self.lexical[at[at >= 0]]
        return out


def marginals(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains (chains, words, languages) of the given lengths.

    Returns the words' marginals, zero beyond a chain's end, and the summed expected
    transitions. Messages are scaled at each word, so nothing under- or overflows.
    """
    s, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a0, m = np.exp(start - start.max()), np.exp(moves - moves.max())
    live = np.arange(t) < lengths[:, None]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = a0 * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
    beta[:, t - 1] = 1
    for i in range(t - 2, -1, -1):
        x = (e[:, i + 1] * beta[:, i + 1]) @ m.T
        x /= np.maximum(x.max(axis=1, keepdims=True), 1e-30)
        beta[:, i] = np.where(live[:, i + 1, None], x, 1)
    g = alpha * beta
    g /= np.maximum(g.sum(axis=2, keepdims=True), 1e-30)
    g *= live[:, :, None]
    pair = np.zeros((k, k))
    for i in range(1, t):
        x = alpha[:, i - 1, :, None] * m * (e[:, i] * beta[:, i])[:, None, :]
        x /= np.maximum(x.sum(axis=(1, 2), keepdims=True), 1e-30)
        pair += (x * live[:, i, None, None]).sum(axis=0)
    return g, pair


def fit(runs: list[tuple[str, list[str]]], seed: int = SEED) -> Model | None:
    """A model of labelled runs of words: stochastic ascent with adaptive steps on spliced chains."""
    runs = sorted((lang, words) for lang, words in runs if words)
    languages = sorted({lang for lang, _ in runs})
    if not languages:
        return None
    model, k, rng = Model(languages), len(languages), np.random.default_rng(seed)
    code = {lang: i for i, lang in enumerate(languages)}
    counts: dict[str, Counter] = {lang: Counter() for lang in languages}
    pools: list[list[str]] = [[] for _ in languages]
    for at in rng.permutation(len(runs)):
        lang, words = runs[at]
        counts[lang].update(words)
        pools[code[lang]] += words
    common = sorted({w for c in counts.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    model.lexicon = {w: i for i, w in enumerate(common)}
    model.lexical = np.zeros((max(1, len(common)), k), np.float32)
    vocabulary = sorted({w for p in pools for w in p})
    number = {w: i for i, w in enumerate(vocabulary)}
    pools_ = [np.array([number[w] for w in p]) for p in pools]
    feats, owner = _features(vocabulary)
    lexical = np.array([model.lexicon.get(w, -1) for w in vocabulary])
    chains = max(64, sum(map(len, pools)) // TRAIN)
    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.lexical, model.moves, model.start)]
    for epoch in range(EPOCHS):
        # Languages are drawn alike, and words in the order in which they stand in the runs.
        turn = rng.random((chains, TRAIN)) < SWITCH
        turn[:, 0] = True
        lang = rng.integers(0, k, (chains, TRAIN))
        source = np.maximum.accumulate(np.where(turn, np.arange(TRAIN), 0), axis=1)
        lang = np.take_along_axis(lang, source, axis=1)
        begin = np.take_along_axis(rng.random((chains, TRAIN)), source, axis=1)
        size = np.array([len(p) for p in pools_])
        at = (np.floor(begin * size[lang]).astype(int) + np.arange(TRAIN) - source) % size[lang]
        word = np.empty((chains, TRAIN), np.int64)
        for c in range(k):
            word[lang == c] = pools_[c][at[lang == c]]
        for some in np.array_split(np.arange(chains), max(1, chains // 256)):
            w, y = word[some], lang[some]
            used, spot = np.unique(w, return_inverse=True)
            spot = spot.reshape(w.shape)
            mine = np.zeros(len(vocabulary), bool)
            mine[used] = True
            keep = mine[owner]
            f, o = feats[keep], np.searchsorted(used, owner[keep])
            score = np.stack([np.bincount(o, model.weights[f, c], len(used)) for c in range(k)], axis=1)
            lex = lexical[used]
            score[lex >= 0] += model.lexical[lex[lex >= 0]]
            g, pair = marginals(score[spot], np.full(len(w), TRAIN), model.start, model.moves)
            truth = np.eye(k)[y]
            move = np.zeros((k, k))
            np.add.at(move, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            diff = truth - g
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, spot.ravel(), diff.reshape(-1, k))
            grad = np.stack([np.bincount(f, by_word[o, c], BUCKETS) for c in range(k)], axis=1)
            gl = np.zeros_like(model.lexical)
            gl[lex[lex >= 0]] = by_word[lex >= 0]
            for x, g_, sq in ((model.weights, grad, squares[0]), (model.lexical, gl, squares[1]), (model.moves, move - pair, squares[2]), (model.start, diff[:, 0].sum(axis=0), squares[3])):
                g_ = g_ / len(w) - DECAY * x
                sq += g_**2
                x += (RATE * g_ / np.sqrt(sq)).astype(np.float32)
    return model


def _sampler(places: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, key, text in zip(batch["lang"], batch["key"], batch["text"], strict=True):
                words = words_of(text)
                starts = range(0, len(words), RUN)
                some = np.random.default_rng(int(key) & 0x7FFFFFFF).permutation(len(starts))[:places]
                out += [(lang, words[starts[int(i)] : starts[int(i)] + RUN]) for i in sorted(some)]
            yield pd.DataFrame(out, columns=["lang", "words"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, seed: int = SEED) -> Model | None:
    """Fit on labelled documents that are not held out: at most about sample_docs of each language reach the driver, as runs of words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    labels = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if not labels:
        return None
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    # A hash below a language's share picks its documents; 1.25 makes too few of them unlikely.
    share = {r["lang"]: min(1 << 30, int((1 << 30) * 1.25 * sample_docs / r["count"]) + 1) for r in labels}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    rows = rows.filter(F.col("lang").isin(list(share))).withColumn("key", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)))
    runs = rows.filter(F.col("text").isNotNull() & (F.col("key") < limit)).select("lang", "key", "text").mapInPandas(_sampler(SAMPLE_RUNS), "lang string, words array<string>")
    return fit([(r["lang"], list(r["words"])) for r in runs.collect()], seed)


class _Reader:
    """Applies a model to texts; remembers the emissions of up to KEEP words."""

    KEEP = 1 << 18

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.empty((0, len(model.languages)), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.KEEP:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            for w in new:
                known[w] = len(known)
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def blocks(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers, and of each block its text, first word and length, and whether it begins its text."""
        flat = self.numbers([w for t in texts for w in t])
        counts = np.array([len(t) for t in texts])
        n = -(-counts // CHAIN)
        owner = np.repeat(np.arange(len(texts)), n)
        base = np.concatenate(([0], np.cumsum(counts)[:-1]))
        nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return flat, owner, base[owner] + nth * CHAIN, np.minimum(CHAIN, counts[owner] - nth * CHAIN), nth

    def marginals(self, texts: list[list[str]], each: bool = False):
        """The summed marginals of each text's words; with ``each``, the marginals of all words instead."""
        k, m = len(self.model.languages), self.model
        flat, owner, begin, lengths, nth = self.blocks(texts)
        into, back = np.ones((len(owner), k)), np.ones((len(owner), k))
        move = np.exp(m.moves - m.moves.max()).astype(np.float64)
        into[nth == 0] = np.exp(m.start - m.start.max())
        step = max(1, min(4096, (1 << 23) // (CHAIN * k)))

        def scores(c: np.ndarray) -> np.ndarray:
            spot = np.minimum(begin[c][:, None] + np.arange(int(lengths[c].max())), len(flat) - 1)
            return self.table[flat[spot]]

        long = np.flatnonzero(np.isin(owner, owner[nth > 0]))  # the blocks of texts that have several
        if len(long):
            product = np.empty((len(long), k, k))
            for at in range(0, len(long), max(1, step // k)):
                c = long[at : at + max(1, step // k)]
                product[at : at + len(c)] = _products(scores(c), lengths[c], move)
            place = np.full(len(owner), -1)
            place[long] = np.arange(len(long))
            most = int(nth.max())
            for i in range(1, most + 1):  # what comes into a block from those before it
                c = np.flatnonzero(nth == i)
                x = np.einsum("ca,cab->cb", into[c - 1], product[place[c - 1]]) @ move
                into[c] = x / x.sum(axis=1, keepdims=True)
            for i in range(most, 0, -1):  # and from those after it
                c = np.flatnonzero(nth == i)
                x = np.einsum("cab,cb->ca", product[place[c]], back[c]) @ move.T
                back[c - 1] = x / x.sum(axis=1, keepdims=True)
        out = np.zeros((len(flat) if each else len(texts), k))
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), step):
            c = order[at : at + step]
            g = _word_marginals(scores(c), lengths[c], into[c], back[c], move, each)
            if each:
                live = np.arange(g.shape[0])[:, None] < lengths[c]
                i, j = np.nonzero(live)
                out[begin[c][j] + i] = g[i, j]
            else:
                np.add.at(out, owner[c], g)
        return out


def _products(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Of each block the matrix that takes a message on its first word to one on its last, scaled: emissions, and moves between them."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    c, t, k = e.shape
    out = np.eye(k) * e[:, 0, None, :]
    for i in range(1, t):
        x = (out @ move) * e[:, i, None, :]
        x /= np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-300)
        out = np.where((lengths > i)[:, None, None], x, out)
    return out


def _word_marginals(scores: np.ndarray, lengths: np.ndarray, into: np.ndarray, back: np.ndarray, move: np.ndarray, each: bool = False) -> np.ndarray:
    """The marginals of blocks, (words, blocks, languages) or summed over each block's words.

    into: the message on a block's first word, before its emission; back: that on its last word from what follows.
    """
    e = np.ascontiguousarray(scores.transpose(1, 0, 2))
    e -= e.max(axis=2, keepdims=True)
    np.exp(e, out=e)
    t, s, k = e.shape
    m = move.astype(e.dtype)
    alpha = np.empty_like(e)
    alpha[0] = into * e[0]
    alpha[0] /= np.maximum(alpha[0].sum(axis=1, keepdims=True), 1e-30)
    for i in range(1, t):
        x = alpha[i - 1] @ m
        x *= e[i]
        x /= np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
        alpha[i] = x
    out, end = np.zeros((t, s, k) if each else (s, k)), (back / back.max(axis=1, keepdims=True)).astype(e.dtype)
    beta = end
    for i in range(t - 1, -1, -1):
        if i < t - 1:
            x = (e[i + 1] * beta) @ m.T
            x /= np.maximum(x.max(axis=1, keepdims=True), 1e-30)
            beta = np.where((lengths > i + 1)[:, None], x, end)
        g = alpha[i] * beta
        g /= np.maximum(g.sum(axis=1, keepdims=True), 1e-30)
        g[lengths <= i] = 0
        if each:
            out[i] = g
        else:
            out += g
    return out


_READERS: dict[str, _Reader | None] = {}


def _reader(shared, tag: str) -> _Reader | None:
    """The worker's reader of a model."""
    if tag not in _READERS:
        _READERS.clear()
        _READERS[tag] = _Reader(shared.value) if shared.value is not None else None
    return _READERS[tag]


def _slices(batches: Iterator[pa.RecordBatch], text: str | None):
    """Slices of batches with their texts' words, which are in the row or, where text is None, beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            column = part.column(1) if text is None else part.column(0).field(text)
            yield part, [words_of(x) for x in column.to_pylist()]


def _predictor(shared, tag: str, text: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared, tag)
        for part, texts in _slices(batches, text):
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if reader is not None and any(texts):
                sums = reader.marginals(texts)
                for i, t in enumerate(texts):
                    if t and any(c.isalpha() for w in t for c in w):
                        best = int(sums[i].argmax())
                        pred[i], score[i] = reader.model.languages[best], min(1.0, sums[i, best] / len(t))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def _labeller(shared, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared, tag)
        for part, texts in _slices(batches, None):
            if reader is None or not any(texts):
                continue
            g = reader.marginals(texts, each=True)
            best = g.argmax(axis=1)
            counts = np.array([len(t) for t in texts])
            at = np.repeat(np.arange(len(texts)), counts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = [part.column(0).take(pa.array(at)), pa.array(nth), pa.array([w for t in texts for w in t], pa.string()), pa.array(reader.model.languages).take(pa.array(best)), pa.array(g[np.arange(len(g)), best])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "nth", "word", "lang", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """row (a struct of docs' own columns, or of those to keep), lang_pred, score. A text goes to Python once, and comes back only in a row."""
    own = list(docs.columns if keep is None else keep)
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    inside = text_col in own
    rows = docs.select(row) if inside else docs.select(row, F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([rows.schema["row"]]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(_predictor(shared, uuid.uuid4().hex, text_col if inside else None), kind)


def label_words(docs: DataFrame, model: Model | None, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per word: row (a struct of the columns to keep), nth from 0, word, lang and score, its marginal. Texts without words give no row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([rows.schema["row"]]).add("nth", LongType()).add("word", StringType()).add("lang", StringType()).add("score", DoubleType())
    return rows.mapInArrow(_labeller(shared, uuid.uuid4().hex), kind)


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(docs), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


#: A document stays if its language's share of the words is at least this.
KEEP_SCORE = 0.3


def keep_known(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in a known language."""
    found = identify(docs, train(docs, id_col, text_col, lang_col), text_col)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= KEEP_SCORE)).select("row.*")
