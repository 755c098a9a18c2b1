"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters other than x20 and x09-x0D, with a word mark in
front. Its best segmentation maximises the summed unigram scores of its pieces; a piece
of a public vocabulary scores minus the logarithm of its rank, in thousandths, and a
character without a piece counts as its UTF-8 bytes at BYTE each. Distinct pre-tokens
are inserted in a trie whose nodes hold the forward score and count of their prefix,
computed once for all pre-tokens that share it; where a pre-token ends its count is
stored. Ties go to fewer pieces.

The trie is each worker's own and starts anew beyond NODES nodes, as the stored counts
do beyond WORDS; prefixes over DEEP characters are computed without being stored. Neither changes a count.

Defined cases: a null or blank text has no tokens; ids pass through as they are; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
BYTE = -15000
NODES = 1 << 18
DEEP = 64
WORDS = 1 << 19

_PRETOKEN = re.compile(r"[^\x20\x09-\x0D]+")


@cache
def pieces(vocabulary: str = VOCABULARY) -> tuple[dict[str, int], int]:
    """Scores of the vocabulary's ordinary pieces, and the longest piece's length."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    found = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            found[sp.id_to_piece(i)] = -round(1000 * math.log(i + 1))
    return found, max(map(len, found))


class Trie:
    """Forward scores and counts of prefixes."""

    def __init__(self, scores: dict[str, int], longest: int):
        # Ends of pieces that are no pieces themselves map to None: a longer piece may end so. What is missing ends the search.
        self.ending: dict[str, int | None] = {p[k:]: None for p in scores for k in range(len(p))} | scores
        self.longest = longest
        self.ends: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        # Nodes are numbers; an edge's key is its node's number and its character, and a node's forward score and count are at its number.
        self.edges: dict[int, int] = {}
        self.score, self.pieces = [0], [0]

    def add(self, pretoken: str) -> int:
        """Pieces of the best segmentation of a pre-token that isn't stored yet."""
        if len(self.score) > NODES:
            self.reset()
        if len(self.ends) > WORDS:
            self.ends.clear()
        word, node, edges, ending, longest = MARK + pretoken, 0, self.edges, self.ending.get, self.longest
        score, count, size = [0], [0], len(word)
        deep = min(size, DEEP)
        codes = [ord(c) for c in word[:deep]]
        i = 0
        for c in codes:  # down the shared prefix
            child = edges.get(node << 21 | c)
            if child is None:
                break
            node = child
            score.append(self.score[node])
            count.append(self.pieces[node])
            i += 1
        for end in range(i + 1, size + 1):
            i = end - 1
            n = 1 if word[i] < "\x80" else len(word[i].encode())
            best, least = score[i] + BYTE * n, count[i] + n
            for j in range(i, max(-1, i - longest), -1):
                s = ending(word[j:end], 1)
                if s is None:
                    continue
                if s > 0:
                    break
                s += score[j]
                if s > best or (s == best and count[j] + 1 < least):
                    best, least = s, count[j] + 1
            score.append(best)
            count.append(least)
            if i < deep:
                edges[node << 21 | codes[i]] = node = len(self.score)
                self.score.append(best)
                self.pieces.append(least)
        if size <= DEEP:
            self.ends[pretoken] = count[size]
        return count[size]

    def count(self, pretokens: list[str]) -> int:
        """Pieces of all pre-tokens."""
        total, get = 0, self.ends.get
        for w in pretokens:
            n = get(w)
            if n is None:
                n = self.add(w)
            total += n
        return total


_TRIES: dict[str, Trie] = {}


def _counter(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _TRIES:
            _TRIES[vocabulary] = Trie(*pieces(vocabulary))
        trie = _TRIES[vocabulary]
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                own = _PRETOKEN.findall(text.as_py() or "")
                words.append(len(own))
                tokens.append(trie.count(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counter(vocabulary), f"doc_id {rows.schema[0].dataType.simpleString()}, n_pretokens long, n_tokens long")
