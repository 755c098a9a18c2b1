r"""Personal data by weak supervision, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; their
matches always stay. Wider patterns propose more spans: written-out e-mail addresses,
colon-separated IP addresses, cards with other separators, phone numbers without a plus
sign. Labelers vote on every proposed span, base or not: the base pattern, a gazetteer
(domains, issuers, country and area codes, routable networks), the words just before
it, its neighbours, and its digits. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability without labels. A logistic span classifier
is trained on the posteriors, from features of its own: the span's length, digits and
separators, what stands on either side, and the word before; spans it accepts are added.

Everything about a document is computed in its own row, by built-in expressions: texts
are not shuffled. The work is in proportion to a text's length and, but for running sums
in blocks and a binary search, to the number of its matches. What reaches the driver are
counts of vote patterns, at most ``len(KINDS) * 2 * 3 ** 4``, and of feature signatures,
at most ``len(KINDS) * 6 * 6 * 4 * 4 * 4 * 3``.

Defined cases: a null text counts as empty; ids pass through as they are, null or
repeated; an empty table gives an empty table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.util import checkpoint

KINDS = ("email", "ip", "card", "phone")
#: Patterns that start at a run of their first class only start there where they may: before it stands none of that class, or another match.
#: Possessive repeats match the same texts without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/\x20-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Gazetteers and context words.
DOMAINS = r"(?i)(com|org|net|edu|gov|info|io|dev|eu|de|fr|es|uk|it|nl|ch|at|be|pt|ca|us|mx|br|ar|cl|jp|cn|in|au)$"
ISSUERS = r"^(3[47]|4|5[1-5]|2[2-7]|6011|65|35)"
CODES = r"^(1[2-9]|33|34|49|44|39|31|41|43|32|351|52|54|55|56|61|81|86|91|[2-9][0-9]{2}[2-9])"
NETWORKS = r"^(?!0|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)"
CONTEXT = {
    "email": r"(?i)(mail|contact|kontakt|correo|courriel|write|reach)",
    "ip": r"(?i)(\bip\b|address|adresse|direcci|server|host|login|from)",
    "card": r"(?i)(card|karte|carte|tarjeta|visa|credit|payment|account)",
    "phone": r"(?i)(phone|tel|call|fax|mobil|cell|number|nummer|num[eé]ro)",
}
CONTEXT_CHARS = 24
ROUNDS, STEPS, RATE, RIDGE = 30, 400, 0.5, 1e-3
#: Posterior from which a proposed span is added.
ACCEPT = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for digits, at most 19 of them, that pass the Luhn check."""
    back = F.reverse(digits)
    term = lambda i: F.substring(back, 1, 1).cast("int") if i is None else back.substr(i + 1, F.lit(1)).cast("int") * (1 + F.pmod(i, F.lit(2)))
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + term(i) - F.when(term(i) > 9, 9).otherwise(0))
    return F.pmod(total, F.lit(10)) == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's base pattern stays."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    return n.between(10, 15)


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of pattern and the texts between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return hits, F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))


#: Matches whose running sum is carried at once.
RUN = 256


def _places(hits: Column, gaps: Column) -> Column:
    """Before each match, the code points of all matches and gaps before the gap in front of it: running sums, block by block. There may be one entry more than matches."""
    n = F.size(hits)
    part = lambda xs, b: F.slice(xs, b * RUN + 1, F.lit(RUN))
    steps = lambda b: F.zip_with(part(hits, b), part(gaps, b), lambda m, g: F.length(m) + F.length(g))
    blocks = F.when(n == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), steps))
    last = lambda xs: F.element_at(xs, -1)
    summed = lambda block, begin: F.aggregate(block, F.array(begin), lambda xs, x: F.concat(xs, F.array(last(xs) + x)))
    sums = F.aggregate(blocks, F.array(F.array(F.lit(0))), lambda done, block: F.concat(done, F.array(summed(block, last(last(done))))))
    return F.flatten(F.transform(F.slice(sums, F.lit(2), F.size(blocks)), lambda xs: F.slice(xs, F.lit(1), F.size(xs) - 1)))


def _spans(hits: Column, gaps: Column, make) -> Column:
    """An array of make(match, start, end, text before, text after)."""
    placed = F.slice(F.zip_with(hits, _places(hits, gaps), lambda m, p: F.struct(m.alias("m"), p.alias("p"))), F.lit(1), F.size(hits))

    def one(z: Column, i: Column) -> Column:
        start = z["p"] + F.length(F.get(gaps, i))
        return make(z["m"], start, start + F.length(z["m"]), F.get(gaps, i), F.get(gaps, i + 1))

    return F.transform(placed, one)


def _meets(span: Column, others: Column) -> Column:
    """Whether span overlaps one of others, which are in order and apart: a binary search for the last that begins before its end."""
    bits = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    fits = lambda n: (n <= F.size(others)) & (F.get(others, n - 1)["start"] < span["end"])
    n = F.aggregate(bits, F.lit(0), lambda at, bit: F.when(fits(at + bit), at + bit).otherwise(at))
    return F.coalesce(F.get(others, n - 1)["end"] > span["start"], F.lit(False))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1, or 0 for an abstention."""
    v = F.when(yes, F.lit("1"))
    return (v.when(no, F.lit("-")) if no is not None else v).otherwise(F.lit("0"))


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(m.rlike(DOMAINS), ~m.rlike(r"[A-Za-z]{2,}$"))
    if kind == "ip":
        return _vote(m.rlike(NETWORKS), F.lit(True))
    if kind == "card":
        return _vote(_digits(m).rlike(ISSUERS), F.lit(True))
    return _vote(_digits(m).rlike(CODES))


def _shape(kind: str, m: Column) -> Column:
    """Whether the digits or the length speak for the kind."""
    n = F.length(_digits(m))
    if kind == "email":
        return _vote(F.length(m).between(6, 64), F.length(m) > 254)
    if kind == "ip":
        return _vote(m.contains(":") | F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("double") <= 255, F.lit(False))), F.lit(True))
    if kind == "card":
        return _vote(F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False), F.lit(True))
    return _vote(n.between(10, 15), F.lit(True))


def _key(kind: str, base: bool, m: Column, before: Column, after: Column) -> Column:
    """The votes on a span, as one string."""
    context = _vote(F.right(before, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind]))
    alone = _vote(~F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}_]") & ~F.left(F.coalesce(after, F.lit("")), F.lit(1)).rlike(r"[\p{L}\p{N}_]"), F.lit(True))
    return F.concat(F.lit(kind + ":" + ("1" if base else "0")), _gazetteer(kind, m), context, alone, _shape(kind, m))


def _class(value: Column, bounds: tuple[int, ...]) -> Column:
    """The number of bounds that value reaches, as a digit."""
    return sum((value >= b).cast("int") for b in bounds).cast("string")


def _signature(kind: str, m: Column, before: Column, after: Column) -> Column:
    """The classifier's features of a span and its surroundings, a character each: length, digits, separators, what stands before and after, and the word before."""
    beside = lambda c: F.when(c.rlike(r"\p{L}"), "l").when(c.rlike(r"\p{N}"), "d").when(c.rlike(r"[^\s]"), "p").otherwise("s")
    marks = F.when(m.rlike(r"[(\[]"), "b").when(m.contains(" "), "s").when(m.rlike(r"[._/:-]"), "p").otherwise("n")
    near = F.right(before, F.lit(CONTEXT_CHARS))
    word = F.when(near.rlike(CONTEXT[kind]), "c").when(near.rlike(r"\p{L}"), "w").otherwise("n")
    parts = [_class(F.length(m), (8, 12, 16, 24, 40)), _class(F.length(_digits(m)), (1, 7, 10, 12, 16)), marks, beside(F.right(before, F.lit(1))), beside(F.left(F.coalesce(after, F.lit("")), F.lit(1))), word]
    return F.concat(F.lit(kind + ":"), *parts)


def proposed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with the arrays ``base`` and ``more`` of spans (start, kind number, end, votes, features)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = []
    for kind in KINDS:
        for what, pattern in (("base", BASE[kind]), ("more", WIDER[kind])):
            hits, gaps = _found(text, pattern)
            cols += [hits.alias(f"{what}_{kind}"), gaps.alias(f"{what}_{kind}_gaps")]
    rows = docs.select(F.col(id_col).alias("doc_id"), *cols)
    parts = []
    for i, kind in enumerate(KINDS):
        for what in ("base", "more"):

            def make(m, s, e, b, a, i=i, kind=kind, base=what == "base"):
                key = _key(kind, base, m, b, a)
                return F.struct(s.cast("int").alias("start"), F.lit(i).alias("kind"), e.cast("int").alias("end"), (F.when(_valid(kind, m), key) if base else key).alias("key"), _signature(kind, m, b, a).alias("sig"))

            parts.append(F.filter(_spans(F.col(f"{what}_{kind}"), F.col(f"{what}_{kind}_gaps"), make), lambda s: s["key"].isNotNull()).alias(f"{what}_{kind}"))
    rows = rows.select("doc_id", *parts)
    apart = lambda others: lambda s: ~_meets(s, others)
    clear = [F.filter(f"more_{kind}", apart(F.col(f"base_{kind}"))) for kind in KINDS]
    return rows.select("doc_id", F.array_sort(F.concat(*[f"base_{kind}" for kind in KINDS])).alias("base"), F.array_sort(F.concat(*clear)).alias("more"))


def _posteriors(counts: dict[str, int]) -> dict[str, float]:
    """Per kind, the probability of being personal data of each vote pattern: a two-class model of independent labelers, by expectation-maximisation."""
    out = {}
    for kind in KINDS:
        mine = sorted((k, n) for k, n in counts.items() if k.split(":")[0] == kind)
        votes = [k.split(":")[1] for k, _ in mine]
        post = [0.9 if v[0] == "1" else (0.6 if v[1:].count("1") > v[1:].count("-") + 1 else 0.2) for v in votes]
        for _ in range(ROUNDS if mine else 0):
            weight = [sum(n * (p if c else 1 - p) for (_, n), p in zip(mine, post, strict=True)) for c in (0, 1)]
            prior = [(w + 1) / (sum(weight) + 2) for w in weight]
            rate = {}
            for j in range(5):
                for value in "1-0":
                    for c in (0, 1):
                        seen = sum(n * (p if c else 1 - p) for (_, n), p, v in zip(mine, post, votes, strict=True) if v[j] == value)
                        rate[j, value, c] = (seen + 1) / (weight[c] + 3)
            # A vote may only count the way it was cast: reliabilities are held to be better than chance.
            post = []
            for v in votes:
                odds = math.log(prior[1] / prior[0])
                for j, value in enumerate(v):
                    x = math.log(rate[j, value, 1] / rate[j, value, 0])
                    odds += max(0.0, x) if value == "1" else min(0.0, x) if value == "-" else x
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        out |= dict(zip((k for k, _ in mine), post, strict=True))
    return out


def _parts(signature: str) -> list[str]:
    """The classifier's features: a constant and each character at its place, by kind."""
    kind, classes = signature.split(":")
    return [kind, *(f"{kind}{j}{c}" for j, c in enumerate(classes))]


def classifier(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of a logistic span classifier, trained on (signature, spans, sum of their posteriors)."""
    data = [(_parts(sig), post / n, math.log1p(n)) for sig, n, post in sorted(rows)]
    names = sorted({f for fs, _, _ in data for f in fs})
    number = {f: i for i, f in enumerate(names)}
    at = np.array([[number[f] for f in fs] for fs, _, _ in data], np.int64).reshape(len(data), -1)
    y, n = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(STEPS if len(data) else 0):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -30, 30)))
        error = n * (y - p) / n.sum()
        grad = np.bincount(at.ravel(), np.repeat(error, at.shape[1]), len(names)) - RIDGE * w
        squares += grad**2
        w += RATE * grad / np.sqrt(squares)
    return dict(zip(names, w.tolist(), strict=True))


def accepted(rows: list[tuple[str, int, float]]) -> list[str]:
    """The signatures whose spans the classifier takes."""
    w = classifier(rows)
    return sorted(sig for sig, _, _ in rows if sum(w[f] for f in _parts(sig)) >= math.log(ACCEPT / (1 - ACCEPT)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind number, end, votes, features) in order."""
    rows = checkpoint(proposed(docs, id_col, text_col))  # spans alone: the texts are read once
    spans = rows.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.key", "s.sig").count()
    patterns = spans.groupBy("key").agg(F.sum("count").alias("n"))
    posterior = _posteriors({r["key"]: r["n"] for r in patterns.collect()})
    if not posterior:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    learned = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(posterior.items()) for x in kv]), F.col("key"))
    signatures = spans.groupBy("sig").agg(F.sum("count").alias("n"), F.sum(F.col("count") * learned).alias("post"))
    good = accepted([(r["sig"], r["n"], r["post"]) for r in signatures.collect()])
    added = F.filter("more", lambda s: s["sig"].isin(good)) if good else F.filter("more", lambda s: F.lit(False))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def query(docs: DataFrame) -> DataFrame:
    rows = find(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    n = [F.size(F.filter(kinds, lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]  # noqa: B023
    return rows.select("doc_id", *n, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
