import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import DATA, agree
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import chat, exact_dedup, graph_dedup, language, minhash, mixing, packing, pii, queries, sharding, tokens
from cellweave.llm.shingles import _hash_block, shingle_sets, word_hashes


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_beside_its_sql(spark, name):
    agree(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def table(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# Exact dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = by[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd, weak):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    digest = (lambda t: (F.length(t) % 3).cast("string")) if weak else exact_dedup.sha256  # equal digests of other texts
    got = sorted((tuple(r) for r in exact_dedup.assign(odd, digest=digest).collect()), key=repr)
    assert got == exact_brute(rows)


def test_exact_dedup_keeps_one_row(odd, empty):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert Counter(texts) == Counter({normal(r["text"]) for r in odd.collect()})
    assert exact_dedup.keep_one(empty).count() == 0 and exact_dedup.assign(empty).count() == 0


# MinHash


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = {i: i for i, _ in sets if i is not None}
    linked = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in ids:
        for a, b in linked:
            ids[a] = ids[b] = min(ids[a], ids[b])
    return sorted(((i, len(s), ids.get(i), i is None or ids[i] == i) for i, s in sets), key=repr)


def varied(seed=0, n=60):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 40, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"w{r.randrange(400)}"
        rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_near_dedup_matches_brute_force(spark):
    for seed in (0, 1):
        rows = varied(seed)
        got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
        assert got == near_brute(rows)


def test_near_dedup_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in minhash.near_duplicates(odd).collect()), key=repr)
    assert got == near_brute(rows)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(odd).columns == odd.columns


def test_near_dedup_in_cells(spark, monkeypatch):
    """Buckets dealt out to cells lose no link."""
    monkeypatch.setattr(minhash, "CELL", 5)
    monkeypatch.setattr(minhash, "REACH", 1)
    rows = varied(3, 80)
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == near_brute(rows)


def test_near_dedup_in_salts(spark, monkeypatch):
    """A hot bucket's salts are joined through its leader, also where rows share the leader's id."""
    monkeypatch.setattr(minhash, "SLICE", 3)
    rows = varied(5, 80) + [(1000 + k, f"{k} " + " ".join(f"w{i}" for i in range(60))) for k in range(40)]
    rows += [(rows[0][0], "another text under the same id as the first row has")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == near_brute(rows)
    assert len({r[2] for r in got if r[0] and r[0] >= 1000}) == 1


def test_pipeline_stage_finds_pairs_from_80_percent(spark):
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(100)]
        for j, cut in enumerate((0, 9, 17)):  # similarities 1, 87/105 and 79/113 to the first, as 9 or 17 words at the end differ
            rows.append((10 * k + j, " ".join(words[: 100 - cut] + [f"v{k}x{j}x{i}" for i in range(cut)]), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    gone = {i for i, _, _ in rows} - {r["doc_id"] for r in corpus_pipeline.near(spark, docs, DATA).collect()}
    want = {r[0] for r in near_brute([r[:2] for r in rows], 80) if not r[3]}
    assert gone == want and {10 * k + 1 for k in range(20)} <= want
    assert not any(not r[3] for r in near_brute([r[:2] for r in rows], 85))


def test_shingles_of_blocks_and_long_words():
    import pyarrow as pa

    texts = ["a b c d e f", None, "", "É a A É", "y" * 3000 + " z", "one two"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    raw = np.frombuffer(("word " * 400000 + "q" * 2000000 + " end").encode(), np.uint8)
    assert len(word_hashes(raw)) == 400002 and np.array_equal(word_hashes(raw[:500000]), _hash_block(raw[:500000]))


def test_b_bit_estimate():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.85, 0.95):
        common = rng.integers(0, 1 << 63, int(4000 * j)).astype(np.uint64)
        rest = rng.integers(0, 1 << 63, (2, (4000 - len(common)) // 2)).astype(np.uint64)
        packed, _ = minhash.signature([np.concatenate([common, r]) for r in rest])
        a, b = packed.view(np.uint64)
        assert abs(minhash.estimated(a[None], b[None])[0] - j) < 0.13


# Packing


def test_pack(spark, odd, empty):
    for docs in (odd, table(spark)):
        made = [r.asDict() for r in packing.pack(docs, with_ids=True).collect()]
        by = {}
        for r in made:
            assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
            by.setdefault(r["sequence_id"], []).append(r)
        for parts in by.values():
            at = 0
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= packing.LIMIT
        want = Counter((d["doc_id"], tuple([*packing._encoders(packing.VOCABULARY)[0].encode(d["text"] or "", add_special_tokens=False).ids, packing.END])) for d in docs.collect())
        got = Counter()
        for key in {(r["doc_id"]) for r in made}:
            own = sorted((r for r in made if r["doc_id"] == key), key=lambda r: r["piece"])
            whole = [t for r in own for t in r["ids"]]
            got[key] = len(whole)
        for key in got:
            assert got[key] == sum(len(ids) * n for (k, ids), n in want.items() if k == key)
        assert len(by) <= -(-sum(r["length"] for r in made) // packing.LIMIT) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_both_encoders_agree():
    r = random.Random(0)
    exact = packing._encoders(packing.VOCABULARY)[0]
    for _ in range(300):
        t = "".join(r.choice("abc deÉßñ ,.!?'\"\n\t  0123 <|endoftext|> \u00a0\u0085日本\U0001f600") for _ in range(r.randrange(60)))
        assert packing.encode(t) == exact.encode(t, add_special_tokens=False).ids
        latin = "".join(c for c in t if ord(c) < 0x250)
        assert packing.encode(latin) == exact.encode(latin, add_special_tokens=False).ids


def test_local_search_improves():
    rng = np.random.default_rng(0)
    for low, high in ((1, 1024), (200, 500), (340, 345)):
        n = rng.integers(low, high, 3000)
        start = packing.best_fit(n, 1024)
        end = packing.pack_lengths(n)
        assert len(end) <= len(start) and sorted(i for b in end for i in b) == list(range(len(n))) and max(n[b].sum() for b in end) <= 1024
        assert sum(int(n[b].sum()) ** 2 for b in end) >= sum(int(n[b].sum()) ** 2 for b in start)


# Chat


def test_chat_round_trip():
    r = random.Random(0)
    for _ in range(200):
        turns = [("".join(r.choice("ua<>\\/lg") for _ in range(3)), "".join(r.choice("\\<>lg/turn:\n ") for _ in range(20))) for _ in range(3)]
        text = "".join(chat.render(*t)[0] for t in turns)
        assert chat.parse(text) == turns


def test_events_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"),
        (1, 1, "message", 1, "assistant", ""),
        (1, 2, "delta", 1, "assistant", "he"),
        (1, 3, "delta", 1, "assistant", "llo"),
        (1, 4, "regenerate", 1, "assistant", None),
        (1, 5, "delta", 1, "assistant", "hey"),
        (1, 6, "edit", 0, "user", "hi!"),
        (2, 0, "delta", 4, None, None),
        (None, 0, "message", 0, "user", None),
    ]
    events = spark.createDataFrame(random.Random(0).sample(log, len(log)), "conv_id long, seq long, kind string, message long, role string, text string")
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.reconstruct(events).collect()}
    assert got == {(1, 0): ("user", "hi!"), (1, 1): ("assistant", "hey"), (2, 4): ("", ""), (None, 0): ("user", "")}


def test_chat_digests(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<b"), (1, 1, "assistant", "a<b"), (None, None, None, "x"), (2, 3, "assistant", "é" * 70000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.query(df).collect()}
    assert set(got) == {1, 2, None, -7} and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 6
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\na<b\nassistant\na<b\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"a<ba<b").hexdigest() and got[2]["loss_chars"] == 70000
    assert got[-7]["loss_chars"] == len(chat.PROBE)
    assert chat.query(df.limit(0)).count() == 1


# Embeddings


def links_brute(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None]
    near = {i: [j for j, w, m in good if j != i and m == lab and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98] for i, v, lab in good}
    comp = {i: i for i in near}
    for _ in near:
        for i, js in near.items():
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted(((i, len(near.get(i, [])), comp.get(i, i), i is None or comp.get(i, i) == i) for i, _, _ in rows), key=repr)


@pytest.mark.parametrize("limit", [2048, 40])
def test_embedding_links(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.02, 0.08])).astype(np.float32).tolist(), int(rng.integers(2))) for i in range(300)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[0][1], None), (2005, rows[0][1][:8], 0), (2006, [], 0), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("bucket", F.lit("x"))
    out = graph_dedup.near_duplicates(df, limit=limit).collect()
    got, want = ({r[0]: r[1:] for r in t} for t in (sorted((tuple(r)[:4] for r in out), key=repr), links_brute(rows)))
    found = sum(r[0] for r in got.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * sum(r[0] for r in want.values())
    if limit == 2048:
        assert got == want
    assert graph_dedup.near_duplicates(df.limit(0)).count() == 0


def dense_rows(n=900, seed=5):
    """A dense group in which all pairs link, a looser one beside it, and some lone vectors."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(2, 64))
    centre[1] = centre[0] + 0.25 * centre[1]
    group = [centre[0] + 0.06 * rng.normal(size=64) for _ in range(n)] + [centre[1] + 0.15 * rng.normal(size=64) for _ in range(n // 6)] + list(rng.normal(size=(n // 6, 64)))
    return [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(group)]


def counted(rows):
    """links_brute's results, from one matrix."""
    u = np.array([v for _, v, _ in rows], float)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    near = u @ u.T >= 0.98
    comp = np.arange(len(rows))
    while True:
        least = np.where(near, comp, len(rows)).min(axis=1)
        if (least == comp).all():
            return {i: (int(near[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(len(rows))}
        comp = least


def test_links_of_a_dense_group_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "DENSE", 128)
    rows = dense_rows()
    found = {r[0]: tuple(r)[1:4] for r in graph_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), limit=32).collect()}
    want = counted(rows)
    assert {i: found[i] for i in range(900)} == {i: want[i] for i in range(900)}
    assert sum(x[0] for x in found.values()) >= 0.97 * sum(x[0] for x in want.values())


def test_links_are_complete_where_the_search_falls_short(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "DENSE", 128)
    monkeypatch.setattr(graph_dedup, "_build", lambda g: g[["id"]].rename(columns={"id": "src"}).assign(dst=g["id"]))
    rows = dense_rows(300)[100:]
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(rows)]
    out = graph_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), limit=32).collect()
    assert {r[0]: tuple(r)[1:4] for r in out} == counted(rows) and {r["audited_recall"] for r in out} == {1.0}


def test_too_low_a_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError):
        graph_dedup.near_duplicates(spark.createDataFrame(dense_rows(60), "vec_id long, embedding array<float>, label int"))


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(t):
    found = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if valid(k, m[0]))
    return ",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in found)


def test_base_spans_match_python(spark, odd, empty):
    r = random.Random(0)
    parts = ["a.b@c.de", "@", ".", "+", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", " ", "-", "12", "é", "\U0001f600", "(at)", "host"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 30)))) for i in range(300)]
    for docs in (odd, spark.createDataFrame(rows, "doc_id long, text string"), table(spark)):
        texts = [(d["doc_id"], d["text"]) for d in docs.collect()]
        got = pii.query(docs).collect()
        assert Counter((g["doc_id"], g["base_sha256"]) for g in got) == Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in texts)
        want = {(i, hashlib.sha256(base_spans(t).encode()).hexdigest()): base_spans(t) for i, t in texts}
        for g in got:
            assert all(want[g["doc_id"], g["base_sha256"]].count(k) == g[f"n_{k}"] <= g["spans"].count(k) for k in pii.KINDS)
    assert pii.query(empty).count() == 0


def test_weak_supervision_adds_spans(spark):
    r = random.Random(1)
    rows = [(i, f"call me on 212-555-{r.randrange(1000, 9999)} or write joe (at) host (dot) com, mail k{i}@host.org, phone +1 (212) 555-{r.randrange(1000, 9999)}") for i in range(50)]
    got = pii.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(g["n_phone"] == 1 and g["n_email"] == 1 and g["spans"].count("phone") == 2 and g["spans"].count("email") == 2 for g in got)


# Sharding


@pytest.mark.parametrize("limit", [2000, 40000, 1 << 40])
def test_shards_beside_sql(spark, limit):
    agree(sharding.assign(table(spark), limit=limit), sharding.oracle(limit))


def test_shards_fit(spark, odd, empty):
    same = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    for docs, limit in ((odd, 200), (same, 1000)):
        out = sharding.assign(docs, limit=limit)
        rows = out.collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r)
        for shard, own in by.items():
            assert (sum(r["bytes"] for r in own), len(own)) == (own[0]["shard_bytes"], own[0]["shard_docs"]) and len(shard) == own[0]["depth"]
            assert own[0]["shard_bytes"] <= limit or len(own) == 1
        assert not any(a != b and b.startswith(a) for a in by for b in by)
    assert sharding.assign(empty).count() == 0


# Language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, empty):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.query(odd).collect()}
    assert got[1] == got[2] == got[7] == ("und", 0.0) and got[8][0] != "und"
    assert language.keep_known(odd).columns == odd.columns
    assert language.query(empty).count() == 0 and language.keep_known(empty).count() == 0
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.query(none).collect()} == {"und"}


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    t, k = 4, 3
    scores, start, moves = rng.normal(size=(1, t, k)), rng.normal(size=k), rng.normal(size=(k, k))
    want, total = np.zeros((t, k)), 0.0
    for path in itertools.product(range(k), repeat=t):
        p = np.exp(start[path[0]] + sum(scores[0, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for i, y in enumerate(path):
            want[i, y] += p
    g, pair = language.marginals(scores, np.array([t]), start, moves)
    assert np.allclose(g[0], want / total) and pair.sum() == pytest.approx(t - 1)
    one = np.ones((1, k))
    assert np.allclose(language._word_marginals(scores.copy(), np.array([t]), np.exp(start) * one, one, np.exp(moves))[0], (want / total).sum(axis=0))


def test_code_switched_words_are_told_apart():
    rng = random.Random(0)
    words = {"aa": ["kato", "kali", "kamo"], "bb": ["zur", "zeit", "zahl"]}
    model = language.fit([(lang, [rng.choice(w) for _ in range(40)]) for lang, w in words.items() for _ in range(20)])
    totals = language._Reader(model).marginals([["kato", "kali", "zur", "zeit", "zahl", "zur"], ["kapo"] * 5])
    assert totals[0] == pytest.approx([2, 4], abs=0.3) and totals[1].argmax() == 0


# Mixing


def test_mix_of_odd_rows(spark, odd, empty):
    agree(mixing.query(odd), mixing.ORACLE, documents=odd.select("doc_id", "text", "source").toArrow())
    again = sorted(map(repr, mixing.decisions(odd.repartition(5)).collect()))
    assert again == sorted(map(repr, mixing.decisions(odd).collect()))
    assert mixing.query(empty).count() == 0
    made = mixing.mix(odd)
    assert made.columns == odd.columns and made.count() == sum(r["times"] for r in mixing.decisions(odd).collect())


def test_water_filling(spark):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 0)], "source string, source_size long")).collect()}
    assert got == {"a": 30.0, "b": 1100 - 30.0 - 270.0, "c": 270.0, None: 0.0}


def test_taken_words_come_near_targets(spark):
    rows = mixing.query(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r["t"] - r["target"]) <= 0.01 * r["target"] and r["over"] <= 0


# Tokens


def best_count(pretoken, scores):
    w = tokens.MARK + pretoken
    best = [(0, 0)]
    for e in range(1, len(w) + 1):
        n = len(w[e - 1].encode())
        choices = [(best[e - 1][0] + tokens.BYTE * n, best[e - 1][1] - n)]
        choices += [(best[j][0] + scores[w[j:e]], best[j][1] - 1) for j in range(e) if w[j:e] in scores]
        best.append(max(choices))
    return -best[-1][1]


def test_token_counts(spark, odd, empty, monkeypatch):
    scores, longest = tokens.pieces()
    r = random.Random(0)
    words = ["".join(r.choice("abcdeéß日.") for _ in range(r.choice([1, 5, 12, 90]))) for _ in range(400)] + ["the", "theory", "x" * 200]
    assert [tokens.Trie(scores, longest).count([w]) for w in words] == [best_count(w, scores) for w in words]
    monkeypatch.setattr(tokens, "NODES", 50)
    monkeypatch.setattr(tokens, "WORDS", 20)
    small = tokens.Trie(scores, longest)
    assert [small.count([w]) for w in words * 2] == [best_count(w, scores) for w in words] * 2
    got = {x["doc_id"]: (x["n_pretokens"], x["n_tokens"]) for x in tokens.count(odd.filter("doc_id is not null")).collect()}
    assert got[1] == got[2] == got[7] == (0, 0) and got[8][0] == 30000 and got[12] == (2, best_count("two", scores) + best_count("words", scores))
    assert tokens.count(empty).count() == 0


# Pipeline


def test_pipeline(spark):
    docs = table(spark)
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, DATA)
        assert step.columns == docs.columns, name
    got = corpus_pipeline.run(spark, DATA)
    want = packing.pieces(step).select("doc_id", "piece", "length", "ids_crc32")
    assert Counter(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(map(tuple, want.collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, DATA)
            out.count()
            if name != "best_fit_packing":
                assert out.columns == docs.columns
