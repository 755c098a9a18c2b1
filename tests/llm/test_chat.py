import random

import pytest
from oracle import agree
from pyspark.sql import functions as F

from cellweave.llm import chat

LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def messages(spark, log, seed=0):
    events = spark.createDataFrame(random.Random(seed).sample(log, len(log)), LOG).withColumn("nth", F.lit("x")).withColumn("rank", F.lit("y"))
    return sorted(((r["conv_id"] or 0, r["message"], r["nth"], r["role"], r["text"]) for r in chat.reconstruct(events).collect()), key=repr)


def test_a_regeneration_supersedes_later_messages(spark):
    log = [(1, 0, "message", 0, "user", "q"), (1, 1, "message", 1, "assistant", "old"), (1, 2, "message", 2, "user", "more"), (1, 3, "message", 3, "assistant", "gone")]
    log += [(1, 4, "regenerate", 1, "assistant", None), (1, 5, "delta", 1, "assistant", "new"), (1, 6, "message", 4, "user", "then"), (2, 3, "message", 9, "user", "other")]
    assert messages(spark, log) == [(1, 0, 0, "user", "q"), (1, 1, 0, "assistant", "new"), (1, 4, 0, "user", "then"), (2, 9, 0, "user", "other")]


def test_unknown_kinds_change_nothing(spark):
    log = [(1, 0, "message", 0, "user", "q"), (1, 1, "seen", 0, "user", "zz"), (1, 2, None, 0, None, "zz"), (1, 3, "ping", 7, "user", "zz")]
    assert messages(spark, log) == [(1, 0, 0, "user", "q")]


@pytest.mark.parametrize("seed", range(3))
def test_folding_matches_a_plain_fold(spark, seed):
    r = random.Random(seed)
    log, seq = [], 0
    for _ in range(120):
        seq += 1
        log.append((r.randrange(3), seq, r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.randrange(4), r.choice(["user", "assistant"]), r.choice(["a", "bc", "", None])))
    want = []
    for conv in {e[0] for e in log}:
        cut = None
        for m in sorted({e[3] for e in log if e[0] == conv}):
            done, again = [], None
            for _, s, kind, _, role, text in sorted(e for e in log if e[0] == conv and e[3] == m):
                if kind == "message" or not done:
                    done.append([s, role, ""])
                if kind in ("message", "delta"):
                    done[-1][2] += text or ""
                elif kind == "edit":
                    done[-1][2] = text or ""
                else:
                    done[-1][2], again = "", s
            want += [(conv, m, nth, role, text) for nth, (s, role, text) in enumerate(done) if cut is None or s >= cut]
            cut = max((x for x in (cut, again) if x is not None), default=None)
    assert messages(spark, log, seed) == sorted(want, key=repr)


def test_streams_give_the_conversations_back(spark, odd):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "x", "é<b>\\", "long " * 50])) for c in range(6) for t in range(5)]
    rows += [(0, 1, "assistant", "again"), (0, 1, "assistant", "again"), (0, 1, "assistant", "after"), (7, None, "assistant", "no turn"), (None, 0, "assistant", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first", F.lit(1)).withColumn("message", F.lit("m"))
    got = [(x["conv_id"], x["message"], x["role"], x["text"]) for x in chat.reconstruct(chat.as_stream(df)).orderBy("conv_id", "message", "nth").collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    assert got == [(c, t, role or "", text or "") for c, t, role, text in sorted(rows, key=order)]
    kinds = {x["kind"] for x in chat.as_stream(df).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"} and chat.as_stream(df.limit(0)).isEmpty()


def test_equal_turns_beside_sql(spark):
    import pandas as pd

    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "c"), (1, 2, "assistant", "d<"), (2, 5, "user", None)]
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    agree(chat.query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.ORACLE, conversations=frame)
