r"""Chat formatting by event-sourced reconstruction.

A log has one row per event of a message: ``message`` opens it with a text, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it for new deltas and
begins a new branch: messages after it that had been opened before are superseded. The log
is partitioned by conversation, sorted by message and sequence, and folded as it streams
by: a task holds one message and what superseded messages need, one number. Messages leave
it in order, so that what reads whole conversations, as digests do, needs no other shuffle.

A segment is ``<turn:ROLE>\n``, the escaped text, ``</turn>\n``. Escaping writes ``\``
as ``\\``, ``<`` as ``\l`` and ``>`` as ``\g``, so that no text can hold a mark, and is
undone exactly. ``loss_start`` and ``loss_end`` bound the code points of a segment that
are trained on: the escaped text of an assistant.

Defined cases: a null text or role counts as empty; rows with a null conversation make
one conversation; null message and sequence numbers come first; a second ``message`` event
with one message number opens another message, so repeated rows are turns of their own;
ties in sequence go by kind, role and text; an event with no open message opens an empty
one; events of an unknown or null kind change nothing; an empty log gives an empty table;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellweave.util import checkpoint

ASSISTANT = "assistant"
_OUT = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {v[1]: k for k, v in _OUT.items()}
_SEGMENT = re.compile(r"<turn:([^<>]*)>\n([^<>]*)</turn>\n")


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    head, body = f"<turn:{escape(role)}>\n", escape(text)
    trained = role == ASSISTANT
    return f"{head}{body}</turn>\n", len(head) if trained else None, len(head) + len(body) if trained else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; raises where it isn't whole segments."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of a partition sorted by conversation, message and sequence."""
    key, message, rows = None, None, []
    cut, begun = None, None  # the last regeneration of the messages before this one, and of this one's number

    def flush(final: bool):
        nonlocal rows
        if rows and (final or len(rows) >= 512):
            yield pa.RecordBatch.from_pylist(rows, schema=_MESSAGES)
            rows = []

    def close() -> None:
        if message is not None and not (cut is not None and message["opened"] is not None and message["opened"] < cut):
            rows.append({"conv_id": key[0], "message": key[1], "nth": message["nth"], "role": message["role"], "text": "".join(message["parts"])})

    for batch in batches:
        for e in batch.to_pylist():
            now = (e["conv_id"], e["message"])
            if message is None or now != key or e["kind"] == "message":
                close()
                nth = message["nth"] + 1 if message is not None and now == key else 0
                if key is None or now[0] != key[0]:
                    cut = begun = None
                elif now != key:
                    cut, begun = max((x for x in (cut, begun) if x is not None), default=None), None
                key, message = now, {"nth": nth, "role": e["role"] or "", "opened": e["seq"], "parts": []}
            if e["kind"] in ("message", "delta"):
                message["parts"].append(e["text"] or "")
            elif e["kind"] == "edit":
                message["parts"] = [e["text"] or ""]
            else:
                message["parts"] = []
                begun = max((x for x in (begun, e["seq"]) if x is not None), default=None)
            yield from flush(False)
    close()
    yield from flush(True)


_MESSAGES = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, message, nth, role, text from events (conv_id, seq, kind, message, role, text).

    Messages are ordered by message, then nth; a conversation's follow each other in that order in one partition.
    """
    log = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), F.col("seq").cast("long"), F.expr("array_position(array('message', 'regenerate', 'edit', 'delta'), kind)").alias("rank"), "kind", "role", "text").filter("rank > 0")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", "rank", "role", "text").select("conv_id", "message", "seq", "kind", "role", "text")
    return log.mapInArrow(_fold, "conv_id long, message long, nth long, role string, text string")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [render(r or "", t or "") for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        out = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *out], ["conv_id", "message", "nth", "segment", "loss_start", "loss_end"])


def format_events(events: DataFrame) -> DataFrame:
    """conv_id, message, nth, segment, loss_start, loss_end: a row per final message."""
    return reconstruct(events).mapInArrow(_render, "conv_id long, message long, nth long, segment string, loss_start long, loss_end long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log of one event a message."""
    turn = F.col("turn").cast("long")
    return conversations.select(F.col("conv_id"), turn.alias("seq"), F.lit("message").alias("kind"), turn.alias("message"), "role", "text")


def as_stream(conversations: DataFrame) -> DataFrame:
    """Finished conversations as the log of their making.

    An assistant's message is begun, streamed half, regenerated and streamed again in two
    deltas; another's is sent half and then edited. Rows without a turn are single events.
    Rows of one turn of a conversation follow each other by role and text.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("message"), "role", "text")
    several = checkpoint(rows.groupBy("conv_id", "message").count().filter("count > 1").select("conv_id", "message"))
    place = F.lit(0)
    if not several.isEmpty():
        place = F.row_number().over(W.partitionBy("conv_id", "message").orderBy("role", "text")) - 1
    rows = rows.withColumn("first", (F.col("message") * PLACES + place) * STEPS)
    half = F.floor(F.length("text") / 2).cast("int")
    begin, rest = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text"))
    step = lambda k, kind, text: F.struct((F.col("first") + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit(None).cast("string")
    streamed = F.array(step(0, "message", none), step(1, "delta", begin), step(2, "regenerate", none), step(3, "delta", begin), step(4, "delta", rest))
    edited = F.array(step(0, "message", begin), step(1, "edit", F.col("text")))
    steps = F.when(F.col("message").isNull(), F.array(step(0, "message", F.col("text")))).when(F.col("role") == ASSISTANT, streamed).otherwise(edited)
    return rows.select("conv_id", "message", "role", F.explode(steps).alias("e")).select("conv_id", "e.seq", "e.kind", "message", "role", "e.text")


#: Rows of one turn, and events of one row, that sequence numbers leave room for.
PLACES, STEPS = 1 << 20, 8


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments stream by in order; a task holds one segment and two hash states."""
    key, state, rows = None, None, []

    def close() -> None:
        if state is not None:
            rows.append({"conv_id": key, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]})

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != key:
                close()
                key, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(r["segment"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if r["loss_start"] is not None:
                trained = unescape(r["segment"][r["loss_start"] : r["loss_end"]])
                state[2] += len(trained)
                state[3].update(trained.encode())
            state[4] += len(r["segment"])
        if len(rows) >= 512:
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

PROBE = r"\### Assistant: </turn> ok"


def query(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations and a probe, conversation -7.

    The conversations come as the log of their making. SHA-256 of a whole conversation is
    sequential, so its segments pass through one task; they are streamed, not gathered.
    """
    spark = conversations.sparkSession
    kind = "conv_id long, turn long, role string, text string"
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, ASSISTANT, PROBE)], kind)
    made = format_events(as_stream(rows.unionByName(probe)))
    return made.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g') AS body, replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g') AS who FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn:' || who || '>' || chr(10) || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
