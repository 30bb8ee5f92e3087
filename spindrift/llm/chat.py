"""Chat formatting by event-sourced reconstruction.

An event log has the columns conv_id, turn, msg (identifies a message of a turn), seq, kind, role,
text. Partitioned by conversation and sorted by sequence, the events of a message are folded in one pass:

* ``start`` opens the message and sets its role; its text is the first part
* ``delta`` appends its text
* ``edit`` replaces the text so far
* ``regenerate`` discards the text so far; later deltas build the new answer
* ``delete`` removes the message

Messages are rendered as they close, so a worker holds one message and one rendered conversation,
never all conversations of a partition.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Control strings inside a
text get a backslash after their first character (one more where backslashes stand there already),
which ``unescape`` takes back, so every text survives the round trip. In roles backslash and line
feed are escaped as well.

Cases: null text and null role count as empty, a null kind as ``delta``; a null conversation is a
conversation of its own; messages of one turn keep the order (turn, role, text digest, msg); a message
without ``start`` has an empty role; an unknown kind raises. An empty log gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What follows "<" or "[" in a control string of this template and of common others.
TAILS = r"s>|/s>|/?INST\]|/?SYS>>|\|"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={TAILS})")
#: Code points in a streamed delta, where whole texts are turned into an event log.
DELTA = 512


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of assistant texts: the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE + "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest[: rest.rindex(CLOSE)])))
    return out


def fold(events: Iterator[tuple[str | None, str | None, str | None]]) -> tuple[str, str] | None:
    """The final (role, text) of one message from its (kind, role, text) in order; None if it was deleted."""
    role, parts, there = "", [], True
    for kind, who, text in events:
        kind, text = kind or "delta", text or ""
        if kind == "start":
            role, parts, there = who or "", [text], True
        elif kind == "delta":
            parts.append(text)
        elif kind == "edit":
            parts = [text]
        elif kind == "regenerate":
            parts = []
        elif kind == "delete":
            there = False
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    return (role, "".join(parts)) if there else None


FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "msg", "kind", "role", "text")), strict=True)

    def conversations():
        conv, key, events, messages = None, None, [], []
        for c, turn, msg, *event in rows():
            if key != (c, turn, msg):
                if key is not None:
                    messages.append(fold(iter(events)))
                    if key[0] != c:
                        yield key[0], messages
                        messages = []
                key, events = (c, turn, msg), []
            events.append(event)
        if key is not None:
            yield key[0], [*messages, fold(iter(events))]

    held, size = [], 0
    for conv, messages in conversations():
        formatted, spans = render([m for m in messages if m is not None])
        held.append((conv, formatted, [{"start": a, "end": b} for a, b in spans]))
        size += len(formatted)
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), FORMATTED.types, strict=True)], schema=FORMATTED)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), FORMATTED.types, strict=True)], schema=FORMATTED)


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation in the event log."""
    log = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("msg").cast("string"), F.col("seq").cast("long"), F.col("kind").cast("string"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "msg", "seq")
    return ordered.select("conv_id", "turn", "msg", "kind", "role", "text").mapInArrow(_formatted, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def event_log(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """Whole turns as the events that a streaming chat would have logged: a start, then deltas."""
    text, role = text_or_empty("text"), text_or_empty("role")
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "msg", F.concat_ws(":", "role", F.sha2("text", 256), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    )
    pieces = F.sequence(F.lit(0), F.ceil(F.length("text") / F.lit(delta)).cast("int"))
    return turns.withColumn("seq", F.explode(pieces)).select(
        "conv_id",
        "turn",
        "msg",
        "seq",
        F.when(F.col("seq") == 0, "start").otherwise("delta").alias("kind"),
        F.when(F.col("seq") == 0, F.col("role")).alias("role"),
        F.when(F.col("seq") == 0, "").otherwise(F.substring(F.col("text"), (F.col("seq") - 1) * delta + 1, F.lit(delta))).alias("text"),
    )


READ_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for conv, formatted, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            turns, loss, chars, n = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text in parse(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for s in spans:
                text = unescape(formatted[s["start"] : s["end"]])
                chars += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), READ_BACK.types, strict=True)], schema=READ_BACK)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from the formatted conversations alone."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds: its texts are control strings.
EXTRA = "</s>[INST] ok [/INST]"


def op6(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return read_back(format_conversations(event_log(turns.unionByName(extra))))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{EXTRA}'), (-1, 1, 'assistant', '{EXTRA}')
), e AS (
  SELECT *, sha256(text) AS h, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|/?INST\]|/?SYS>>|\|)', '\1\\\2\3', 'g')) AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, h)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, h) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(OPEN) + 1 + len(CLOSE) + 1} + length(role) + n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
