"""Event-sourced reconstruction of conversations, and their rendering.

A log of events (messages, streamed deltas, edits, regenerations) is partitioned
by conversation and sorted by sequence; a stream over each partition folds the
events of one conversation after another into its final messages and renders
them. One conversation is held at a time, whatever the partition holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

OPEN, CLOSE = "### ", "</turn>"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMES = {v: k for k, v in ROLES.items()}
_ESCAPE = re.compile(r"\\|#(?=## )|<(?=/turn>)|:(?= )")
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: A turn: its role up to the first ": " that is not escaped, its text up to the first close mark that is not.
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and before the first character of every control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: spans of assistant texts. A role out of ROLES is marked by "="."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{ROLES.get(role) or escape('=' + role)}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Messages read back from a formatted conversation; the inverse of render."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        role = m[1]
        out.append((_NAMES[role] if role in _NAMES else unescape(role)[1:], unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


def fold(events: list[tuple]) -> list[tuple[str, str]]:
    """Final messages of one conversation. events: (kind, message, role, text) in order of sequence.

    message: a new message (its role and text). delta: text added to a message, which it opens if there is none.
    edit: the message's text anew; later messages go, as they answered the old one. regenerate: the message is emptied,
    with what came after it, and its deltas follow. delete: the message goes. An edit, regenerate or delete of a message that is not there
    does nothing. An event without a message id is about a message of its own.
    """
    order: list = []
    state: dict = {}
    for i, (kind, message, role, text) in enumerate(events):
        key = ("own", i) if message is None else message
        if kind in ("message", "delta") and key not in state:
            order.append(key)
            state[key] = [role or "", [text or ""]]
        elif kind == "delta":
            state[key][1].append(text or "")
        elif key in state and kind in ("message", "edit", "regenerate"):
            if kind != "message":
                cut = order.index(key) + 1
                for gone in order[cut:]:
                    del state[gone]
                del order[cut:]
            state[key] = [role or state[key][0], ["" if kind == "regenerate" else text or ""]]
        elif key in state and kind == "delete":
            order.remove(key)
            del state[key]
    return [(state[k][0], "".join(state[k][1])) for k in order]


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A log that a table of finished turns (conv_id, turn, role, text) could have come from, whose fold is those turns.

    An assistant's turn opens with a streamed draft of its first half, is regenerated, and streams its text in three deltas; a
    user's turn is sent without its end and then edited; a turn of any other role is one message. seq is a struct of turn, role, a hash of the
    text, a row number (rows repeated in full are turns of their own) and the step in the turn. Null role and null text are
    empty; conv_id keeps its type; other columns, whatever their names, are not read.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("role").cast("string")
    x = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    third, half = F.floor(F.length("text") / 3).cast("int"), F.floor(F.length("text") / 2).cast("int")
    one, none = F.lit(1), F.lit(None).cast("string")
    cut = lambda start, length: F.substring("text", start, length)
    rest = F.expr("substring(text, 2 * cast(floor(length(text) / 3) as int) + 1)")
    event = lambda step, kind, role, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    streamed = F.array(
        event(0, "delta", F.col("role"), cut(one, half)), event(1, "regenerate", none, none), event(2, "delta", none, cut(one, third)),
        event(3, "delta", none, cut(third + 1, third)), event(4, "delta", none, rest),
    )
    edited = F.array(event(0, "message", F.col("role"), cut(one, half)), event(1, "edit", none, F.col("text")))
    log = F.when(F.col("role") == "assistant", streamed).when(F.col("role") == "user", edited).otherwise(F.array(event(0, "message", F.col("role"), F.col("text"))))
    e = x.withColumn("hash", F.xxhash64("text")).select("conv_id", "turn", F.col("role").alias("of"), "hash", "row", F.explode(log).alias("e"))
    seq = F.struct(F.col("turn").isNull().alias("late"), "turn", "of", "hash", "row", "e.step")
    return e.select("conv_id", seq.alias("seq"), "e.kind", F.col("row").cast("string").alias("message"), "e.role", "e.text")


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end in characters) of every conversation of ``events``
    (conv_id, seq, kind, message, role, text).

    Events are ordered by seq (of any type; null last), then kind, message, role, text, so that ties have one order. Null role
    and null text are empty; rows with a null conv_id are one conversation; repeated rows count as often as they stand; other
    columns, whatever their names, are not read; an empty table gives no rows. A conversation is one text, so one task folds it,
    and its memory is bounded by the longest conversation.
    """
    id_type = events.schema["conv_id"].dataType
    cols = ["conv_id", "seq", "kind", "message", "role", "text"]
    sorted_ = (
        events.select(*cols).repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("seq").asc_nulls_last(), "kind", "message", "role", "text")
    )
    span = pa.list_(pa.int64())
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def conversations(batches) -> Iterator[tuple]:
        conv, held, any_ = None, [], False
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "message", "role", "text"))):
                if any_ and row[0] != conv:
                    yield conv, held
                    held = []
                conv, any_ = row[0], True
                held.append(row[1:])
        if any_:
            yield conv, held

    def run(batches):
        out, size = [], 0
        for conv, held in conversations(batches):
            formatted, spans = render(fold(held))
            out.append((conv, formatted, [list(s) for s in spans]))
            size += len(formatted)
            if size > 4_000_000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(out):
        a, b, c = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, to_arrow_type(id_type)), pa.array(b, pa.string()), pa.array(c, pa.list_(span))], ["conv_id", "formatted", "loss_spans"])

    return sorted_.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_chats: turns and loss text, as counts and digests."""
    id_type = formatted.schema["conv_id"].dataType
    numbers = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in spans)
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, T.StructType([T.StructField("conv_id", id_type), *T._parse_datatype_string(numbers).fields]))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns become a log of deltas, edits and regenerations, and come back from it."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chats(events_of_turns(rows)))


#: Without escapes a turn is "### Role: text</turn>\n"; SQL counts what escaping adds.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '### '))
                + len(regexp_extract_all(text, '</turn>')) + len(regexp_extract_all(text, ': ')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + length(role) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
