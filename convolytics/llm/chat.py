"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conversation, sequence, kind, message reference, role, text. Kinds: `message` (a whole
text), `delta` (text to append), `edit` (a new text), `regenerate` (empties the text for the deltas that follow),
`delete`. Events are folded message by message first, so that a long conversation isn't folded in one task. An event
without a reference belongs to the last `message` event without one before it in its conversation, by sequence; such
events before any message are a message of their own. The messages are then partitioned by conversation, sorted by
sequence and rendered as a stream: only one part of PART_CHARS of a conversation is in memory.

In the template a turn is `<|turn|>ROLE`, a line end, the text, `<|end|>`, a line end. Inside roles and texts a
backslash is put behind each backslash, `<` and `[`, so that no control string survives, and taken away on reading.
Nulls count as empty. Events of one sequence are ordered by kind, role and text; repeated rows are kept. Other columns
of the log are left out, whatever their names; an empty log gives no parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>\n"
PART_CHARS, MAX_BATCH = 1 << 18, 512
_ESCAPE, _UNESCAPE = re.compile(r"([\\<\[])"), re.compile(r"([\\<\[])\\")
_READ = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
EVENT = ("conv_id", "seq", "kind", "ref", "role", "text")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _referred(events: DataFrame) -> DataFrame:
    """The events, with a reference of their own for those that have none: how many such messages came up to them."""
    e = events.select(*EVENT)
    so_far = Window.partitionBy("conv_id").orderBy("seq", F.col("kind") != "message", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    own = e.where(F.col("ref").isNull()).withColumn("ref", F.concat(F.lit("\0"), F.count_if(F.col("kind") == "message").over(so_far).cast("string")))
    return e.where(F.col("ref").isNotNull()).unionByName(own)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of the messages that remain when all events are folded; seq is a message's first."""
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log")
    folded = _referred(events).groupBy("conv_id", "ref").agg(log, F.min("seq").alias("seq"), F.min_by("role", F.struct("seq", F.col("kind") != "message", "kind", "role")).alias("role"))
    # All but deltas begin the text anew: what is left counts from the last of them on.
    begins = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: F.element_at("log", i)["kind"] != "delta")
    tail = F.expr("slice(log, greatest(1, coalesce(array_max(begins), 1)), size(log))")
    folded = folded.withColumn("begins", begins).withColumn("tail", tail).where(F.col("tail")[0]["kind"] != "delete")
    pieces = F.transform(F.filter("tail", lambda x: x["kind"] != "regenerate"), lambda x: F.coalesce(x["text"], F.lit("")))
    return folded.select("conv_id", "seq", "role", F.array_join(pieces, "").alias("text"))


_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def render(msgs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, part, formatted, loss: parts of whole turns in order, and the spans of each part under the loss mask.

    Rows of a conversation come from one partition, in order.
    """
    rows = msgs.select(F.col("conv_id").cast("long"), "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, part, held, spans, size = None, 0, [], [], 0

        def made() -> dict:
            return {"conv_id": conv, "part": part, "formatted": "".join(held), "loss": spans}

        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if held and (c != conv or size > PART_CHARS):
                    yield made()
                    part, held, spans, size = part + 1 if c == conv else 0, [], [], 0
                if c != conv:
                    part = 0
                conv = c
                head, body = f"{TURN}{escape(role).replace(chr(10), '[n')}\n", escape(text)
                if role == loss_role:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                held.append(f"{head}{body}{END}")
                size += len(held[-1])
        if held:
            yield made()

    return rows.mapInArrow(lambda batches: _batches(parts(batches), _PART, 16), "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>")


_READ_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(parts: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of each conversation, from the formatted parts alone. ordered: parts come as render() gives them."""
    rows = parts if ordered else parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, seen, turns, loss, n, n_loss, n_chars = None, False, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def made() -> dict:
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": n_loss, "loss_sha256": loss.hexdigest(), "formatted_chars": n_chars}

        for batch in batches:
            for c, text, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
                if seen and c != conv:
                    yield made()
                    turns, loss, n, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                conv, seen = c, True
                n_chars += len(text)
                for role, body in _READ.findall(text):
                    turns.update(f"{unescape(role.replace('[n', chr(10)))}\n{unescape(body)}\n".encode())
                    n += 1
                for s in spans:
                    plain = unescape(text[s["start"] : s["end"]])
                    loss.update(plain.encode())
                    n_loss += len(plain)
        if seen:
            yield made()

    return rows.select("conv_id", "formatted", "loss").mapInArrow(lambda batches: _batches(digests(batches), _READ_BACK, MAX_BATCH), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted parts of all conversations of an event log; other columns of the log are left out."""
    return render(messages(events), loss_role)
