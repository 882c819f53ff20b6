"""Chat formatting: conversations rebuilt from event logs, rendered, and read back.

A log has one row an event: conversation, order, event, message, role, text. ``open`` begins a
message at the conversation's end (its text, if any, comes first), ``delta`` adds to a message,
``edit`` replaces its text, ``regenerate`` empties it for the deltas that follow. ``edit`` and
``regenerate`` also take back every message opened later than theirs. Events of messages that were
never opened or are taken back count for nothing, and so does a second ``open`` of a message that
stands.

The fold sorts each conversation's events, without their texts, and streams over them: a task keeps
the messages that stand in the conversation at hand, never its texts. It gives the place of each
message that is left and the event from which its text counts; texts are joined to these and stay
pieces, so that nothing grows with a message or a conversation. The rendered rows are pieces too:
concatenated in order they are the conversation. A piece never breaks a marker or an escape, and
``loss`` marks whole pieces. The digests of ``read_back`` go over a conversation in order, with a
running hash and nothing else kept.

Null conversations are one conversation, null roles and texts are empty, events of an unknown kind
count for nothing. Events that tie in order are taken by kind, message and text; those repeated in conversation,
order, kind, message and text count once. An empty log gives no
rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ravine.llm.common import materialize, scratch

#: The template of a turn: role and text, both escaped.
BEGIN, MIDDLE, END = "<s>[", "] ", "</s>"
#: Every control string holds one of these, and an escaped text none.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\o", "]": "\\c"}
#: The role whose texts are learned.
LEARNED = "assistant"
#: Characters of a delta in the log that the query makes.
DELTA = 512
#: Events that tie in order are taken in this order.
KINDS = ["open", "edit", "regenerate", "delta"]

_TOKEN = re.compile(r"<s>\[(?P<role>[^\]]*)\] |(?P<end></s>)|(?P<text>[^<\[\]]+)")
_BACK = {v[1]: k for k, v in ESCAPES.items()}


def escape(text: Column) -> Column:
    """The text without any character that a control string needs; ``unescape`` turns it back."""
    for char, code in ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conversation, message, role, place, since) of the messages left, from events in order."""
    stack: list[list] = []  # message, role, since
    at: dict[object, int] = {}
    now: object = None
    types = None

    def left() -> Iterator[pa.RecordBatch]:
        for first in range(0, len(stack), 4096):
            part = stack[first : first + 4096]
            columns = [[now] * len(part), [m for m, _, _ in part], [r for _, r, _ in part], range(first, first + len(part)), [s for _, _, s in part]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv", "msg", "role", "place", "since"])

    for batch in batches:
        conv, order, event, msg, role = (batch.column(i) for i in range(5))
        types = [conv.type, msg.type, role.type, pa.int64(), order.type]
        order_at = lambda i, o=order: o[i].as_py()
        for i, (c, e, m) in enumerate(zip(conv.to_pylist(), event.to_pylist(), msg.to_pylist())):
            if c != now or not at and not stack:
                if stack:
                    yield from left()
                stack, at, now = [], {}, c
            if e == "open":
                if m not in at:
                    at[m] = len(stack)
                    stack.append([m, role[i].as_py(), order_at(i)])
            elif e in ("edit", "regenerate") and m in at:
                for gone, _, _ in stack[at[m] + 1 :]:
                    del at[gone]
                del stack[at[m] + 1 :]
                stack[-1][2] = order_at(i)
    if stack:
        yield from left()


def fold(log: DataFrame, conv: str, order: list[str], event: str = "event", msg: str = "msg", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, role, piece, text) of what the log comes to: one row for each piece of text, and
    a row with a null text and piece for each message."""
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col(event)), F.lit(0)).cast("int")
    events = log.select(
        F.col(conv).alias("conv"),
        F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))), kind.alias("kind"), F.col(msg).cast("string").alias("msg"), F.coalesce(F.md5(text), F.lit("")).alias("digest")).alias("order"),
        F.col(event).alias("event"),
        F.col(msg).cast("string").alias("msg"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("event").isin(KINDS))
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    narrow = events.filter("event <> 'delta'").select("conv", "order", "event", "msg", "role")
    standing = narrow.repartition("conv").sortWithinPartitions("conv", "order").mapInArrow(_standing, f"conv {types['conv']}, msg string, role string, place bigint, since {types['order']}")
    said = events.filter("event <> 'regenerate' AND text <> ''").select(F.struct("conv", "msg").alias("of"), "order", "event", "text")
    counts = F.when(F.col("event") == "delta", F.col("order") > F.col("since")).otherwise(F.col("order") == F.col("since"))
    # structs are equal where both have nulls; the rows stay dealt by them, so events repeated go without a shuffle
    pieces = standing.withColumn("key", F.struct("conv", "msg")).join(said, (F.col("key") == F.col("of")) & counts).dropDuplicates(["key", "order"])
    heads = standing.select("conv", "place", "role", F.lit(None).cast(types["order"]).alias("piece"), F.lit(None).cast("string").alias("text"))
    return heads.unionByName(pieces.select("conv", "place", "role", F.col("order").alias("piece"), "text")).withColumnRenamed("conv", conv)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation, and the code points before each."""
    now, n, offset, begun = None, 0, 0, False
    for batch in batches:
        numbers, offsets = [], []
        for c, length in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if c != now or not begun:
                now, n, offset, begun = c, 0, 0, True
            numbers.append(n)
            offsets.append(offset)
            n, offset = n + 1, offset + length
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), batch.column(1), batch.column(2)], ["conv", "piece", "start", "formatted", "loss"])


def render(messages: DataFrame, conv: str, learned: str = LEARNED) -> DataFrame:
    """(conv, piece, start, formatted, loss): the rendered pieces of every conversation, numbered;
    ``start`` counts the code points before. Only texts of the learned role are under the loss."""
    heads = messages.filter("text IS NULL")
    begin = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(MIDDLE))
    each = heads.select(conv, "place", "piece", F.explode(F.array(F.struct(F.lit(0).alias("part"), begin.alias("formatted")), F.struct(F.lit(2).alias("part"), F.lit(END).alias("formatted")))).alias("e")).select(
        conv, "place", "e.part", "piece", "e.formatted", F.lit(False).alias("loss")
    )
    said = messages.filter("text IS NOT NULL").select(conv, "place", F.lit(1).alias("part"), "piece", escape(F.col("text")).alias("formatted"), (F.col("role") == learned).alias("loss"))
    rows = each.unionByName(said).withColumnRenamed(conv, "conv").repartition("conv").sortWithinPartitions("conv", "place", "part", "piece")
    kind = messages.schema[conv].dataType.simpleString()
    out = rows.select("conv", "formatted", "loss", F.char_length("formatted").alias("n")).mapInArrow(_numbered, f"conv {kind}, piece bigint, start bigint, formatted string, loss boolean")
    return out.withColumnRenamed("conv", conv)


def assembled(pieces: DataFrame, conv: str) -> DataFrame:
    """(conv, formatted, loss): whole conversations with the spans of code points under the loss, for
    conversations that fit one row."""
    part = F.sort_array(F.collect_list(F.struct("piece", "formatted", "start", "loss")))
    spans = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["formatted"])).alias("end")))
    return pieces.groupBy(conv).agg(part.alias("p")).select(conv, F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("formatted"), spans.alias("loss"))


_DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse rendered pieces in order; counts and digests of each conversation."""
    rows: list[tuple] = []
    now, begun, opened, n_turns, n_loss, n_chars = None, False, False, 0, 0, 0
    turns = loss = hashlib.sha256()
    kind = pa.null()

    def flush() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], ["conv", *(x.split()[0] for x in _DIGESTS.split(", "))])

    def end() -> None:
        if opened:
            raise ValueError(f"the last turn of conversation {now} has no end")
        rows.append((now, n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))

    for batch in batches:
        kind = batch.column(0).type
        for c, formatted, learned in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != now or not begun:
                if begun:
                    end()
                now, begun, opened, n_turns, n_loss, n_chars = c, True, False, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            n_chars += len(formatted)
            upto = 0
            for m in _TOKEN.finditer(formatted):
                if m.start() != upto or (m["role"] is None) != opened:
                    break
                upto = m.end()
                if m["role"] is not None:
                    opened, n_turns = True, n_turns + 1
                    turns.update((unescape(m["role"]) + "\n").encode())
                elif m["end"]:
                    opened = False
                    turns.update(b"\n")
                else:
                    said = unescape(m["text"])
                    turns.update(said.encode())
                    if learned:
                        loss.update(said.encode())
                        n_loss += len(said)
            if upto != len(formatted):
                raise ValueError(f"conversation {c} isn't of this template at {formatted[upto : upto + 40]!r}")
        if len(rows) >= 4096:
            yield flush()
            rows = []
    if begun:
        end()
    if rows:
        yield flush()


def read_back(pieces: DataFrame, conv: str) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the
    rendered text and its loss marks alone."""
    kind = pieces.schema[conv].dataType.simpleString()
    rows = pieces.select(F.col(conv).alias("conv"), "piece", "formatted", "loss").repartition("conv").sortWithinPartitions("conv", "piece")
    return rows.select("conv", "formatted", "loss").mapInArrow(_digested, f"conv {kind}, {_DIGESTS}").withColumnRenamed("conv", conv)


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as the log of a chat: a user's message is drafted and then edited, another's begins,
    is regenerated and streams in deltas. Rows repeated are turns of their own; turns that tie go by
    role and text (its MD5), null turns come last."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    rows = rows.withColumn("msg", F.concat_ws(" ", "turn", "copy", "digest", "role"))
    deltas = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.char_length("text") / DELTA).cast("int"), F.lit(1))), lambda i: F.struct((i + 2).alias("step"), F.lit("delta").alias("event"), F.substring(F.col("text"), (i - 1) * DELTA + 1, F.lit(DELTA)).alias("said")))
    event = lambda step, name, said: F.struct(F.lit(step).alias("step"), F.lit(name).alias("event"), said.alias("said"))
    draft = F.substring("text", 1, 16)
    typed = F.array(event(1, "open", draft), event(2, "edit", F.col("text")))
    streamed = F.concat(F.array(event(1, "open", draft), event(2, "regenerate", F.lit(""))), deltas)
    each = rows.withColumn("e", F.explode(F.when(F.col("role") == "user", typed).otherwise(streamed)))
    return each.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("by"), "digest", "copy", "e.step", "e.event", "msg", "role", F.col("e.said").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """All conversations, and conversation -1, rebuilt from their logs, rendered into the shared folder,
    and read back."""
    spark: SparkSession = conversations.sparkSession
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(own)
    log, path = materialize(log_of(rows), "chat-log"), scratch(spark, "chat")
    render(fold(log, "conv_id", ["turn", "by", "digest", "copy", "step"]), "conv_id").write.parquet(path)
    return read_back(spark.read.parquet(path), "conv_id")
