"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events (conv_id, seq, kind, turn, role, text):
  start       opens message `turn` with a role and a first piece of text
  delta       appends text to it
  edit        replaces its text; later deltas append to that
  regenerate  drops its text and every message of a higher turn that was opened before this event; later deltas rebuild it
Events of a conversation are ordered by seq (ties: by kind, text) and folded message by message, so that a long log is spread by
(conversation, turn); only the finished text of a conversation, which is one value of the result, comes together in one row.

Template, for each message: `### ROLE: TEXT</turn>` and a line feed, where role and text are escaped: a backslash becomes `\\b`, `#` `\\h`, `<` `\\l`,
and in roles `:` `\\c`. So neither marker can occur inside a text, and unescape(escape(x)) = x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, GAP, CLOSE = "### ", ": ", "</turn>\n"
_RESETS = ("start", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts a code, so codes can be replaced one kind after another, the backslash's last."""
    for coded, plain in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def events_of(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as the log that a client would have streamed: a start with the first half of the text and a delta with the rest.

    Rows that share a turn are separate messages, by role and text; null turns come first; null roles and texts are empty.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda step, kind, text: F.struct((2 * F.col("turn") + step).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    pieces = F.array(event(0, "start", F.substring("text", F.lit(1), half)), event(1, "delta", F.substring("text", half + 1, F.length("text"))))
    return rows.select("conv_id", "turn", "role", F.explode(pieces).alias("e")).select("conv_id", "e.seq", "e.kind", "turn", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """A log to its final messages (conv_id, turn, role, text). An event with a null text adds nothing; deltas without a start make a message with an empty role."""
    is_reset = F.col("kind").isin(*_RESETS)
    resets = events.groupBy("conv_id", "turn").agg(F.max(F.when(is_reset, F.col("seq"))).alias("reset"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"), F.max(F.when(F.col("kind") == "start", F.col("seq"))).alias("opened"), F.min("seq").alias("first"))
    lower = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    alive = resets.withColumn("dropped", F.max("again").over(lower)).where("dropped is null or coalesce(opened, first) > dropped")
    alive = alive.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reset")
    kept = events.join(alive, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).where("reset is null or seq >= reset or kind = 'start'")
    piece = F.when((F.col("reset").isNull()) | (F.col("seq") >= F.col("reset")), F.when(F.col("kind") != "regenerate", F.col("text")))
    grouped = kept.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "start", F.struct("seq", "role"))).alias("start"), F.collect_list(F.struct("seq", "kind", F.coalesce(piece, F.lit("")).alias("text"))).alias("pieces"))
    return grouped.select("conv_id", "turn", F.coalesce("start.role", F.lit("")).alias("role"), F.array_join(F.transform(F.array_sort("pieces"), lambda p: p.text), "").alias("text"))


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """Final messages to one row (conv_id, formatted, loss_spans) for each conversation.

    loss_spans: the text of each message of the learned role, as (message number from 0, first character in its message from 1, characters).
    """
    said = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(GAP), escape(F.col("text")), F.lit(CLOSE))
    rows = messages.select("conv_id", F.struct("turn", "role", said.alias("said"), F.length(escape(F.col("text"))).alias("size")).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    span = lambda m, i: F.when(m.role == learned_role, F.struct(i.alias("message"), (F.length(m.said) - len(CLOSE) - m["size"] + 1).alias("first"), m["size"].alias("size")))
    return chats.select("conv_id", F.array_join(F.transform("ms", lambda m: m.said), "").alias("formatted"), F.filter(F.transform("ms", span), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """A formatted conversation back to its messages: an array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    body = lambda p: F.substring(p, len(OPEN) + 1, 2_147_483_647)
    split_at = lambda p: F.instr(body(p), GAP)
    message = lambda p: F.struct(unescape(body(p).substr(F.lit(1), split_at(p) - 1)).alias("role"), unescape(body(p).substr(split_at(p) + len(GAP), F.lit(2_147_483_647))).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), message)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.split(formatted, CLOSE)
    return F.array_join(F.transform(spans, lambda s: unescape(F.get(parts, s.message).substr(s["first"], s["size"]))), "")


def format_conversations(events: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """A log to (conv_id, formatted, loss_spans); see the module's text. An empty log gives no rows; a null conv_id is a conversation of its own."""
    return render(fold(events), learned_role)
