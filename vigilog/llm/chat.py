"""Operator 7: chat logs folded into final messages and rendered, with DataFrame functions only.

An event log has one row per event of a message: `message` and `edit` set its text, `regenerate`
starts it anew, `delta` appends. Events are grouped by conversation and message, sorted by their
sequence, and folded: the text is what the last setting event gave plus the deltas after it. The
messages are then rendered in order. In texts and roles the characters that the template's marks
are made of are written as references, so no text can imitate a mark and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn; they may use `<`, `>`, `[` and `]`, and no two may be equal."""

    begin: str = "<s>[INST "
    middle: str = "] "
    end: str = " [/INST]</s>"


#: Character -> reference; the escape's own mark is first to be written and last to be read.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
TEMPLATE = Template()


def escape(text: Column) -> Column:
    for plain, reference in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def unescape(text: Column) -> Column:
    for plain, reference in reversed(_ESCAPES):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return text


def as_events(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished turns as an event log: every row is a `message` event of its own.

    Messages are numbered from 0 by turn, role and text, nulls last as in SQL, so rows of the same
    or of no turn stay separate messages.
    """
    order = Window.partitionBy(conversation).orderBy(
        *(F.col(c).asc_nulls_last() for c in (turn, role, text)))
    return rows.select(F.col(conversation).alias("conv_id"),
                       (F.row_number().over(order) - 1).cast("bigint").alias("message"),
                       F.col(turn).alias("seq"), F.lit("message").alias("kind"),
                       F.col(role).alias("role"), F.col(text).alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) from (conv_id, message, seq, kind, role, text).

    Equal events count once, as logs are delivered again. Events of equal sequence go in the order
    of kind, role and text; nulls come first. A null text is empty, a null kind is a `message`, a
    null conversation is a conversation of its own. The role is the last one given, else empty.
    Only one message's events are gathered in a row, never a conversation's.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"),
                     F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    log = (events.groupBy("conv_id", "message").agg(F.collect_set(event).alias("e"))
           .withColumn("e", F.array_sort("e")))
    places = F.sequence(F.lit(1), F.size("e"))
    sets = F.filter(places, lambda i: F.get("e", i - 1)["kind"] != "delta")
    start = F.coalesce(F.array_max(sets), F.lit(1))
    told = F.filter("e", lambda x: x["role"] != "")
    return log.select(
        "conv_id", "message",
        F.coalesce(F.try_element_at(told, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("e", start, F.size("e")), lambda x: x["text"]), "")
        .alias("text"))


def render(messages: DataFrame, template: Template = TEMPLATE,
           learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) with one row per conversation.

    `loss` marks the code points to learn from: for every turn the range (start, length) within
    the rendering of that turn (from 0), null where the turn's role is not in `learn`.
    A turn is escaped where it lies; the conversation is joined in one sorted aggregate.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(template.begin), role, F.lit(template.middle))
    order = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first())
    turns = messages.select(
        "conv_id", (F.row_number().over(order) - 1).alias("turn"),
        F.concat(head, text, F.lit(template.end)).alias("piece"),
        F.when(F.col("role").isin(*learn), F.struct(
            F.length(head).cast("bigint").alias("start"),
            F.length(text).cast("bigint").alias("length"))).alias("mask"))
    joined = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "piece", "mask"))).alias("t"))
    return joined.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("t", lambda x: x["mask"]).alias("loss"))


def turns_of(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The renderings of a conversation's turns, cut at the template's marks."""
    parts = F.split(formatted, "\\Q" + template.end + "\\E", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1),
                       lambda p: F.concat(p, F.lit(template.end)))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    def one(turn: Column) -> Column:
        role = F.substring_index(
            F.substring(turn, len(template.begin) + 1, 1 << 30), template.middle, 1)
        text = F.substr(turn, F.length(role) + len(template.begin) + len(template.middle) + 1,
                        F.length(turn) - F.length(role) - len(template.begin)
                        - len(template.middle) - len(template.end))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns_of(formatted, template), one)


def loss_text(formatted: Column, loss: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    masked = F.zip_with(turns_of(formatted, template), loss, lambda t, m: F.when(
        m.isNotNull(), F.substr(t, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return unescape(F.array_join(masked, ""))
