"""Conversations of typed parts to training text, in columns only.

A visitor turns each part of a message into text: text parts are escaped, image, audio and document parts become
placeholders in their order, recorded as attachments with the tokens that a placeholder stands for. Messages are wrapped in
the marks of their role and joined per conversation; the loss mask covers what assistants say, as spans of code points.
`turns` and `loss_text` read the output back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TEXT, OTHER = "text", "[FILE]"
BEGIN, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "[SYS]", "[/SYS]"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"

PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("ref", T.StringType()),
            T.StructField("width", T.LongType()),
            T.StructField("height", T.LongType()),
            T.StructField("seconds", T.DoubleType()),
            T.StructField("pages", T.LongType()),
        ]
    )
)


@dataclass(frozen=True)
class Tokens:
    """What placeholders stand for: an image one token per patch, audio a rate per second, a document so many per page."""

    patch: int = 28
    unknown_image: int = 576
    per_second: float = 25.0
    unknown_audio: int = 750
    per_page: int = 768

    def image(self, part: Column) -> Column:
        def patches(side: Column) -> Column:
            return F.ceil(F.when(side > 0, side) / F.lit(self.patch))

        return F.coalesce(patches(part["width"]) * patches(part["height"]), F.lit(self.unknown_image))

    def audio(self, part: Column) -> Column:
        known = F.when((part["seconds"] >= 0) & (part["seconds"] < 1e12), part["seconds"])
        return F.coalesce(F.ceil(known * F.lit(self.per_second)), F.lit(self.unknown_audio))

    def document(self, part: Column) -> Column:
        return F.coalesce(F.when(part["pages"] >= 0, part["pages"]), F.lit(1)) * F.lit(self.per_page)


@dataclass(frozen=True)
class Template:
    """Placeholders and token counts by type of part; other types get the placeholder [FILE] and no tokens."""

    tokens: Tokens = field(default_factory=Tokens)

    def visitors(self) -> dict[str, tuple[str, Callable[[Column], Column]]]:
        return {
            "image": ("[IMG]", self.tokens.image),
            "audio": ("[AUDIO]", self.tokens.audio),
            "document": ("[DOC]", self.tokens.document),
        }

    def controls(self) -> list[str]:
        marks = [BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END, OTHER]
        return marks + [placeholder for placeholder, _ in self.visitors().values()]


def _by_lead(template: Template, backslash: str) -> str:
    """The place behind the first character of a control string with any number of backslashes in it."""
    leads = sorted({c[0] for c in template.controls()})
    rests = {lead: "|".join(re.escape(c[1:]) for c in template.controls() if c[0] == lead) for lead in leads}
    return "|".join(f"(?<={re.escape(lead)}){backslash}(?=\\\\*(?:{rest}))" for lead, rest in rests.items())


def escape(text: Column, template: Template = Template()) -> Column:
    """Control strings in a text get one more backslash behind their first character; nothing else changes."""
    return F.regexp_replace(text, F.lit(_by_lead(template, "")), F.lit("\\\\"))


def unescape(text: Column, template: Template = Template()) -> Column:
    """Undoes `escape`."""
    return F.regexp_replace(text, F.lit(_by_lead(template, "\\\\")), F.lit(""))


def _join(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def body(parts: Column, template: Template = Template()) -> Column:
    """Visited parts joined: runs of text parts are escaped as one text, so no control string arises where they meet."""
    outside = F.filter(F.transform(parts, lambda p, i: F.when(~p["type"].eqNullSafe(F.lit(TEXT)), i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), outside, F.array(F.size(parts)))

    def placeholder(part: Column) -> Column:
        mark = F.lit(OTHER)
        for kind, (held, _) in template.visitors().items():
            mark = F.when(part["type"] == kind, held).otherwise(mark)
        return F.when(part["type"].isNull(), OTHER).otherwise(mark)

    def run(k: Column) -> Column:
        first, last = F.get(edges, k), F.get(edges, k + 1)
        texts = F.transform(F.slice(parts, first + 2, last - first - 1), lambda p: F.coalesce(p["text"], F.lit("")))
        closing = F.when(last < F.size(parts), placeholder(F.get(parts, last))).otherwise("")
        return F.concat(escape(_join(texts), template), closing)

    return _join(F.transform(F.sequence(F.lit(0), F.size(outside)), run))


def attachments(parts: Column, template: Template = Template()) -> Column:
    """What the placeholders of a message stand for, in order: array<struct<kind, ref, tokens>>."""

    def recorded(part: Column) -> Column:
        tokens = F.lit(0).cast("long")
        for kind, (_, count) in template.visitors().items():
            tokens = F.when(part["type"] == kind, count(part).cast("long")).otherwise(tokens)
        return F.struct(part["type"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(F.filter(parts, lambda p: ~p["type"].eqNullSafe(F.lit(TEXT))), recorded)


def _parts(messages: DataFrame, content: str) -> Column:
    """The parts of a message with all their fields; a plain text is one text part, null is none."""
    kind = messages.schema[content].dataType
    if not isinstance(kind, T.ArrayType):
        text = F.coalesce(F.make_valid_utf8(F.col(content).cast("string")), F.lit(""))
        empty = {f.name: F.lit(None).cast(f.dataType) for f in PARTS.elementType}
        fields = empty | {"type": F.lit(TEXT), "text": text}
        return F.array(F.struct(*[value.alias(name) for name, value in fields.items()]))
    held = set(kind.elementType.names)

    def whole(part: Column) -> Column:
        fields = [
            (part[f.name].cast(f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in PARTS.elementType
        ]
        return F.struct(*fields)

    return F.coalesce(F.transform(F.filter(content, lambda p: p.isNotNull()), whole), F.array().cast(PARTS))


def format_conversations(
    messages: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    template: Template = Template(),
) -> DataFrame:
    """[conv_id, n_turns, formatted, loss, attachments, attachment_tokens], one row per conversation.

    content is a text or an array of part structs with some of the fields of PARTS. formatted: the marked and escaped turns;
    loss: array<struct<start, end>> of code points in it (end exclusive), one span per assistant turn; attachments:
    array<struct<place, kind, ref, tokens>> in the order of the placeholders, place being the turn's place from 0.

    Turns go by `turn`, nulls first; equal ones by role and text, so repeated rows stay as turns of their own. A null text or part
    list is an empty text, null parts are left out, a null type is one the template does not know; a null role is the empty role.
    Messages with a null conv_id form one conversation. Bytes that are no UTF-8 become U+FFFD. An empty table gives no rows.
    Other columns are ignored, whatever their names. A conversation is one value of a row, so it must fit into a task; its messages
    are escaped before they meet, its offsets are a running sum over spilled rows.
    """
    visited = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.make_valid_utf8(F.col(role)), F.lit("")).alias("role"),
        _parts(messages, content).alias("parts"),
    ).select("conv_id", "turn", "role", body(F.col("parts"), template).alias("body"), attachments(F.col("parts"), template).alias("held"))
    speaker = F.col("role")
    head = (
        F.when(speaker == "user", USER)
        .when(speaker == "assistant", "")
        .when(speaker == "system", SYSTEM)
        .otherwise(F.concat(F.lit(ROLE), escape(speaker, template), F.lit(ROLE_END)))
    )
    tail = F.when(speaker == "user", USER_END).when(speaker == "system", SYSTEM_END).otherwise(END)
    marked = visited.select(
        "conv_id", "turn", "role", "held", F.concat(head, "body", tail).alias("piece"), (speaker == "assistant").alias("learned"),
        F.char_length("body").cast("long").alias("n_body"),
    ).withColumn("n_piece", F.char_length("piece").cast("long"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "piece")
    before = F.coalesce(F.sum("n_piece").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + len(BEGIN)
    placed = marked.withColumns({"place": F.row_number().over(order) - 1, "start": before})
    spans = F.when(F.col("learned"), F.struct(F.col("start"), (F.col("start") + F.col("n_body")).alias("end")))
    held = F.transform("held", lambda a: F.struct(F.col("place").alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    message = F.struct("place", "piece", spans.alias("span"), held.alias("held"))
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("all"))
    return joined.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), _join(F.col("all.piece"))).alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss"),
        F.flatten("all.held").alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda total, n: total + n))


def turns(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read from a formatted conversation; placeholders stay in the text."""
    closing = "|".join(map(re.escape, (USER_END, SYSTEM_END, END)))
    pieces = F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), f"(?<={closing})", -1), lambda t: t != "")

    def inside(piece: Column, head: int, tail: str) -> Column:
        return F.substr(piece, F.lit(head + 1), F.char_length(piece) - F.lit(head + len(tail)))

    def read(piece: Column) -> Column:
        named = piece.startswith(F.lit(ROLE))
        rest = F.substring_index(piece, ROLE_END, -1)
        speaker = (
            F.when(piece.endswith(F.lit(USER_END)), "user")
            .when(piece.endswith(F.lit(SYSTEM_END)), "system")
            .when(named, unescape(F.substr(F.substring_index(piece, ROLE_END, 1), F.lit(len(ROLE) + 1)), template))
            .otherwise("assistant")
        )
        said = (
            F.when(piece.endswith(F.lit(USER_END)), inside(piece, len(USER), USER_END))
            .when(piece.endswith(F.lit(SYSTEM_END)), inside(piece, len(SYSTEM), SYSTEM_END))
            .otherwise(inside(F.when(named, rest).otherwise(piece), 0, END))
        )
        return F.struct(speaker.alias("role"), unescape(said, template).alias("text"))

    return F.transform(pieces, read)


def loss_text(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped. Four bytes per code point make a span a plain slice, however long the text."""
    wide = F.encode(formatted, "UTF-32")

    def cut(span: Column) -> Column:
        at, n = (span["start"] * 4 + 1).cast("int"), ((span["end"] - span["start"]) * 4).cast("int")
        # The leading byte order mark is eaten by the decoder; one that begins the text stays.
        return F.decode(F.concat(F.lit(bytes((0, 0, 0xFE, 0xFF))), F.substr(wide, at, n)), "UTF-32")

    return _join(F.transform(loss, lambda span: unescape(cut(span), template)))
