"""Operator 10: chat formatting with typed content parts.

A turn holds an ordered array of parts ``struct<type, text, ref, width,
height, seconds, pages>``. A visitor walks the parts of each turn in order:
text is escaped and kept; an image, audio or document becomes a placeholder,
its reference is recorded under the placeholder's running number, and the
tokens it will expand to are counted from its size. Turns are joined to one
text per conversation::

    <|turn|>ROLE<|text|>BODY<|end|>

where BODY is the turn's parts with ``<|part|>`` between two of them.
Control strings inside roles and texts are escaped by one backslash after
their first character; one that already carries backslashes gets one more, so
reading back (one backslash less) is exact for every text.

Everything is built-in column functions. The aggregation holds one
conversation's turns together, which is its output row; conversations are
never combined.

Defined results: null text is empty, null role is the empty role; turns order
by (turn, role, body), null turn first; a null conv_id is a conversation of
its own; an unknown part type is visited as text. A conversation without
turns has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What may follow the first character of a control string.
_TAIL = r"(?:\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>|/?INST\])"
_PLAIN = rf"([<\[])(\\*)(?={_TAIL})"
_ESCAPED = rf"([<\[])(\\*)\\(?={_TAIL})"

PART_TYPE = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
#: Side of an image patch, tokens per second of audio and per document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512


def escape(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, _PLAIN, r"$1$2\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def text_parts(text: Column) -> Column:
    """A turn's parts when it is one text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"),
                            null.cast("int").alias("width"), null.cast("int").alias("height"),
                            null.cast("double").alias("seconds"), null.cast("int").alias("pages"))).cast(PART_TYPE)


def _visit(part: Column) -> Column:
    """One part as (body, ref, kind, tokens)."""
    kind = F.when(part["type"].isin(*PLACEHOLDER), part["type"])
    body = escape(F.coalesce(part["text"], F.lit("")))
    for name, mark in PLACEHOLDER.items():
        body = F.when(part["type"] == name, F.lit(mark)).otherwise(body)
    tokens = (F.when(part["type"] == "image", F.ceil(F.coalesce(part["width"], F.lit(PATCH)) / PATCH)
                     * F.ceil(F.coalesce(part["height"], F.lit(PATCH)) / PATCH))
              .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
              .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
              .otherwise(0).cast("long"))
    return F.struct(body.alias("body"), F.when(kind.isNotNull(), part["ref"]).alias("ref"), kind.alias("kind"),
                    tokens.alias("tokens"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns``: conv_id, turn, role, parts (``PART_TYPE``). One row per
    conversation: conv_id, n_turns, formatted, loss_spans (start from 0 and
    length, in code points, of each ``loss_role`` body), attachments (kind,
    ref, tokens in order) and expanded_tokens (sum over attachments)."""
    seen = F.transform(F.coalesce("parts", F.array().cast(PART_TYPE)), _visit)
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), seen.alias("seen"))
    one = flat.select("conv_id", F.struct(
        "turn", "role", F.array_join(F.transform("seen", lambda p: p["body"]), PART).alias("body"),
        F.filter(F.transform("seen", lambda p: F.struct(p["kind"], p["ref"], p["tokens"])),
                 lambda p: p["kind"].isNotNull()).alias("attached")).alias("t"))
    conv = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    pieces = F.transform("ts", lambda t: F.struct(
        F.concat(head(t), t["body"], F.lit(END)).alias("s"), (t["role"] == loss_role).alias("loss"),
        F.length(head(t)).alias("before"), F.length(t["body"]).alias("n")))
    conv = conv.select("conv_id", "ts", pieces.alias("ps"))
    end = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate("ps", end, lambda acc, p: F.struct(
        (acc["at"] + p["before"] + p["n"] + len(END)).alias("at"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["before"]).alias("start"),
                                                                  p["n"].alias("length")))))
        .otherwise(acc["spans"]).alias("spans")))
    attachments = F.flatten(F.transform("ts", lambda t: t["attached"]))
    return conv.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("formatted"),
        walked["spans"].alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(F.transform(attachments, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda a, b: a + b)
        .alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    whole = F.split(formatted, _literal(END))
    body = F.slice(whole, 1, F.size(whole) - 1)
    return F.transform(body, lambda s: F.struct(
        unescape(F.substring_index(F.replace(s, F.lit(TURN), F.lit("")), TEXT, 1)).alias("role"),
        unescape_body(F.substring_index(s, TEXT, -1)).alias("text")))


def unescape_body(body: Column) -> Column:
    """A turn's text: its parts unescaped, placeholders as they are."""
    return F.array_join(F.transform(F.split(body, _literal(PART)), unescape), "")


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape_body(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def _literal(mark: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in mark)
