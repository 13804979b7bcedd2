"""Chat formatting: typed content parts flattened to one template string per conversation.

Main path: DataFrame functions only. Each turn is formatted on its own row (so long conversations cost
no more than their text), given its offset by a running sum, and the turns of a conversation are joined
at the end, in order.

Template of a turn:  <|im_start|>ROLE \\n CONTENT <|im_end|> \\n

A control string inside a text is defused by one more backslash: '<', n backslashes, '|' becomes '<',
n + 1 backslashes, '|'. No '<|' is left, and taking one backslash away from each such run gives the text
back. In a role, '%', line feed and '<' become %25, %0A and %3C.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"

#: Tokens that one unit of a part expands to: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def _by_type(part: Column, text, attachment, other) -> Column:
    """The visitor: what a part gives, by its type."""
    kind = F.coalesce(part["type"], F.lit("text"))
    chosen = F.when(kind == "text", text(part))
    for name in TOKENS_PER_UNIT:
        chosen = chosen.when(kind == name, attachment(part, name))
    return chosen.otherwise(other(part))


def _placeholder(part: Column, kind: str) -> Column:
    return F.concat(F.lit(f"<|{kind}:"), F.coalesce(part["units"], F.lit(1)).cast("string"), F.lit("|>"))


def format_turns(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, role, body, attachments, n_tokens_expanded, segment and offset.

    turns has conv_id, turn, role, text; further columns are ignored. With `parts`, that column (PARTS)
    is the content, visited in order: text parts are escaped and joined, an image, audio or document part
    leaves a placeholder <|type:units|> and an attachment (type, ref, units, tokens, at) where `at` is its
    place in the order of the turn's parts; a part of an unknown type is kept as escaped text. Null parts
    array, null part or null text: empty; null units: 1. Null role: empty. Turns are ordered by turn (null
    first), then role and text; rows that repeat a turn all stay. offset is the turn's first code point in
    its conversation; tied identical rows share their places in either order.
    """
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))
    content = F.filter(F.coalesce(content.cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    plain = lambda p: escape(F.coalesce(p["text"], F.lit("")))
    body = F.array_join(F.transform(content, lambda p: _by_type(p, plain, _placeholder, plain)), "")
    units = lambda p: F.coalesce(p["units"], F.lit(1).cast("bigint"))
    kept = lambda p, kind, i: F.struct(F.lit(kind).alias("type"), p["ref"].alias("ref"), units(p).alias("units"), (units(p) * TOKENS_PER_UNIT[kind]).alias("tokens"), i.alias("at"))
    attachments = F.filter(F.transform(content, lambda p, i: _by_type(p, lambda _: F.lit(None), lambda q, kind: kept(q, kind, i), lambda _: F.lit(None))), lambda a: a.isNotNull())
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text") if not parts else F.lit("").alias("text"), body.alias("body"), attachments.alias("attachments"))
    rows = rows.withColumn("segment", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), F.col("body"), F.lit(END), F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "body")
    so_far = F.sum(F.length("segment").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("conv_id", F.row_number().over(order).alias("seq"), "turn", "role", "body", "attachments", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("n_tokens_expanded"), "segment", (so_far - F.length("segment")).alias("offset"))


def format_chat(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, formatted, attachments, n_tokens_expanded.

    A conversation is one value of conv_id (null is one, too). See format_turns() for the turns; an empty
    table gives no rows.
    """
    rows = format_turns(turns, parts).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "attachments"))).alias("t"), F.sum("n_tokens_expanded").alias("n_tokens_expanded"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"), F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"), "n_tokens_expanded")


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> from a formatted conversation: the inverse of format_chat for text parts."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.regexp_replace(F.regexp_replace(x, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", "")
    return F.transform(pieces, lambda x: F.struct(unescape_role(head(x)).alias("role"), unescape(body(x)).alias("text")))


def loss_texts(turns: Column, role: str = "assistant") -> Column:
    """The texts under the loss mask: those of `role`, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"])
