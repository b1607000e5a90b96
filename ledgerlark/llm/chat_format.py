"""Chat formatting: typed content parts flattened into one training text per conversation.

Only DataFrame functions are used. A turn is rendered as

    <turn ROLE>BODY</turn>\\n

and every control string begins with ``<``. Inside roles and texts ``\\`` becomes ``\\b``, ``<`` becomes
``\\l`` and ``>`` becomes ``\\g``, so no text can hold a control string and the rendering can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:bigint>"
CONTENT = f"array<{PART}>"
TURN_END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(
        F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g")
    )


def unescape(text: Column) -> Column:
    # every backslash of an escaped text begins an escape, so the order below is safe
    return F.replace(
        F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\")
    )


def text_content(text: Column) -> Column:
    """A plain text as content of one text part (null: the empty text)."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(0).cast("bigint").alias("units"),
    )
    return F.array(part)


def _visit(part: Column, tokens_per_unit: dict[str, int]) -> Column:
    """What one part becomes: its rendered string, its expanded token count and its attachment reference."""
    kind, units = F.coalesce(part["kind"], F.lit("text")), F.coalesce(part["units"], F.lit(1))
    words = F.size(F.filter(F.split(F.coalesce(part["text"], F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    attached = kind.isin(*tokens_per_unit) | ((kind != "text") & part["ref"].isNotNull())
    tokens = F.when(attached, units).otherwise(words.cast("bigint"))
    for name, rate in tokens_per_unit.items():
        tokens = F.when(kind == name, units * rate).otherwise(tokens)
    body = F.when(attached, F.concat(F.lit("<"), escape(kind), F.lit("/>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit("")))
    )
    return F.struct(
        body.alias("body"),
        tokens.alias("tokens"),
        attached.alias("attached"),
        kind.alias("kind"),
        part["ref"].alias("ref"),
    )


def format_chats(
    turns: DataFrame,
    loss_roles: tuple[str, ...] = ("assistant",),
    tokens_per_unit: dict[str, int] | None = None,
) -> DataFrame:
    """One row per conversation from turn rows (conv_id, turn, role, content).

    ``content`` is an array of parts (kind, text, ref, units); kinds named in ``tokens_per_unit`` (image,
    audio and document by default) become the placeholder ``<kind/>`` in order, and their references
    and expanded token counts (units times the rate) are recorded. A part of any other kind that has a reference
    is an attachment as well, of one token per unit; without a reference it counts as text.

    Returns conv_id, formatted, spans (per turn, in order: start of the turn, start and length of its
    body in code points, and whether it bears loss), attachments (turn, kind, ref, tokens in order of their
    placeholders), n_tokens (expanded). Turns are ordered by turn, then role, then text, nulls first, so ties
    and repeated rows have one result (each repeated row is a turn). A null role or text is empty, null
    or empty content is an empty body, a null conv_id is a conversation of its own. Extra columns are
    ignored. No rows give no rows. A conversation is one value of the result and so is put together in
    one task; everything before that is done per turn.
    """
    rates = {"image": 256, "audio": 25, "document": 512} if tokens_per_unit is None else tokens_per_unit
    content = F.coalesce(turns["content"], F.array().cast(CONTENT))
    seen = turns.select(
        "conv_id",
        "turn",
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.transform(content, lambda p: _visit(p, rates)).alias("parts"),
    )
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    body = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    attached = F.transform(
        F.filter("parts", lambda p: p["attached"]), lambda p: F.struct(p["kind"], p["ref"], p["tokens"])
    )
    rendered = seen.select(
        "conv_id",
        "turn",
        "role",
        head.alias("head"),
        body.alias("body"),
        attached.alias("attached"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["tokens"]).alias("tokens"),
    )
    length = F.length("head") + F.length("body") + len(TURN_END)
    before = (
        Window.partitionBy("conv_id")
        .orderBy("turn", "role", "body", "attached")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rendered.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint"))
    one = F.struct(
        "start",
        (F.col("start") + F.length("head")).alias("body_start"),
        F.length("body").cast("bigint").alias("length"),
        F.col("role").isin(*loss_roles).alias("loss"),
        F.concat("head", "body", F.lit(TURN_END)).alias("piece"),
        "turn",
        "attached",
        "tokens",
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    span = lambda t: F.struct(t["start"], t["body_start"], t["length"], t["loss"])
    references = F.transform(
        "turns",
        lambda t: F.transform(
            t["attached"],
            lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
        ),
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", span).alias("spans"),
        F.flatten(references).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda acc, t: acc + t["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, body, text) that a rendering holds, from its control strings alone.

    ``body`` still has escapes and placeholders; ``text`` is the body without placeholders, unescaped.
    """
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, ">", 1).substr(F.lit(7), F.length(p))
    body = lambda p: p.substr(F.length(F.substring_index(p, ">", 1)) + 2, F.length(p))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(role(p)).alias("role"),
            body(p).alias("body"),
            unescape(F.regexp_replace(body(p), "<[^>]*/>", "")).alias("text"),
        ),
    )


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between.

    Each span is cut from its own turn's piece, so the work is linear in the rendering.
    """
    pieces = F.split(formatted, "(?<=</turn>\n)", -1)
    masked = F.transform(
        spans,
        lambda s, i: F.when(
            s["loss"],
            F.get(pieces, i).substr((s["body_start"] - s["start"] + 1).cast("int"), s["length"].cast("int")),
        ).otherwise(""),
    )
    return unescape(F.array_join(masked, ""))
