"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor turns the parts of each turn into one string: text is escaped, and image, audio and document
parts become placeholders in their order. What a placeholder stands for is recorded as an
attachment with its reference and the number of tokens it expands to. Turns are laid end to end:

    <|turn|>role<|text|>content<|end|>\\n

Control strings inside roles and texts get a backslash behind their first character, backslashes are
doubled; `unescaped` takes both back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<kind:string,text:string,ref:string,units:double>>"
#: Tokens for each unit of a part: an image tile, a second of audio, a page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 600}
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What must not appear unescaped inside a turn: anything like the marks above, and common marks of others.
_REST = r"(\||s>|/s>|INST\]|/INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + _REST, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + _REST, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part; null counts as empty."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            null.cast("string").alias("ref"),
            null.cast("double").alias("units"),
        )
    ).cast(PART)


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*TOKENS), F.lit(False))


def _visited(part: Column) -> Column:
    """The string that a part becomes; parts of unknown kinds count as their text."""
    mark = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
    return F.when(_attached(part), mark).otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for kind, each in TOKENS.items():
        rate = F.when(part["kind"] == kind, each).otherwise(rate)
    units = F.when(part["units"] > 0, part["units"]).otherwise(1.0)
    return F.ceil(rate * units).cast("long")


def format_conversations(rows: DataFrame, parts: Column | None = None) -> DataFrame:
    """One formatted string per conversation with its loss mask and attachments.

    rows: conv_id, turn, role and text, or any column of parts (array of kind, text, ref, units) given as
    `parts`. Turns are laid in the order of turn (null first), then role and content; repeated rows are
    turns of their own. Null roles and texts are empty, a turn without parts has empty content, and a null
    conv_id is a conversation. Returns conv_id, formatted, loss_spans (code points from and to, of each
    assistant's content), attachments (place in the conversation, turn, kind, ref, tokens), expanded_tokens.

    A conversation becomes one row, so all of its turns meet in one task.
    """
    parts = text_parts(F.col("text")) if parts is None else F.coalesce(parts, F.array().cast(PART)).cast(PART)
    turns = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")
    )
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turns = turns.select(
        "conv_id",
        "turn",
        "role",
        head.alias("head"),
        F.array_join(F.transform("parts", _visited), "").alias("content"),
        F.transform(
            F.filter("parts", _attached),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
        ).alias("held"),
    ).withColumn("piece", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece", "held")
    ahead = F.coalesce(
        F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) + F.length("head")
    placed = turns.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("place"),
            F.col("turn"),
            F.col("piece"),
            F.when(F.col("role") == "assistant", F.struct(ahead.alias("start"), (ahead + F.length("content")).alias("end"))).alias("span"),
            F.col("held"),
        ).alias("t"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    attachments = F.flatten(
        F.transform("turns", lambda t: F.transform(t["held"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform(
            attachments,
            lambda a, i: F.struct(
                (i + 1).alias("place"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
            ),
        ).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text); placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n"), 1, F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
            unescaped(F.substring(p, F.length(F.substring_index(p, TEXT, 1)) + len(TEXT) + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )


def chat_digests(output: DataFrame) -> DataFrame:
    """Digests of formatted conversations, worked out from the formatted strings and masks alone."""
    turns = parsed_turns(F.col("formatted"))
    read = output.select("conv_id", "formatted", turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("attachments").alias("n_attachments"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
