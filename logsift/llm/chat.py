"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds ordered parts: text, image, audio or document. A visitor turns each part into what
the template shows (escaped text, or one placeholder), notes a reference for each attachment and the
number of tokens its placeholder will be expanded to. Messages become

    <|im_start|>ROLE NEWLINE SHOWN<|im_end|> NEWLINE

and the loss mask holds the code-point spans of the assistants' content. Texts and roles cannot
forge control strings: backslash becomes ``\\b``, ``<|`` becomes ``<\\p`` and, in roles, a newline
becomes ``\\n``, so an escaped string holds no ``<|`` and every backslash starts one of these codes.

A conversation is formatted in blocks of ``TURNS`` turn numbers; offsets in mask and attachments
count from the block's start. Blocks keep work bounded for long conversations: only what must see a
whole conversation (a digest) joins its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = 64
START, END = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type string, text string, ref string, width int, height int, seconds double, pages int>"
#: Pixels of a patch side, audio tokens a second, tokens of a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def text_part(text: str | Column) -> Column:
    """Parts column of a message that is one text; a null text is the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    empty = [F.lit(None).cast(t).alias(n) for n, t in
             (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"), *empty)
                   .cast(PART))


def _at_least(c: Column, least: int) -> Column:
    return F.greatest(F.coalesce(c, F.lit(least)), F.lit(least)).cast("long")


def visit(part: Column) -> Column:
    """What one part shows, and for an attachment its kind, reference and expanded tokens.

    Unknown or null types are texts. Missing sizes count as the smallest (one patch, one page, no
    sound); a null part shows nothing.
    """
    kind = F.when(part["type"].isin(*PLACEHOLDER), part["type"])
    shown = F.lit(None).cast("string")
    for name, mark in PLACEHOLDER.items():
        shown = F.when(part["type"] == name, F.lit(mark)).otherwise(shown)
    tokens = (F.when(kind == "image", _at_least(F.ceil(part["width"] / PATCH), 1) * _at_least(F.ceil(part["height"] / PATCH), 1))
              .when(kind == "audio", _at_least(F.ceil(part["seconds"] * AUDIO_RATE), 0))
              .when(kind == "document", _at_least(part["pages"], 1) * PAGE_TOKENS))
    return F.struct(F.coalesce(shown, escape(F.coalesce(part["text"], F.lit("")))).alias("shown"),
                    kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("n_tokens"))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts", learned: str = "assistant", turns: int = TURNS) -> DataFrame:
    """``(conv_id, block, n_turns, formatted, mask, attachments, n_attachment_tokens)`` per block.

    Rows follow by turn, null turns first in a block of their own; rows of the same turn follow by
    role and content, repeated rows all stay. Null role, text or parts are empty; null conversation
    ids form one conversation; other columns are ignored. Empty table: no rows.
    ``mask array<struct<start,end>>``: spans of the learned role's content, also when empty.
    ``attachments array<struct<turn,start,end,kind,ref,n_tokens>>``: placeholders in order.
    """
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visit).alias("seen"))
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    m = m.select("conv_id", F.coalesce(F.floor(F.col("turn") / turns), F.lit(-(1 << 62))).cast("long").alias("block"),
                 "turn", "role", head.alias("head"), "seen",
                 F.array_join(F.transform("seen", lambda p: p["shown"]), "").alias("shown"))
    size = F.length("head") + F.length("shown") + F.lit(len(END))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "shown", F.xxhash64("seen"))
    m = m.withColumn("n", F.row_number().over(order)) \
        .withColumn("at", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    start = F.col("at") + F.length("head")
    # Placeholders of one message: positions run over its parts.
    run = F.aggregate("seen", F.struct(start.cast("long").alias("pos"), F.array().cast(
        "array<struct<turn long, start long, end long, kind string, ref string, n_tokens long>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p["shown"])).alias("pos"),
            F.when(p["kind"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                F.col("turn"), acc["pos"].alias("start"), (acc["pos"] + F.length(p["shown"])).alias("end"),
                p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))))).alias("out")),
        lambda acc: acc["out"])
    message = F.struct("n", F.concat("head", "shown", F.lit(END)).alias("piece"),
                       F.when(F.col("role") == learned, F.struct(start.alias("start"), (start + F.length("shown")).alias("end")))
                       .alias("span"),
                       F.when(F.exists("seen", lambda p: p["kind"].isNotNull()), run)
                       .otherwise(F.array().cast("array<struct<turn long, start long, end long, kind string, ref string,"
                                                 " n_tokens long>>")).alias("refs"))
    got = m.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(message)).alias("ms"))
    return got.select(
        "conv_id", "block", F.size("ms").cast("long").alias("n_turns"),
        F.array_join(F.transform("ms", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("ms", lambda x: x["span"]), lambda s: s.isNotNull()).alias("mask"),
        F.flatten(F.transform("ms", lambda x: x["refs"])).alias("attachments")).withColumn(
        "n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["n_tokens"]))


def read_back(formatted: str | Column) -> Column:
    """``array<struct<role,text>>`` of a formatted block: the inverse of the template for texts."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.filter(F.split(c, "<\\|im_end\\|>\n"), lambda p: p != "")

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.replace(head, F.lit(START), F.lit("")), role=True).alias("role"),
                        unescape(p.substr(F.length(head) + 2, F.length(p))).alias("text"))
    return F.transform(pieces, turn)


def under_mask(formatted: str = "formatted", mask: str = "mask") -> Column:
    """The unescaped texts that the loss mask covers, in order."""
    return F.transform(mask, lambda s: unescape(F.col(formatted).substr(
        (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
