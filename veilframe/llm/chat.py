"""Chat formatting: typed content parts become one text for each conversation, and are read back.

A message holds parts: text, image, audio or document. A visitor (one branch for each kind) turns a
part into text: escaped text, or a placeholder in its place; what the placeholder stands for is
listed in order as an attachment, with the tokens that it expands to. The template marks turns:

    <|turn|>role<|text|>parts<|end|>

Texts and roles are escaped so that no "<" is left in them ("\\" becomes "\\b", then "<" becomes "\\l"),
which makes every marker in the output one that the template wrote, and unescaping exact.

Everything runs as DataFrame functions; one conversation is one row of the output.

Defined results: turns are ordered by turn, then role, then parts (null first), and repeated rows
stay; a null role or text is empty; parts that are null are no parts; a part of an unknown kind
with text counts as text, without text as a placeholder <|other|> of no tokens; rows with a null
conv_id form one conversation; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that a placeholder expands to: one for each started square of pixels, each part of a second, each page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
KINDS = ("image", "audio", "document")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).alias(n) for n in ("uri", "width", "height", "seconds", "pages")))).cast(f"array<{PART}>")


def _written(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    known = F.concat(F.lit("<|"), kind, F.lit("|>"))
    return F.when(kind.isin(*KINDS), known).when(part["text"].isNull() & (kind != "text"), F.lit("<|other|>")).otherwise(escaped(part["text"]))


def _tokens(part: Column) -> Column:
    whole = lambda x, unit: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(unit)).cast("long")
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    return (
        F.when(kind == "image", whole(part["width"], IMAGE_PATCH) * whole(part["height"], IMAGE_PATCH))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE).cast("long"))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0).cast("long"))
    )


def _attached(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    return kind.isin(*KINDS) | (part["text"].isNull() & (kind != "text"))


def format_chat(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, attachments (in the order of their placeholders) and loss (code points [start, end) of what learn says)."""
    live = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    row = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), live.alias("parts"))
    row = row.select(
        "conv_id",
        F.struct(
            "turn", "role",
            F.concat_ws("", F.transform("parts", _written)).alias("body"),
            F.transform(F.filter("parts", _attached), lambda p: F.struct(F.lower(p["kind"]).alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens"))).alias("attached"),
        ).alias("m"),
    )
    talk = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    head = lambda m: F.concat(F.lit(TURN), escaped(m["role"]), F.lit(TEXT))
    written = F.transform("m", lambda m: F.struct(head(m).alias("head"), m["body"].alias("body"), (m["role"] == learn).alias("learn")))
    talk = talk.select("conv_id", F.flatten(F.transform("m", lambda m: m["attached"])).alias("attachments"), written.alias("t"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        spans = F.when(t["learn"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return talk.select(
        "conv_id",
        F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
        "attachments",
        F.aggregate("t", empty, advance)["spans"].alias("loss"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role,text>>, unescaped; placeholders stay as they are written."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def read(x: Column) -> Column:
        head = F.substring_index(x, TEXT, 1)
        role = F.substr(head, F.lit(len(TURN) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(x, F.length(head) + len(TEXT) + 1)).alias("text"))

    return F.transform(turns, read)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))))
