"""Chat formatting with typed content parts.

A turn's content is an array of parts (``PART``): text, image, audio or
document.  A visitor over the parts, one case per type, flattens them into one
string in order: text is escaped, every other part becomes a placeholder
``<image:0>``, ``<audio:1>``, ``<document:2>`` numbered within its turn, with an
attachment record (type, reference, number) and its expanded token count:

* image: ``IMAGE_TOKENS`` per started tile of ``TILE`` x ``TILE`` pixels;
* audio: ``AUDIO_TOKENS`` per started second;
* document: ``PAGE_TOKENS`` per page.

Missing sizes count as one tile, second or page.  A part of another type is a
``<unknown:n>`` placeholder of no tokens, so nothing is lost.

The template writes ``<s>[INST] role [/INST]``, a line break, the flattened
content, ``</s>`` and a line break for each turn.  In texts and roles the three
characters that could start a control string are written as ``\\0`` (backslash),
``\\1`` (``<``) and ``\\2`` (``[``); no raw ``<`` or ``[`` remains, so control
strings and placeholders only come from the template and reading back is exact.

Turns get their offsets from a running sum inside the conversation, then one
row per conversation is collected: that row is the result, and as long as the
conversation.  Copies of a conversation have other ids and do not meet.

Cases: null content is empty, a null role is empty, turns with equal numbers
follow by role and content, a null conversation id is one conversation, an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TILE, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 512, 170, 25, 600
# Fixed strings of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("[", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """Plain text as a single text part."""
    void = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in void.items()])
    )


def _tokens(part: Column) -> Column:
    tiles = F.ceil(F.coalesce(part["width"], F.lit(1)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(1)) / TILE)
    return (
        F.when(part["type"] == "image", tiles * IMAGE_TOKENS)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0))) * AUDIO_TOKENS)
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _numbered(parts: Column) -> Column:
    """The parts that are not text, in order; an attachment's number is its place here."""
    return F.filter(parts, lambda p: ~p["type"].eqNullSafe(F.lit("text")))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise(F.lit("unknown"))


def flatten(parts: Column) -> Column:
    """Visit the parts in order: escaped text and numbered placeholders, as one string."""
    number = lambda i: F.size(_numbered(F.slice(parts, 1, i)))
    visit = lambda p, i: F.when(
        p["type"].eqNullSafe(F.lit("text")), escape(F.coalesce(p["text"], F.lit("")))
    ).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(":"), number(i).cast("string"), F.lit(">")))
    return F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit(""))


def attachments(parts: Column) -> Column:
    """(kind, ref, number, tokens) of each part that is not text."""
    record = lambda p, i: F.struct(
        _kind(p).alias("kind"), p["ref"].alias("ref"), i.alias("number"), _tokens(p).alias("tokens")
    )
    return F.coalesce(F.transform(_numbered(parts), record), F.array().cast("array<struct<kind:string,ref:string,number:int,tokens:bigint>>"))


def format_chat(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation.

    ``formatted`` is the string; ``loss`` the (start, length) spans in code
    points, 0-based, of the content of ``loss_roles``; ``attachments`` lists
    (turn, kind, ref, number, tokens) in order; ``expanded_tokens`` sums them.
    """
    given = turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.col(parts_col).alias("parts"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    line = F.concat(head, flatten(F.col("parts")), F.lit(CLOSE))
    # Rows of one turn and role go by their parts as they were given, texts unescaped.
    whole = Window.partitionBy("id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = given.withColumn("chars", F.char_length(line)).withColumns(
        {"place": F.row_number().over(whole), "end": F.sum("chars").over(whole)}
    )
    placed = placed.withColumns({"body": flatten(F.col("parts")), "line": line, "files": attachments(F.col("parts"))})
    length = F.char_length("body").cast("long")
    span = F.struct((F.col("end") - len(CLOSE) - length).alias("start"), length.alias("length"))
    item = F.struct(
        "place", "line", F.when(F.col("role").isin(*loss_roles), span).alias("span"),
        F.transform("files", lambda f: F.struct(F.col("turn"), *[f[c].alias(c) for c in ("kind", "ref", "number", "tokens")])).alias("files"),
    )
    one = placed.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("t"))
    files = F.flatten(F.transform("t", lambda x: x["files"]))
    return one.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    lines = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)
    return F.transform(
        lines,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substr(x, F.locate(MIDDLE, x, 1) + F.lit(len(MIDDLE)))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under each loss span."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
