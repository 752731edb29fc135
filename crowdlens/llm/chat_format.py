r"""Chat formatting with typed content parts; DataFrame functions only.

A turn's parts are visited in order: text stays text, an image, audio or document part becomes a numbered placeholder, its
reference goes to the attachment list with the number of model tokens it expands to.  The template is

    <|turn:role|>text<|end|>\n

and no role or text can forge it, nor can several parts together: a backslash is put before every backslash, before every | of a
role, and before every | of a text that follows a < or begins a part.  Reading back drops each first backslash, so that escaping
is exactly reversible.  Placeholders are written by the formatter as <|image:1|>; the same string in a text is escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

END = "<|end|>\n"
# possessive, so that a role of any length takes no stack
_HEAD = r"(?s)^<\|turn:([^\\|]*+(?:\\.[^\\|]*+)*+)\|>"
#: A content part.  width and height are pixels, seconds the length of audio, pages those of a document.
PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])
#: Tokens: one per image patch of PATCH x PATCH pixels, so many per second of audio and per page.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 1024
MEDIA = ("image", "audio", "document")


def escape(text: Column) -> Column:
    """Null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\\|(?<=<)\||^\|", r"\\$0")


def head(role: Column) -> Column:
    return F.concat(F.lit("<|turn:"), F.regexp_replace(role, r"[\\|]", r"\\$0"), F.lit("|>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A turn's only part, from a plain text column."""
    values = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields]))


def part_tokens(part: Column) -> Column:
    """Model tokens that a part which isn't text expands to; a missing measure counts as one unit."""
    tiles = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / PATCH)
    image = tiles(part["width"]) * tiles(part["height"])
    audio = F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * AUDIO_TOKENS)
    document = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(0)) * PAGE_TOKENS
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", document).otherwise(0).cast("long")


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*MEDIA), F.lit(False))


def _visit(parts: Column, before: Column) -> Column:
    """Each part of a turn as its piece of text and, if it isn't text, its attachment; media are numbered on from `before`.

    A part of unknown type is taken for text."""
    number = lambda i: before + F.size(F.filter(F.slice(parts, F.lit(1), i + 1), _is_media))
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(_is_media(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), number(i).cast("string"), F.lit("|>"))).otherwise(escape(p["text"])).alias("piece"),
            F.when(_is_media(p), F.struct(number(i).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("attachment"),
        ),
    )


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, and parts or text): conv_id, n_turns, formatted, loss_spans,
    attachments and expanded_tokens.

    A column parts counts if it is an array of structs with PART's fields; one of another kind is ignored like other columns.

    loss_spans are (start, length) of the `trained` role's bodies in `formatted`, 0-based code points.  attachments are
    (number, turn_no, type, ref, tokens) in order; expanded_tokens is their sum.  Turns are ordered by turn, null first, then
    role and parts, so that repeated turn numbers have one order; repeated rows are turns of their own.  A null role or
    text is empty, null parts are skipped, other columns are ignored.  Rows with a null conv_id form one conversation.  A
    conversation, which is one row of the result, is held by one task; different ones are dealt out by their id."""
    typed = "parts" in turns.columns and isinstance(kind := turns.schema["parts"].dataType, T.ArrayType) and isinstance(kind.elementType, T.StructType) and set(PART.names) <= set(kind.elementType.names)
    parts = F.filter(F.coalesce("parts", F.array()), lambda p: p.isNotNull()) if typed else text_part(F.col("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("visited", _visit(F.col("parts"), so_far(F.size(F.filter("parts", _is_media)))))
    rows = rows.withColumn("head", head(F.col("role"))).withColumn("body", F.array_join(F.col("visited")["piece"], ""))
    rows = rows.withColumn("at", so_far((F.length("head") + F.length("body") + len(END)).cast("long")) + F.length("head"))
    span = F.when(F.col("role") == trained, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    media = F.transform(F.filter(F.col("visited")["attachment"], lambda a: a.isNotNull()), lambda a: F.struct(a["number"].alias("number"), F.col("no").alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    turn = F.struct("no", F.concat("head", "body", F.lit(END)).alias("text"), span.alias("span"), media.alias("media"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    listed = F.flatten(F.col("t")["media"])
    return chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.col("t")["text"], "").alias("formatted"),
        F.filter(F.col("t")["span"], lambda x: x.isNotNull()).alias("loss_spans"),
        listed.alias("attachments"),
        F.aggregate(listed, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) in a formatted text, unescaped; placeholders stay as they are."""
    raw = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.slice(raw, 1, F.size(raw) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.regexp_extract(t, _HEAD, 1)).alias("role"), unescape(F.regexp_replace(t, _HEAD, "")).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    read = formatted.withColumn("read", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
