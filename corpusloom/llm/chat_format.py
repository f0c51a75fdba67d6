"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is an array of parts (PART): text, image, audio or document. A visitor over the array writes text
parts out, escaped, and each other part as a placeholder <kind:ordinal>; it records an attachment reference with the
placeholder's ordinal in its turn and the tokens that the placeholder expands to. A turn is written as

    ### role: content</turn>

and a newline. Backslash, < and # of texts (and : of roles) are escaped by a backslash and a letter, so a control
string can only come from the template, and the escaping is undone exactly. The loss mask covers the content of
assistant turns: spans of (turn, start, length) in characters of the written turn.

Null roles and texts count as empty, null parts and null part arrays as none, unknown kinds as documents with no
reference. Turns go by turn number, nulls first, then role and content, so ties and repeated rows have one order;
rows with a null conv_id are one conversation. Extra columns are not read. A conversation comes back as one row, as
its format asks; turns are written before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens of an expanded placeholder: an image's tiles and base, audio a second, documents a page; characters of a text token.
TILE, TILE_TOKENS, IMAGE_TOKENS, SECOND_TOKENS, PAGE_TOKENS, TEXT_CHARS = 512, 170, 85, 25, 500, 4


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(text, F.lit(":"), F.lit("\\c")) if role else text


def unescaped(text: Column) -> Column:
    """Split at doubled backslashes from the left: what remains in a piece is single escapes."""
    undo = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), undo), "\\")


def text_part(text: Column) -> Column:
    """A part array of one text."""
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def expanded_tokens(p: Column) -> Column:
    """Tokens that one part stands for."""
    tiles = lambda side: F.ceil(F.greatest(F.coalesce(side, F.lit(1)), F.lit(1)) / TILE)
    return (
        F.when(_is_text(p), F.ceil(F.octet_length(F.coalesce(p["text"], F.lit(""))) / TEXT_CHARS))
        .when(p["kind"] == "image", tiles(p["width"]) * tiles(p["height"]) * TILE_TOKENS + IMAGE_TOKENS)
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .otherwise(F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS)
    ).cast("long")


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """The content that parts flatten to, their attachments and their token count."""
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    attached = F.filter(parts, lambda p: ~_is_text(p))
    # An attachment's ordinal is the number of attachments up to it.
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.size(F.filter(F.slice(parts, 1, i + 1), lambda q: ~_is_text(q))).alias("ordinal")))
    content = F.array_join(F.transform(numbered, lambda x: F.when(_is_text(x["p"]), escaped(x["p"]["text"])).otherwise(F.concat(F.lit("<"), F.when(x["p"]["kind"].isin("image", "audio"), x["p"]["kind"]).otherwise("document"), F.lit(":"), x["ordinal"], F.lit(">")))), "")
    attachments = F.transform(attached, lambda p, i: F.struct((i + 1).alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    tokens = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + expanded_tokens(p))
    return content, attachments, tokens


def format_chats(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, n_tokens of each conversation; turns has conv_id, turn, role and parts."""
    # turns in order (null first), then roles, then the parts as they were given
    given = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    gathered = turns.select("conv_id", given.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def written(t: Column) -> Column:
        content, attachments, tokens = visit(t["parts"])
        return F.struct(t["turn"].alias("turn"), t["role"].alias("role"), content.alias("content"), attachments.alias("attachments"), tokens.alias("tokens"))

    chats = gathered.select("conv_id", F.transform("ts", written).alias("ts"))
    start = lambda t: F.length(escaped(t["role"], role=True)) + len(OPEN) + len(MIDDLE)
    return chats.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(F.lit(OPEN), escaped(t["role"], role=True), F.lit(MIDDLE), t["content"], F.lit(CLOSE))), "").alias("formatted"),
        F.filter(F.transform("ts", lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("turn"), start(t).alias("start"), F.length(t["content"]).alias("length")))), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def written_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, each as written, without its end mark."""
    pieces = F.split(formatted, "</turn>\n")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    return F.transform(written_turns(formatted), lambda t: F.struct(unescaped(F.substring(t, F.lit(len(OPEN) + 1), F.instr(t, ":") - len(OPEN) - 1)).alias("role"), unescaped(F.substring(t, F.instr(t, ":") + len(MIDDLE), F.length(t))).alias("text")))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    turns = written_turns(formatted)
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substring(F.get(turns, s["turn"]), s["start"] + 1, s["length"]))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "\\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text")))
    chats = format_chats(turns.withColumn("parts", text_part(F.col("text"))))
    chats = chats.select("conv_id", "formatted", "n_tokens", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + 2 + 8 + length(role) + length(text)
      + length(regexp_replace(role || text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^:]', '', 'g')))::BIGINT AS formatted_chars,
  sum(CAST(ceil(strlen(text) / 4) AS BIGINT))::BIGINT AS n_tokens
FROM t GROUP BY conv_id
"""
