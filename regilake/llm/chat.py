"""Operator 3: chat formatting with typed content parts.

A message holds an array of parts ``struct<type, text, ref, tokens>``. A
visitor over the parts (higher-order functions, no Python) turns text into
escaped text and any image, audio or document part into a placeholder
``<type turn.part>`` that tells its place in the conversation; the
attachments' references and the tokens they expand to are recorded in the
same order. Turns are marked ``[INST]role\\n ... [/INST]``, and
``<s>role\\n ... </s>`` where the role is trained on; the loss mask lists
the code-point spans of those turns' bodies.

Control strings all begin with ``<`` or ``[``, and escaping leaves neither
in a text: ``\\`` becomes ``\\e``, ``<`` ``\\l`` and ``[`` ``\\b``, which
:func:`unescape` reverts. So texts cannot forge marks, and the output can be
read back by :func:`turns_of` and :func:`loss_text`.

Edge cases: null text and null part lists are empty turns, a null role is
the role ``""``, an unknown part type is an attachment of that type; rows of
equal turn are ordered by role and text, null turns first; rows with a null
``conv_id`` form one conversation of that id; an empty table gives no rows;
other columns are ignored. The rows of a conversation meet in one task, as
its formatted string is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import needed, table

TRAINED = ("assistant",)
#: Characters of text that count as one token where a part states no number.
CHARS_PER_TOKEN = 4
PARTS = "array<struct<type:string,text:string,ref:string,tokens:long>>"


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            null.cast("string").alias("ref"), null.cast("long").alias("tokens")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _tokens(part: Column) -> Column:
    counted = F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / CHARS_PER_TOKEN)
    return F.coalesce(part["tokens"], F.when(_is_text(part), counted).otherwise(F.lit(1)))


def _place(part: Column, turn: Column, k: Column) -> Column:
    return F.concat(F.lit("<"), escape(part["type"]), F.lit(" "), turn.cast("string"), F.lit("."), k.cast("string"), F.lit(">"))


def _body(parts: Column, turn: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p, k: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit(""))))
                                    .otherwise(_place(p, turn, k))), "")


def format_conversations(messages: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, parts).

    ``formatted``; ``loss_spans`` (array of start, length in code points);
    ``attachments`` (array of place, type, ref, tokens); ``n_turns``;
    ``expanded_tokens`` (all parts together).
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    key = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", key.alias("key"), "parts")),
                                                     lambda a, b: F.when(a["turn"].eqNullSafe(b["turn"]),
                                                                         F.when(a["role"] != b["role"], F.when(a["role"] < b["role"], -1).otherwise(1))
                                                                         .otherwise(F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
                                                     .when(a["turn"].isNull() | (a["turn"] < b["turn"]), -1).otherwise(1)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        loss = t["role"].isin(*trained)
        head = F.concat(F.when(loss, F.lit("<s>")).otherwise(F.lit("[INST]")), escape(t["role"]), F.lit("\n"))
        return F.struct(head.alias("head"), _body(t["parts"], i).alias("body"),
                        F.when(loss, F.lit("</s>")).otherwise(F.lit("[/INST]")).alias("tail"), loss.alias("loss"))

    pieces = talks.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"]))
    # where each turn begins: a running sum of the sizes
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    laid = pieces.withColumn("begins", ends)
    spans = F.filter(F.transform("pieces", lambda p, i: F.when(p["loss"], F.struct(
        (F.get("begins", i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))), lambda s: s.isNotNull())
    attached = F.flatten(F.transform("turns", lambda t, i: F.filter(F.transform(t["parts"], lambda p, k: F.when(~_is_text(p), F.struct(
        _place(p, i, k).alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))), lambda a: a.isNotNull())))
    tokens = F.aggregate(F.flatten(F.transform("turns", lambda t: F.transform(t["parts"], _tokens))), F.lit(0).cast("long"), lambda a, n: a + n)
    return laid.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        spans.alias("loss_spans"), attached.alias("attachments"), F.size("turns").cast("long").alias("n_turns"), tokens.alias("expanded_tokens"))


TURN = r"(?:\[INST\]|<s>)([^\n]*+)\n([^<\[]*+(?:<(?!/?s>)[^<\[]*+)*+)(?:\[/INST\]|</s>)"


def turns_of(formatted: Column) -> Column:
    """Array of struct(role, body) read from a formatted conversation; placeholders stay in the body."""
    roles, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(g)) for g in (1, 2))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(unescape(r).alias("role"), unescape(b).alias("body")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; digests of what is read back from the output."""
    given = needed(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    talks = format_conversations(given.unionByName(more).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    turns = turns_of(F.col("formatted"))
    read = talks.select("conv_id", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, role = 'assistant' AS loss,
           length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
           + CASE WHEN role = 'assistant' THEN 8 ELSE 14 END AS size FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE loss), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
