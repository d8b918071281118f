"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. A block is OPEN role HEAD, the texts of its turns with JOINT between them, then END.
BEGIN, OPEN, HEAD, JOINT, END = "<s>", "<|", "|>\n", "<|and|>", "<|end|>\n"
#: Control strings inside texts and how they are written; "&" comes first and is read back last.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("|>", "|&gt;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))
#: Turns of this many turn numbers are collected together first, so that a long conversation is dealt out.
CHUNK = 64


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted string, and segments array<struct<text, loss>> whose texts
    joined are the formatted string; loss marks assistant texts, without their marks.

    Turns are sorted by (turn, role, text); null turns come first, null roles and texts are empty.
    Equal rows stay as turns of their own. Adjacent turns of one role share a block. A null conv_id
    is a conversation of its own; an empty table gives no rows; other columns are ignored. Turns are
    collected by (conv_id, range of turn numbers) and then by conv_id, so a very long conversation
    is escaped and sorted in parts.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        (F.col("role") == "assistant").alias("loss"),
    )
    parts = (
        conversations.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), turn.alias("t"))
        .groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    whole = parts.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "turns"))), lambda c: c["turns"])).alias("turns"))
    # ties of a turn are ordered by their plain role and text, so that escapes come after the sort
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["loss"].alias("loss"))))

    def pieces(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        mark = (
            F.when(i == 0, F.concat(F.lit(BEGIN + OPEN), t["role"], F.lit(HEAD)))
            .when(before == t["role"], F.lit(JOINT))
            .otherwise(F.concat(F.lit(OPEN), t["role"], F.lit(HEAD)))
        )
        close = F.when(after == t["role"], F.lit("")).otherwise(F.lit(END))
        no = F.lit(False)
        return F.array(
            F.struct(mark.alias("text"), no.alias("loss")),
            F.struct(t["text"].alias("text"), F.coalesce(t["loss"], no).alias("loss")),
            F.struct(close.alias("text"), no.alias("loss")),
        )

    segments = F.filter(F.flatten(F.transform("turns", pieces)), lambda s: (s["text"] != "") | s["loss"])
    out = whole.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def turns_of(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted string; null roles and texts come back empty."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    blocks = F.filter(F.split(body, r"\Q" + END + r"\E"), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, HEAD)
        role = unescape(F.substr(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        texts = F.split(F.substr(block, at + len(HEAD)), r"\Q" + JOINT + r"\E")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """What the loss mask covers, without escapes."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests of what turns_of and loss_text give back from the output of format_chats."""
    made = format_chats(conversations)
    read = made.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    for plain, coded in ESCAPES:
        column = f"replace({column}, '{plain}', '{coded}')"
    return column


#: op8 in SQL: turns with their neighbours, and the lengths of the marks between them.
ORACLE_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over w as k, lag(role) over w as before, lead(role) over w as after from c window w as (partition by conv_id order by turn nulls first, role, text)),
m as (
  select *, length({_escaped_sql('text')}) + case when after is not distinct from role then 0 else {len(END)} end
    + case when before is not distinct from role then {len(JOINT)} else {len(OPEN) + len(HEAD)} + length({_escaped_sql('role')}) end as chars
  from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  ({len(BEGIN)} + sum(chars))::bigint as formatted_chars
from m group by conv_id
"""
