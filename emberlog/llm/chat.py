"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted (turn, then role and text for ties). Adjacent turns of one
role merge into a block; blocks are concatenated:

    <s>[ROLE] text [/ROLE]</s>              one block a line
    <s>[ROLE] text[+]next text [/ROLE]</s>  a block of two turns

Escapes make it reversible: inside texts and roles a backslash becomes two, and `[`, `]`, `<`, `>` get a backslash in
front, so no text can hold a control string, and merged turns can be told apart again. The loss mask is a list of
[start, end) character spans of the formatted string, one for each assistant text (escaped, without marks). parse()
reads roles, texts and masked texts back.

Null roles and texts count as empty, null turns sort first. Null conv_ids form one conversation. A repeated row is a
turn of its own. Very long texts and conversations go whole: where a text lies is a running sum over the turns of its
conversation, in time linear in them. Extra columns are ignored, whatever their names. An empty table gives no rows. A
conversation is one output row, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT, NEXT = "assistant", "[+]"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]<>])", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\\[\]<>])", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of spans), n_blocks."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a key that is never null: all that follows is dealt by it once
    own_key = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))
    rows = turns.select(own_key.alias("key"), turn.alias("t"))
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # blocks begin where the role differs from that of the turn before
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    begun = grouped.withColumn("begins", begins)
    block = lambda b, k: F.slice("turns", b, F.coalesce(F.get("begins", k + 1), F.size("turns") + 1) - b)
    blocks = begun.select("key", F.transform("begins", block).alias("blocks"))

    def piece(block: Column) -> Column:
        role = escaped(block[0]["role"])
        last = F.size(block) - 1
        return F.transform(
            block,
            lambda t, i: F.struct(
                (t["role"] == ASSISTANT).alias("own"),
                F.when(i == 0, F.concat(F.lit("<s>["), role, F.lit("] "))).otherwise(F.lit(NEXT)).alias("head"),
                escaped(t["text"]).alias("body"),
                F.when(i == last, F.concat(F.lit(" [/"), role, F.lit("]</s>"))).otherwise(F.lit("")).alias("tail"),
            ),
        )

    pieces = blocks.select("key", F.size("blocks").alias("n_blocks"), F.transform("blocks", piece).alias("pieces"))
    line = lambda b: F.array_join(F.transform(b, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    lengths = F.flatten(F.transform("pieces", lambda b: F.transform(b, lambda p: F.struct(p["own"].alias("own"), F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), (F.length(p["tail"]) + (p["tail"] != "").cast("int")).alias("tail")))))
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = pieces.select("key", F.posexplode(lengths).alias("i", "p")).select("key", "i", "p.*")
    each = each.withColumn("start", (F.coalesce(F.sum(F.col("head") + F.col("body") + F.col("tail")).over(before), F.lit(0)) + F.col("head")).cast("int"))
    spans = each.where("own").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("body")).alias("end")))).alias("mask"))
    lines = pieces.select("key", F.array_join(F.transform("pieces", line), "\n").alias("formatted"), "n_blocks")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    conv_id = F.when(F.col("key") != "", F.col("key")).cast("long").alias("conv_id")
    return lines.join(spans, "key", "left").select(conv_id, "formatted", F.coalesce("mask", empty).alias("mask"), "n_blocks")


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (texts under the mask) read back from format_chats' output."""
    # brackets of texts have a backslash in front, so unescaped ones are marks
    role = r"(?s)^<s>\[((?:[^\\\]]|\\.)*)\] "
    lines = F.split("formatted", r"(?<=\]</s>)\n(?=<s>\[)")
    said = lambda x: F.regexp_replace(F.regexp_replace(x, role, ""), r"(?s) \[/(?:[^\\\]]|\\.)*+\]</s>$", "")
    turns = lambda x: F.transform(F.split(said(x), r"\[\+\]", -1), lambda t: F.struct(unescaped(F.regexp_extract(x, role, 1)).alias("role"), unescaped(t).alias("text")))
    loss = F.transform("mask", lambda m: unescaped(F.col("formatted").substr(m["start"] + 1, m["end"] - m["start"])))
    return formatted.select("conv_id", F.flatten(F.transform(lines, turns)).alias("turns"), loss.alias("loss"), "formatted")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted strings."""
    back = parse(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.withColumn("said", F.array_join("loss", ""))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
