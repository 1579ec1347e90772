"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation is its rows by turn. Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. What follows the last assistant turn, or a whole conversation without one, makes an
example without a target, so that no turn is lost.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings in a text are broken up by a
backslash after their first character, and backslashes are doubled, which unescaping reverses exactly. In
a role a line break is written as a backslash and n.

Null texts and roles are empty ones. Rows without a conversation id are one conversation, whose id is null. Rows of one turn number are
ordered by role and text; repeated rows are repeated turns; rows without a turn number come first. An empty table gives no examples. A
conversation is held whole by one task, texts of any length included, as is each of its examples. Other columns of the caller play no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: fixed values: control strings of common chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TARGET = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes first, from left to right; what then follows a lone one is n for a line break, or itself."""
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation as written, with the lengths of their parts in code points."""
    clean = rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    ordered = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    write = lambda t: F.struct(
        (t["role"] == TARGET).alias("target"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")
    )
    sized = lambda w: F.struct(
        w["target"].alias("target"), F.concat(w["head"], w["body"], F.lit(END + "\n")).alias("written"), F.length(w["head"]).alias("before"), F.length(w["body"]).alias("body"), (F.length(w["head"]) + F.length(w["body"]) + len(END) + 1).alias("size")
    )
    return ordered.select("conv_id", F.transform(F.transform("t", write), sized).alias("turns"))


def examples(rows: DataFrame, **columns: str) -> DataFrame:
    """One row an example: conv_id, example (from 0), n_turns, trainable, formatted, loss_start and loss_end (code points; equal without a target)."""
    convs = conversations(rows, **columns)
    # where examples end: behind each target, and behind the last turn
    ends = F.filter(F.transform("turns", lambda t, i: F.when(t["target"] | (i == F.size("turns") - 1), i + 1)), lambda x: x.isNotNull())
    each = convs.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto")).withColumn("used", F.slice("turns", 1, F.col("upto")))
    last = F.element_at("used", -1)
    context = F.aggregate(F.slice("turns", 1, F.col("upto") - 1), F.lit(0), lambda a, t: a + t["size"])
    start = context + F.when(last["target"], last["before"]).otherwise(0)
    return each.select(
        "conv_id", "example", F.col("upto").alias("n_turns"), last["target"].alias("trainable"), F.array_join(F.transform("used", lambda t: t["written"]), "").alias("formatted"),
        start.alias("loss_start"), (start + F.when(last["target"], last["body"]).otherwise(0)).alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example. The start marker occurs nowhere else, so it can be split at."""
    split = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(split, 2, F.size(split))
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(p.substr(F.position(F.lit("\n"), p) + 1, F.length(p) - F.position(F.lit("\n"), p) - len(END) - 1)).alias("text")))


def report(rows: DataFrame, **columns: str) -> DataFrame:
    """One row a conversation, read back from its examples: the turns of the longest one, and all text under the loss masks."""
    made = examples(rows, **columns)
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = made.select("conv_id", "example", F.col("formatted"), F.length("formatted").alias("chars"), F.when(F.col("trainable"), loss).otherwise("").alias("loss"))
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples")
    ).withColumn("turns", parse(F.col("whole")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
