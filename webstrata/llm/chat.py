"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its own text is trainable. A turn is written as the block

    <|turn|>role<|text|>text<|end|>\\n

Inside roles and texts a backslash is written twice and `<|` as `<\\|`, so no text
can contain a control string, and a backslash always protects the next character.

The examples of a conversation share its prefixes. Until they are exploded an example
carries its own target block and the number of characters of the conversation that are its
context, so what is shuffled grows with the turns and not with their square. `full_text`
explodes them into whole strings; it and `digest`, which reads each of them back, write a
string for each example within one task, without a shuffle or sort of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TRAINABLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def blocks(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq, role_end, block, prefix_chars, trainable, loss_start, loss_end.

    `turns` has conv_id, turn, role, text; further columns are ignored, whatever their
    names. Turns are ordered by turn, then role, then text (nulls first), so ties and
    repeated rows have one defined order and repeated rows all stay. Null roles and
    texts are empty; rows with a null conv_id form one conversation. Offsets count code
    points: prefix_chars from the start of the conversation, loss_start and loss_end
    from the start of the example, which is the start of the conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head = F.concat(F.lit(TURN), escaped(role), F.lit(TEXT))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
        F.length(head).alias("head_chars"), F.concat(head, escaped(text), F.lit(END)).alias("block"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("seq", F.row_number().over(before)).withColumn("end", F.sum(F.length("block").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    prefix = F.col("end") - F.length("block")
    return rows.select(
        "conv_id", "seq", "block", prefix.alias("prefix_chars"), (F.col("role") == TRAINABLE).alias("trainable"),
        (prefix + F.col("head_chars")).alias("loss_start"), (F.col("end") - len(END)).alias("loss_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 1), context_turns, context_chars,
    target, loss_start, loss_end. The text of an example is the first context_chars
    characters of its conversation and then its target; the loss mask covers only
    [loss_start, loss_end), the escaped reply. Conversations without an assistant have
    none. See `blocks` for nulls, ties and repeated rows."""
    nth = Window.partitionBy("conv_id").orderBy("seq")
    return blocks(turns).where("trainable").select(
        "conv_id", F.row_number().over(nth).cast("long").alias("example"), (F.col("seq") - 1).cast("long").alias("context_turns"),
        F.col("prefix_chars").alias("context_chars"), F.col("block").alias("target"), "loss_start", "loss_end",
    )


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its formatted text, and its examples in order
    (array of context_chars, target, loss_start, loss_end)."""
    one = F.struct("seq", "block", "trainable", "prefix_chars", "loss_start", "loss_end")
    return blocks(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("b")).select(
        "conv_id", F.concat_ws("", F.col("b.block")).alias("formatted"),
        F.transform(
            F.filter("b", lambda x: x["trainable"]),
            lambda x: F.struct(x["prefix_chars"].alias("context_chars"), x["block"].alias("target"), x["loss_start"].alias("loss_start"), x["loss_end"].alias("loss_end")),
        ).alias("examples"),
    )


def _expanded(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, formatted, n (from 0), x (the example) and its whole text. Conversations
    without an assistant have one row, with null n, x and text."""
    rows = conversations(turns).select("conv_id", "formatted", F.posexplode_outer("examples").alias("n", "x"))
    return rows.withColumn("text", F.concat(F.col("formatted").substr(F.lit(1), F.col("x.context_chars").cast("int")), F.col("x.target")))


def full_text(turns: DataFrame) -> DataFrame:
    """`examples` with the whole text of each: conv_id, example, text, loss_start, loss_end.

    The output grows with the square of a conversation's length, as the format asks. See `blocks`
    for nulls, ties and repeated rows; empty texts are turns like others, an empty table gives no rows."""
    return _expanded(turns).where("n is not null").select("conv_id", (F.col("n") + 1).cast("long").alias("example"), "text", "x.loss_start", "x.loss_end")


def read_back(turns: DataFrame) -> DataFrame:
    """Format, expand and parse again: conv_id, formatted_chars, turns (array of role, text, both unescaped,
    from the formatted conversation) and replies (what is under the loss mask of each exploded
    example, unescaped, in order). An example that isn't a prefix of its conversation is an error.

    Null and empty texts come back empty; see `blocks` for ties and repeated rows. A conversation
    and each of its examples must fit in a string (2 GB)."""
    masked = F.substr("text", (F.col("x.loss_start") + 1).cast("int"), (F.col("x.loss_end") - F.col("x.loss_start")).cast("int"))
    reply = F.when(F.startswith("formatted", "text"), unescaped(masked)).otherwise(F.raise_error(F.lit("an example isn't a prefix of its conversation")).cast("string"))
    # only the first row of a conversation carries it on
    rows = _expanded(turns).select("conv_id", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("formatted")).alias("formatted"), F.when(F.col("n").isNotNull(), F.struct("n", reply.alias("reply"))).alias("r"))
    found = rows.groupBy("conv_id").agg(F.max("formatted").alias("formatted"), F.array_sort(F.collect_list("r")).alias("r"))
    written = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    said = F.transform(
        written,
        lambda x: F.struct(
            unescaped(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescaped(F.substring_index(x, TEXT, -1)).alias("text"),
        ),
    )
    return found.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), said.alias("turns"), F.col("r.reply").alias("replies"))


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the expanded output: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (the conversation written once), n_examples. See `read_back`."""
    lines = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", "replies")
    return read_back(turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
        F.size("replies").cast("long").alias("n_examples"),
    )
