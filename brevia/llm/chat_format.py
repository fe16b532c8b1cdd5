"""Operator: chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are its context, and only
its own text is trainable. Written out in full, the contexts of a conversation grow with
the square of its turns, so expand() gives each example the part of its context that is
new since the example before (`delta`); with_context() writes contexts out in full.

Format of a turn: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a
backslash is doubled and `<|` becomes `<\\|`, so no control string is left in a text
and unescape() gives the text back; a newline in a role becomes `<\\n`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation that are sorted together; conversations of any length are made of such blocks.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """(conv_id, block, example, turn, delta, head, reply, tail): one row per assistant turn, in (block, example) order.

    delta: formatted turns since the previous example; head + reply + tail: the assistant's
    turn, of which `reply` (escaped text) is what the loss covers. Turns that no reply of
    their block follows come as a row with null reply, as context of later examples.

    Rows of one conversation are ordered by turn (nulls first), then role, then text; repeated
    rows stay as repeated turns. Null roles and texts count as empty; null conversation ids
    form one conversation. A conversation without an assistant turn has only a null-reply row;
    an empty table gives no rows. Other columns are not read.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / BLOCK), F.lit(-(2**62))).alias("block"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("ts", (i + 1).cast("int"))["role"] == assistant)
    cut = blocks.select("conv_id", "block", "ts", n.alias("n"), ends.alias("ends"))
    cut = cut.withColumn("ends", F.when((F.size("ends") == 0) | (F.element_at("ends", -1) < F.col("n") - 1), F.concat("ends", F.array("n"))).otherwise(F.col("ends")))
    pieces = cut.select("conv_id", "block", "ts", "n", F.posexplode("ends").alias("example", "end"), F.col("ends"))
    begin = F.when(F.col("example") == 0, F.lit(0)).otherwise(F.element_at("ends", F.col("example")) + 1)  # the end before this one
    pieces = pieces.select("conv_id", "block", "example", F.slice("ts", begin + 1, F.col("end") - begin).alias("before"), F.when(F.col("end") < F.col("n"), F.get("ts", F.col("end"))).alias("last"))
    return pieces.select(
        "conv_id",
        "block",
        "example",
        F.col("last.turn").alias("turn"),
        F.array_join(F.transform("before", formatted), "").alias("delta"),
        F.when(F.col("last").isNotNull(), F.concat(F.lit(START), escape_role(F.col("last.role")), F.lit("\n"))).alias("head"),
        escape(F.col("last.text")).alias("reply"),
        F.when(F.col("last").isNotNull(), F.lit(END + "\n")).alias("tail"),
    )


def formatted(turn: Column) -> Column:
    return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit(END + "\n"))


def whole(examples: DataFrame) -> DataFrame:
    """(conv_id, formatted, replies, n_examples): examples of expand() joined again, one row per conversation.

    Blocks are joined first, so a long conversation is a few rows when it meets. replies
    are the escaped texts under the loss mask, in order.
    """
    part = F.struct("example", F.concat("delta", F.coalesce("head", F.lit("")), F.coalesce("reply", F.lit("")), F.coalesce("tail", F.lit(""))).alias("s"), "reply")
    blocks = examples.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(part)).alias("p"))
    blocks = blocks.select("conv_id", F.struct("block", F.array_join("p.s", "").alias("s"), F.filter("p.reply", lambda r: r.isNotNull()).alias("replies")).alias("b"))
    joined = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return joined.select("conv_id", F.array_join("b.s", "").alias("formatted"), F.flatten("b.replies").alias("replies")).withColumn("n_examples", F.size("replies"))


def with_context(examples: DataFrame) -> DataFrame:
    """(conv_id, block, example, turn, context, target, loss_start, loss_length): examples with their contexts in full.

    The output grows with the square of a conversation's replies. loss_start counts code
    points of context + target from 0.
    """
    from pyspark.sql import Window

    sofar = Window.partitionBy("conv_id").orderBy("block", "example").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.concat("delta", F.coalesce("head", F.lit("")), F.coalesce("reply", F.lit("")), F.coalesce("tail", F.lit("")))
    rows = examples.withColumn("before", F.array_join(F.collect_list(turn).over(sofar), "")).where("reply is not null")
    context = F.concat("before", "delta", "head")
    return rows.select("conv_id", "block", "example", "turn", context.alias("context"), F.concat("reply", "tail").alias("target"), F.char_length(context).alias("loss_start"), F.char_length("reply").alias("loss_length"))


def from_contexts(examples: DataFrame) -> DataFrame:
    """The columns of whole(), from the examples of with_context(): replies are cut out of context + target by their loss spans.

    Every context must begin with the example before it, or the query fails; so each example
    gives what it adds to the transcript, and turns after the last example come from expand().
    """
    from pyspark.sql import Window

    rows = with_context(examples).withColumn("s", F.concat("context", "target"))
    last = F.coalesce(F.lag("s").over(Window.partitionBy("conv_id").orderBy("block", "example")), F.lit(""))
    rows = rows.withColumn("last", last).select(
        "conv_id",
        "block",
        "example",
        F.when(F.startswith("context", "last"), F.col("s").substr(F.char_length("last") + 1, F.char_length("s"))).otherwise(F.raise_error(F.lit("a context does not begin with the example before it")).cast("string")).alias("s"),
        F.col("s").substr(F.col("loss_start") + 1, F.col("loss_length")).alias("reply"),
    )
    rows = rows.unionByName(examples.where("reply is null").select("conv_id", "block", "example", F.col("delta").alias("s"), F.lit(None).cast("string").alias("reply")))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "example", "s", "reply"))).alias("p"))
    # context of a later example already holds a row without a reply
    end = F.array_max(F.transform(F.filter("p", lambda x: x["reply"].isNotNull()), lambda x: F.struct(x["block"], x["example"])))
    joined = joined.withColumn("end", end)
    kept = F.filter("p", lambda x: x["reply"].isNotNull() | F.col("end").isNull() | (F.struct(x["block"], x["example"]) > F.col("end")))
    replies = F.filter(F.transform("p", lambda x: x["reply"]), lambda r: r.isNotNull())
    return joined.select("conv_id", F.array_join(F.transform(kept, lambda x: x["s"]), "").alias("formatted"), replies.alias("replies")).withColumn("n_examples", F.size("replies"))


def read_back(wholes: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, replies, formatted_chars) parsed from whole()'s strings."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.greatest(F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1, F.lit(0)))
    body = F.transform(parts, lambda p: F.substring(p, len(START) + 1, 2**30))

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        return F.struct(unescape_role(p.substr(F.lit(1), at - 1)).alias("role"), unescape(p.substr(at + 1, F.lit(2**30))).alias("text"))

    return wholes.select("conv_id", F.transform(body, turn).alias("turns"), F.transform("replies", unescape).alias("replies"), "n_examples", F.char_length("formatted").cast("long").alias("formatted_chars"))
