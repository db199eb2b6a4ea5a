"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is under the
loss mask. A conversation that does not end with an assistant turn gets one more example without a loss, so that
nothing of it is lost.

A rendered turn is ``<s>[INST] role [/INST]text</s>``. Inside roles and texts a backslash is put after the first
character of each control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, also with backslashes already in it),
which `unescape` takes out again: no text can forge a mark, and every text comes back as it was.

Defined results: null roles and texts count as empty. Turns go by turn number (null first), then role, then rendered
text, so that ties and repeated rows always come in the same order. Rows of a null conversation id form one
conversation. An empty table gives no rows. Other columns are ignored.
One conversation is one row, as its last example holds all of its turns by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN, ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"
ASSISTANT = "assistant"
#: What follows the first character of a control string.
_TAIL = r"(s>|/s>|INST\]|/INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv_id, example (the number of its last turn, from 1), last (no later example), formatted, loss_start
    (code points before the reply), loss_chars, trainable."""
    who = escape(F.coalesce(F.col(role).cast("string"), F.lit("")))
    head = F.concat(F.lit(TURN_OPEN + ROLE_OPEN), who, F.lit(ROLE_CLOSE))
    one = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.concat(head, escape(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(TURN_CLOSE)).alias("piece"),
        ).alias("t"),
    )
    turns = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("n", F.size("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == F.col("n")) | (F.element_at("turns", i)["role"] == ASSISTANT))
    each = turns.withColumn("example", F.explode(ends)).withColumn("target", F.element_at("turns", F.col("example")))
    context = F.concat_ws("", F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: t["piece"]))
    before = F.length(F.lit(TURN_OPEN + ROLE_OPEN + ROLE_CLOSE)) + F.length(escape(F.col("target.role")))
    trainable = F.col("target.role") == ASSISTANT
    return each.withColumn("context", context).select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n")).alias("last"),
        F.concat("context", F.col("target.piece")).alias("formatted"),
        F.when(trainable, F.length("context") + before).alias("loss_start"),
        F.when(trainable, F.length("target.piece") - before - len(TURN_CLOSE)).otherwise(0).alias("loss_chars"),
        trainable.alias("trainable"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.split(formatted, TURN_CLOSE)
    start = len(TURN_OPEN + ROLE_OPEN)

    def parsed(piece: Column) -> Column:
        rest = F.substring(piece, start + 1, 2**31 - 1)
        role = F.substring_index(rest, ROLE_CLOSE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(rest, F.length(role) + len(ROLE_CLOSE) + 1)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parsed)


def read_loss(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The text under the loss mask, as it was before it was escaped; empty without one."""
    return F.coalesce(unescape(F.substr(formatted, (loss_start + 1).cast("int"), loss_chars.cast("int"))), F.lit(""))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples alone: turns and their hash, the text under the loss and its hash, and the size."""
    per = examples.select(
        "conv_id",
        F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("formatted")).alias("whole"),
    )
    whole = per.groupBy("conv_id").agg(F.array_sort(F.collect_list("loss")).alias("losses"), F.sum("chars").alias("formatted_chars"), F.first("whole", ignorenulls=True).alias("whole"))
    loss = F.concat_ws("", F.transform("losses", lambda x: x["loss"]))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return whole.withColumn("turns", read_turns(F.col("whole"))).withColumn("all_loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("all_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("all_loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
