"""Chat formatting: every assistant turn becomes an example whose context is all turns before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def prefix_targets(turns: DataFrame, target: str = TARGET) -> DataFrame:
    """(conv_id, turn, n_context, prompt, reply, loss_start, loss_end): one row for each turn of the target role.

    ``prompt`` is all preceding turns as "<|role|>\\ntext\\n" and the head of the reply; only the characters from
    ``loss_start`` up to ``loss_end`` of prompt + reply are trainable, which are the reply's. Turns are ordered by (turn,
    role, text); rows equal in conversation, turn, role and text count once; a null text is as an empty one. Rows with a
    null conversation, turn or role are left out. Extra columns are left out; an empty table gives an empty result.
    """
    t = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    t = t.where("conv_id is not null and turn is not null and role is not null")
    # one shuffle; sets of structs are ordered by their fields
    all_turns = t.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    each = all_turns.select("conv_id", "turns", F.posexplode("turns").alias("n_context", "own")).where(F.col("own.role") == target)
    before = F.transform(F.slice("turns", F.lit(1), F.col("n_context")), lambda x: F.concat(_head(x["role"]), x["text"], F.lit("\n")))
    out = each.select("conv_id", F.col("own.turn").alias("turn"), "n_context", F.concat(F.array_join(before, ""), _head(F.lit(target))).alias("prompt"), F.col("own.text").alias("reply"))
    start = F.length("prompt")
    return out.withColumn("loss_start", start).withColumn("loss_end", start + F.length("reply"))
