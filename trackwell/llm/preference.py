"""Preference formatting, DataFrame operations only.

A pair is two conversations, chosen and rejected, each an array of turns (role, text). Their longest common turn
prefix is rendered once as the prompt; what follows is rendered as two completions, each with the spans that a
trainer should learn from: the assistant's turns (text and end mark), not the headers or the others' turns.

A turn is rendered as `<|im_start|>role\\ntext<|im_end|>\\n`; `<|` inside a role or text becomes `< |`, so no text can
end a turn. Spans are start:end in characters of the completion, end exclusive, comma-joined. Null roles and texts
count as empty. Equal conversations give empty completions (status `equal`); one without turns makes the pair's
status `empty`; completions without an assistant's turn have no spans (status `unmasked`). A conversation is one
training example and one row; repeated rows of a turn are turns of their own, and texts of any length are rendered whole.
An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn, ties by role and text. Null conv_ids go."""
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long"), _safe(F.col("role")).alias("role"), _safe(F.col("text")).alias("text")).alias("t"))
    bare = F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"], x["text"]))
    return t.groupBy("conv_id").agg(bare.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two arrays share from the start."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark in the rendered turns."""
    head, tail = len(START) + 1, len(END)

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + head + F.length(t["role"])
        end = start + F.length(t["text"]) + tail
        own = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected) to pair_id, status, prompt_turns, prompt, chosen, rejected and their spans."""
    empty = F.array().cast(pairs.schema["chosen"].dataType)
    p = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    p = p.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    p = p.withColumn("head", F.slice("c", F.lit(1), F.col("n"))).withColumn("ct", F.slice("c", F.col("n") + 1, F.size("c"))).withColumn("rt", F.slice("r", F.col("n") + 1, F.size("r")))
    spans = p.select("*", trained_spans(F.col("ct")).alias("chosen_spans"), trained_spans(F.col("rt")).alias("rejected_spans"))
    status = (
        F.when((F.size("c") == 0) | (F.size("r") == 0), "empty")
        .when((F.size("ct") == 0) & (F.size("rt") == 0), "equal")
        .when((F.col("chosen_spans") == "") & (F.col("rejected_spans") == ""), "unmasked")
        .otherwise("pair")
    )
    return spans.select(
        "pair_id", status.alias("status"), F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("head")).alias("prompt"),
        rendered(F.col("ct")).alias("chosen"), "chosen_spans", rendered(F.col("rt")).alias("rejected"), "rejected_spans",
    )


def swapped_reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation, rejected the same one up to its last assistant
    turn, which the last assistant turn of conversation conv_id XOR 1 replaces (none there: the turn is left out).
    A conversation without an assistant turn is its own rejected one."""
    c = conversations(turns)
    last = F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i))
    c = c.withColumn("at", F.array_max(last)).withColumn("reply", F.filter("turns", lambda t, i: i == F.col("at")))
    other = c.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("other_id"), F.col("reply").alias("other_reply"))
    joined = c.join(other, c["conv_id"] == other["other_id"], "left")
    swapped = F.concat(F.slice("turns", F.lit(1), F.col("at")), F.coalesce("other_reply", F.slice("turns", 1, 0)))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.coalesce(swapped, "turns").alias("rejected"))
