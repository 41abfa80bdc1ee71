"""Preference formatting: chosen and rejected conversations with their common turns rendered once as prompt.

Both sides are joined turn by turn and compared natively; a pair's turns meet in one row, which holds two
conversations. Completions carry character masks: the spans of assistant contents and end marks, which are to be learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|{role}|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, role, text) in order). Null texts are empty, null roles ``user``; rows without conv_id are left out.

    Repeated rows count once; different rows of one turn number follow each other by role and text.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns agree in role and text."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get(a, i - 1)["role"] != F.get(b, i - 1)["role"]) | (F.get(a, i - 1)["text"] != F.get(b, i - 1)["text"]))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.array_min(differs) - 1, n)).cast("int")


def rendered(turns: Column) -> Column:
    """Turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START.split("{")[0]), t["role"], F.lit(START.split("}")[1]), t["text"], F.lit(STOP))), "")


def learned_spans(turns: Column) -> Column:
    """Character spans (first, last exclusive) of the learned role's contents with their end marks, in the rendered turns."""
    head, tail = len(START) - len("{role}"), len(STOP)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        first = s["at"] + head + F.length(t["role"])
        last = first + F.length(t["text"]) + tail
        more = F.when(t["role"] == LEARNED, F.concat(s["spans"], F.array(F.struct(first.alias("first"), last.alias("last"))))).otherwise(s["spans"])
        return F.struct(last.alias("at"), more.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (any key columns, chosen and rejected: arrays of turns) formatted.

    Adds n_common, prompt, chosen_text, rejected_text and their masks (spans to be learned). The last turn of the shorter side never goes to the
    prompt when both sides are equal so far, so that each side has a completion; an empty or null side gives an empty completion
    and an empty mask. Identical sides are kept and told by ``same``. Other columns stay, but for those with the name of an added one.
    """
    added = ("n_common", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask", "same")
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected", *added)]
    pairs = pairs.select(F.struct(*(F.col(f"`{c}`") for c in kept) if kept else [F.lit(0)]).alias("all"), "chosen", "rejected")
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    chosen, rejected = (F.coalesce(F.col(c), empty) for c in ("chosen", "rejected"))
    out = pairs.withColumns({"chosen": chosen, "rejected": rejected}).withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    out = out.withColumn("n_common", F.when(F.col("n_common") == shorter, F.greatest(shorter - 1, F.lit(0))).otherwise(F.col("n_common")))
    tails = {c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1))) for c in ("chosen", "rejected")}
    out = out.withColumns({"_prompt": F.slice("chosen", F.lit(1), F.col("n_common")), "_chosen": tails["chosen"], "_rejected": tails["rejected"]})
    same = F.transform("_chosen", lambda t: F.struct(t["role"], t["text"])) == F.transform("_rejected", lambda t: F.struct(t["role"], t["text"]))
    return out.select(*(F.col(f"all.`{c}`") for c in kept), "n_common", rendered(F.col("_prompt")).alias("prompt"), rendered(F.col("_chosen")).alias("chosen_text"), rendered(F.col("_rejected")).alias("rejected_text"),
                      learned_spans(F.col("_chosen")).alias("chosen_mask"), learned_spans(F.col("_rejected")).alias("rejected_mask"), same.alias("same"))
