"""Preference formatting: a shared prompt and a pair of masked completions from chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; the turns after it become the two completions.
In a completion only what the assistant says, with the mark that ends its turn, is to be trained on: the masks list
those spans in code points. Everything is built from SQL functions over one row a pair.

Edge cases: null role or text reads as empty, and equals itself; equal conversations have empty completions; a null
list of turns reads as no turns; turns with the same number are ordered by role and text, repeated rows stay; an empty table gives
no rows; further columns of the turns are not read. One conversation is one training example and is held as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def running_sums(numbers: Column) -> Column:
    """Sums up to each place of an array of numbers, by adding what stands 1, 2, 4, ... places before."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))
    return F.aggregate(rounds, numbers, lambda sums, r: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), r).cast("int")), F.lit(0))))


def mask(turns: Column) -> Column:
    """Spans (start, end) of the assistant's words in the rendered turns, end exclusive."""
    ends = running_sums(F.transform(turns, lambda t: F.length(rendered(t))))
    said = F.zip_with(turns, ends, lambda t, end: F.when(t["role"] == "assistant", F.struct((end - F.length(t["text"]) - len(CLOSE)).alias("start"), end.alias("end"))))
    return F.filter(said, lambda span: span.isNotNull())


def common_turns(one: Column, two: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(one, two, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask from (pair_id, chosen, rejected) lists of turns."""
    none = F.expr(f"cast(array() as array<{TURN}>)")
    clean = {s: F.transform(F.coalesce(F.col(s), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))) for s in ("chosen", "rejected")}
    rows = pairs.select("pair_id", clean["chosen"].alias("c"), clean["rejected"].alias("r")).withColumn("n_common", common_turns(F.col("c"), F.col("r")))
    rest = {s: F.slice(F.col(s), F.col("n_common") + 1, F.size(s)) for s in ("c", "r")}
    parts = rows.select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest["c"].alias("c"), rest["r"].alias("r"))
    return parts.select(
        "pair_id",
        "n_common",
        joined(F.col("p")).alias("prompt"),
        joined(F.col("c")).alias("chosen"),
        joined(F.col("r")).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"),
        mask(F.col("r")).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Pairs from conversations alone: the rejected side ends in the last answer of the conversation of the next number.

    A conversation without a successor that has an answer loses its own last answer; one without any answer is left as it is.
    """
    whole = conversations(turns)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit("assistant")) + 1
    placed = whole.withColumn("last", F.when(F.exists("turns", lambda t: t["role"] == "assistant"), last.cast("int")))
    answers = placed.where("last is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.array(F.element_at("turns", F.col("last"))).alias("answer"))
    none = F.expr(f"cast(array() as array<{TURN}>)")
    other = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.coalesce("answer", none))
    return placed.join(answers, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("last").isNull(), F.col("turns")).otherwise(other).alias("rejected"))
