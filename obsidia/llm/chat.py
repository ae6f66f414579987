"""Preference formatting: the turns that a chosen and a rejected conversation begin with alike are the prompt, the rest completions.

DataFrame functions alone. Turns are matched by equality of pair and turn number, so no conversation is gathered to find the prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia.llm import common

TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n")


def rendered(role: Column, text: Column) -> Column:
    """A turn as text: a role mark, the text and an end mark."""
    before, after = TEMPLATE
    return F.concat(F.lit(before.split("{role}")[0]), role, F.lit(before.split("{role}")[1]), text, F.lit(after))


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, at (0, 1, ... within a conversation, in order of turn, role and text), role and text; null roles and texts are empty.

    Turns without a conversation id are left out. Null turn numbers come first; repeated turns stay, each with a place of its own.
    """
    clean = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return clean.select("conv", (F.row_number().over(order) - 1).alias("at"), "role", "text")


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a pair: pair_id, prompt_turns, prompt, chosen, rejected and the characters of each completion that a loss counts.

    chosen, rejected: pair_id, at (0, 1, ...), role, text; a pair needs turns on both sides. The prompt is the longest common prefix
    of turns with equal role and text, rendered once. A completion is what follows it, rendered, and may be empty. chosen_spans and
    rejected_spans are the starts and ends, in characters of the completion, of its assistant turns' texts; all else is masked.
    """
    c, r = (x.select("pair_id", "at", F.col("role").alias(f"{k}_role"), F.col("text").alias(f"{k}_text")) for x, k in ((chosen, "c"), (rejected, "r")))
    both = c.join(r, ["pair_id", "at"], "full")
    same = F.col("c_role").isNotNull() & F.col("r_role").isNotNull() & (F.col("c_role") == F.col("r_role")) & (F.col("c_text") == F.col("r_text"))
    seen = F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("at"))).over(Window.partitionBy("pair_id"))
    placed = both.select("*", F.coalesce(seen, F.lit(2**31 - 1)).alias("split"))

    def side(k: str, prompt: bool) -> Column:
        there = F.col(f"{k}_role").isNotNull() & ((F.col("at") < F.col("split")) if prompt else (F.col("at") >= F.col("split")))
        turn = F.struct("at", F.col(f"{k}_role").alias("role"), F.col(f"{k}_text").alias("text"))
        return F.sort_array(F.collect_list(F.when(there, turn)))  # the turns of one conversation

    grouped = placed.groupBy("pair_id").agg(side("c", True).alias("p"), side("c", False).alias("c"), side("r", False).alias("r"), F.count("c_role").alias("n_c"), F.count("r_role").alias("n_r"))

    def joined(turns: str) -> Column:
        return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")

    head, tail = (len(x) for x in ("".join(TEMPLATE[0].split("{role}")), TEMPLATE[1]))

    def spans(turns: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def add(acc: Column, t: Column) -> Column:
            begin = acc["at"] + head + F.length(t["role"])
            end = begin + F.length(t["text"])
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            more = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
            return F.struct((end + tail).alias("at"), more.alias("spans"))

        return F.aggregate(turns, start, add, lambda acc: acc["spans"])

    whole = grouped.where("n_c > 0 AND n_r > 0")
    return whole.select("pair_id", F.size("p").cast("long").alias("prompt_turns"), joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"), spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans"))


def swapped(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs out of plain conversations: a conversation is chosen over itself with the last assistant turn of the next one in its last one's place.

    The next one is that with the next larger id that has an assistant turn, for the largest id the smallest. A conversation without
    an assistant turn makes no pair, nor does one that is alone. Turns after the last assistant turn are in neither side.
    """
    at = numbered(turns, id_col, turn_col, role_col, text_col)
    last = at.where("role = 'assistant'").groupBy("conv").agg(F.max_by("text", "at").alias("last_text"), F.max("at").alias("last_at"))
    # Ranges of ids, kept in a table so that all that follows sees the same ranges; the next id of a range's last one is the first of the range behind it.
    ranged = common.written(last.repartitionByRange(common.partitions(turns.sparkSession), "conv").withColumn("part", F.spark_partition_id()), "conversations")
    firsts = ranged.groupBy("part").agg(F.min("conv").alias("first"))  # a row a range
    behind = firsts.select(F.col("part").alias("of"), F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())).alias("behind"))
    within = ranged.withColumn("next", F.lead("conv").over(Window.partitionBy("part").orderBy("conv")))
    following = within.join(behind, F.col("part") == F.col("of")).select("conv", "last_at", F.coalesce("next", "behind").alias("next")).where("next <> conv")
    pairs = following.join(ranged.select(F.col("conv").alias("next"), F.col("last_text").alias("other_text")), "next").drop("next")
    kept = at.join(pairs, "conv").where("at <= last_at")
    chosen = kept.select(F.col("conv").alias("pair_id"), "at", "role", "text")
    rejected = kept.select(F.col("conv").alias("pair_id"), "at", "role", F.when(F.col("at") == F.col("last_at"), F.col("other_text")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected
