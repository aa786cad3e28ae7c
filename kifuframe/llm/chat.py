"""Preference formatting: two versions of a conversation become one prompt and two masked completions.

Only DataFrame functions. The turns that both versions begin with are rendered once as the prompt;
what follows is rendered for each, in segments that say whether the loss counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the rendered form, and the role whose words are trained on.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text; nulls equal each other."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])))
    return F.coalesce(F.get(differ, F.lit(0)), shorter)


def segments(turns: Column) -> Column:
    """Rendered turns: for each its opening, never trained on, and its words with the closing mark."""
    def of(turn: Column) -> Column:
        role, words = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
        return F.array(
            F.struct(F.concat(F.lit(BEGIN), role, F.lit("\n")).alias("text"), F.lit(False).alias("train")),
            F.struct(F.concat(words, F.lit(END)).alias("text"), (role == TRAINED).alias("train")))

    return F.flatten(F.transform(turns, of))


def text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def mask_of(parts: Column) -> Column:
    """Run lengths in characters, ``0:20,1:35`` for 20 untrained and 35 trained ones."""
    return F.array_join(F.transform(parts, lambda s: F.concat(
        s["train"].cast("int").cast("string"), F.lit(":"), F.char_length(s["text"]).cast("string"))), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: ``pair, prompt_turns, prompt, chosen, rejected``, the last two as segments.

    * Turns are ordered by (turn, role, text), nulls first; null roles and texts render as empty.
    * Equal versions give a prompt of all turns and empty completions; a version that is the beginning of the
      other has an empty completion; a version that is missing is empty, and so is then the prompt.
    * Repeated rows are repeated turns. Rows with a null pair id form one pair. Other columns are ignored;
      empty tables give an empty table.

    One exchange: both versions are gathered by pair together. A pair is one output row, so its turns have to
    fit into one; nothing else is gathered.
    """
    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(F.col(pair).alias("pair"), F.lit(number).alias("side"), F.struct(
            F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("said"))

    def version(number: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == number, F.col("said"))))

    both = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("pair").agg(
        version(0).alias("c"), version(1).alias("r"))
    cut = both.withColumn("k", common_turns(F.col("c"), F.col("r")))
    after = lambda turns: F.slice(turns, F.col("k") + 1, F.size(turns))
    return cut.select(
        F.col("pair").alias(pair), F.col("k").cast("bigint").alias("prompt_turns"),
        text_of(segments(F.slice("c", F.lit(1), F.col("k")))).alias("prompt"),
        segments(after(F.col("c"))).alias("chosen"), segments(after(F.col("r"))).alias("rejected"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """A second version of each conversation (``conv_id, turn, role, text``), as a rejected side.

    It ends with the last answer of its neighbour (the id with the lowest bit flipped) in the place of its own
    last answer. Without an answer of its own it stays as it is, null turns included; without one next door it ends before it.
    In a conversation with an answer, the turns after the last one answered the text that is replaced, so they are not
    part of the second version; nor are null turns, which have no place before it. The SQL says the same. Both remain in the chosen version.
    """
    last = conversations.where(F.col("role") == TRAINED).groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("x")).select(
        F.col("conv_id").alias("of"), F.col("x.turn").alias("ends"), F.col("x.text").alias("answer"))
    kept = conversations.join(last.select("of", "ends"), F.col("conv_id") == F.col("of"), "left").where(
        F.col("ends").isNull() | (F.col("turn") < F.col("ends"))).select("conv_id", "turn", "role", "text")
    other = last.select(F.col("of").bitwiseXOR(F.lit(1).cast("bigint")).alias("to"), F.col("answer").alias("theirs"))
    swapped = last.join(other, F.col("of") == F.col("to")).select(
        F.col("of").alias("conv_id"), F.col("ends").alias("turn"), F.lit(TRAINED).alias("role"), F.col("theirs").alias("text"))
    return kept.unionByName(swapped)
