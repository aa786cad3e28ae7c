"""Operators on a predictions table ``(position_id, logits, fast_logits, value, legal)``.

Logits are short arrays, so choosing, ranking and blending stay inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifuframe.functions import board, policy
from kifuframe.functions.arrays import let
from kifuframe.functions.keyed_random import keyed_uniform
from kifuframe.operators import trees
from kifuframe.session import stored

# Weights of the policy and of the next value in a blended choice.
POLICY_SHARE = 0.7
VALUE_SHARE = 0.3


def softmax(df: DataFrame, temperature: float = 1.0, logits: str = "logits") -> DataFrame:
    return df.withColumn("probs", policy.softmax(F.col(logits), temperature))


def masked_policy(df: DataFrame, temperature: float = 1.0, logits: str = "logits",
                  legal: str = "legal") -> DataFrame:
    return df.withColumn("probs", policy.masked_policy(F.col(logits), F.col(legal), temperature))


def greedy_move(df: DataFrame, logits: str = "logits", legal: str = "legal") -> DataFrame:
    return df.withColumn("move", policy.greedy_cell(F.col(logits), F.col(legal)))


def sample_move(df: DataFrame, seed: int, temperature: float = 1.0, key: str = "position_id",
                logits: str = "logits", legal: str = "legal") -> DataFrame:
    u = keyed_uniform(seed, F.col(key))
    return df.withColumn("move", policy.sampled_cell(F.col(logits), F.col(legal), u, temperature))


def _explode_ranked(df: DataFrame, keys: Sequence[str], items) -> DataFrame:
    return df.select(*keys, F.posexplode(items).alias("rank", "item")).select(
        *keys, (F.col("rank") + 1).alias("rank"), "item.cell", "item.prob")


def candidate_array(k: int, temperature: float = 1.0, logits: str = "logits", legal: str = "legal") -> Column:
    """First ``k`` legal cells by unmasked probability, as ``array<struct<cell,prob>>``."""
    return let(policy.softmax(F.col(logits), temperature), lambda p: policy.ranked(
        F.transform(legal, lambda c: F.struct(c.alias("cell"), F.get(p, c).alias("prob"))), k))


def candidate_moves(df: DataFrame, k: int = 5, temperature: float = 1.0,
                    keys: Sequence[str] = ("position_id",), logits: str = "logits",
                    legal: str = "legal") -> DataFrame:
    """First ``k`` legal cells by unmasked probability, one row each."""
    return _explode_ranked(df, keys, candidate_array(k, temperature, logits, legal))


def suggest_moves(df: DataFrame, n: int, k: int = 5, temperature: float = 1.0,
                  keys: Sequence[str] = ("position_id",), logits: str = "logits") -> DataFrame:
    """First ``k`` cells by probability, legal or not, with row and column."""
    items = policy.ranked(policy.indexed(policy.softmax(F.col(logits), temperature)), k)
    return _explode_ranked(df, keys, items).withColumn("row", board.row_of(F.col("cell"), n)).withColumn(
        "col", board.col_of(F.col("cell"), n))


def evaluate_positions(df: DataFrame) -> DataFrame:
    """Best cell over the whole board, its probability and the value; no mask."""
    best = let(policy.softmax(F.col("logits")), lambda p: F.struct(
        policy.best_cell(p).alias("best_move"), F.array_max(p).alias("best_prob")))
    return df.withColumn("_best", best).select(
        "position_id", "_best.best_move", "_best.best_prob", "value")


def blend_select(df: DataFrame, next_values: DataFrame, k: int = 5, temperature: float = 1.0) -> DataFrame:
    """Best of ``0.7 p + 0.3 v_next`` among the legal cells of the top ``k``.

    ``next_values(position_id, cell, next_value)`` holds the value after each candidate,
    not negated. Falls back to the first legal cell, or 0 when none is left.
    """
    top = policy.ranked(policy.indexed(policy.softmax(F.col("logits"), temperature)), k)
    fallback = F.coalesce(F.get("legal", F.lit(0)), F.lit(0))
    tried = df.select(
        "position_id", fallback.alias("_fallback"), "legal", F.posexplode(top).alias("_rank", "_item"),
    ).select(
        "position_id", "_fallback", "_rank", F.col("_item.cell").alias("cell"), F.col("_item.prob").alias("_prob"),
        F.array_contains("legal", F.col("_item.cell")).alias("_legal"))
    # illegal candidates stay, without a score, so that no second join brings the fallback back
    scored = tried.join(next_values.select("position_id", "cell", "next_value"), ["position_id", "cell"], "left")
    score = POLICY_SHARE * F.col("_prob") + VALUE_SHARE * F.col("next_value")
    usable = F.when(F.col("_legal") & score.isNotNull(), F.struct(
        score.alias("score"), (-F.col("_rank")).alias("first"), "cell"))
    return scored.groupBy("position_id").agg(
        F.max(usable).alias("_best"), F.max("_fallback").alias("_fallback"),
    ).select(
        "position_id",
        F.coalesce(F.col("_best.cell"), F.col("_fallback")).cast("int").alias("move"),
        F.col("_best.score").alias("score"),
    )


def policy_distribution(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Probability of every cell; uniform when the soft-max does not sum to a positive number."""
    return df.withColumn("probs", policy.distribution(F.col("logits"), temperature))


def compare_heads(df: DataFrame, n: int, k: int = 5) -> DataFrame:
    """Top ``k`` of the policy and of the fast policy, side by side."""
    heads = F.array(
        F.struct(F.lit("policy").alias("head"), F.col("logits").alias("head_logits")),
        F.struct(F.lit("fast_policy").alias("head"), F.col("fast_logits").alias("head_logits")),
    )
    return suggest_moves(
        df.select("position_id", F.inline(heads)), n, k, keys=("position_id", "head"), logits="head_logits")


def expand_positions(positions: DataFrame, candidates: DataFrame | Column,
                     keys: Sequence[str] = ("game_id", "ply")) -> DataFrame:
    """One-ply children: the mover's stone is placed and the sides change.

    ``candidates`` is a table with ``keys`` and ``cell``, joined to the positions, or an
    array column of the positions (:func:`candidate_array`), which needs no join.
    """
    if isinstance(candidates, DataFrame):
        children = positions.join(candidates.select(*keys, F.col("cell").alias("child_cell")), list(keys))
    else:
        children = positions.select("*", F.explode(candidates).alias("_item")).withColumn(
            "child_cell", F.col("_item.cell"))
    return children.select(
        *keys,
        "child_cell",
        (-F.col("player")).alias("player"),
        F.col("opp_cells").alias("own_cells"),
        F.sort_array(F.array_append("own_cells", F.col("child_cell"))).alias("opp_cells"),
    )


def backup_tree(nodes: DataFrame) -> DataFrame:
    """Values backed up a stored tree: ``node, parent, level, reward, value``.

    ``nodes(node, parent, level, reward, leaf_value)``; a parent is one level above its children, else the job
    fails. Even levels take the maximum of ``child + reward``, odd levels the minimum of ``child - reward``; a node
    without children, or whose children have no value or reward, keeps its leaf value. No pruning.

    By tree contraction (:mod:`kifuframe.operators.trees`), so the jobs grow with the logarithm of the tree's depth where it is a
    chain; contributions are combined before they are exchanged, so a node with very many children is no hot spot.
    """
    kind = nodes.schema["level"].dataType
    held = stored(nodes.select("node", "parent", "level", "reward", "leaf_value"), "tree")
    above = held.select(F.col("node").alias("_of"), F.col("level").alias("_level"))
    stray = F.raise_error(F.concat(F.lit("no node one level up: "), F.col("parent").cast("string"))).cast("bigint")
    joined = held.join(above, F.col("parent") == F.col("_of"), "left")
    fits = F.col("parent").isNull() | F.coalesce(F.col("_level") + 1 == F.col("level"), F.lit(False))
    gain = F.when((F.col("level") - 1) % 2 == 0, F.col("reward")).otherwise(-F.col("reward"))
    values = trees.contracted(joined.select(
        "node", F.when(fits, F.when(gain.isNotNull(), F.col("parent"))).otherwise(stray.cast(held.schema["parent"].dataType)).alias("parent"),
        (F.col("level") % 2 == 0).alias("largest"), gain.cast("double").alias("gain"), F.col("leaf_value").cast("double").alias("own")))
    return held.join(values.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select(
        "node", "parent", F.col("level").cast(kind).alias("level"), "reward", "value")
