"""Transitions and returns along the accepted moves of a game.

These run on game lines. A line holds at most n*n moves, so windows over a game are
bounded, and the partitioning by game comes from building the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kifuframe.operators import replay as rp
from kifuframe.operators.examples import augment_examples

def _by_game() -> WindowSpec:
    return Window.partitionBy("game_id").orderBy("ply")


def accepted_moves(lines: DataFrame, n: int) -> DataFrame:
    """Accepted moves, renumbered from 0, with player, action and territory difference."""
    kept = [c for c in lines.columns if c not in ("last_ply", "n_moves")]
    black_moves = F.col("ply") % 2 == 0
    pair = F.shiftright("ply", 1)
    moves = (
        lines.select(*kept, F.posexplode("line_plies").alias("ply", "_logged_ply"))
        .withColumn("action", F.when(black_moves, F.get("black_line", pair)).otherwise(F.get("white_line", pair)))
        .withColumn("n_before", F.col("ply"))
        .withColumn("player", F.when(black_moves, 1).otherwise(-1))
        .drop("_logged_ply", "line_plies")
    )
    return rp.territory_diff(moves, n)


def transitions(moves: DataFrame) -> DataFrame:
    """Next ply (the last one points to itself) and the done flag."""
    following = F.lead("ply").over(_by_game())
    return moves.withColumn("next_ply", F.coalesce(following, F.col("ply"))).withColumn(
        "done", following.isNull())


def n_step_return(moves: DataFrame, n_step: int = 5, gamma: float = 0.99,
                  diff: str = "territory_diff") -> DataFrame:
    """Discounted sum of up to ``n_step`` differences ahead, signs as they are."""
    ahead = F.collect_list(diff).over(_by_game().rowsBetween(0, n_step - 1))
    discounted = F.transform(ahead, lambda x, i: F.pow(F.lit(gamma), i) * x)
    return moves.withColumn(
        "n_step_return", F.aggregate(discounted, F.lit(0.0), lambda acc, x: acc + x))


def rewards(transitions: DataFrame, outcome: str = "stone_outcome", n_step: int = 5,
            gamma: float = 0.99, diff: str = "territory_diff") -> DataFrame:
    """N-step return, but at the last move the difference plus the final outcome."""
    last = F.col(diff) + F.coalesce(F.col(outcome).cast("double"), F.lit(0.0))
    return n_step_return(transitions, n_step, gamma, diff).withColumn(
        "reward", F.when(F.col("done"), last).otherwise(F.col("n_step_return")))


def next_values(moves: DataFrame, value: str = "value") -> DataFrame:
    """Value predicted for the next position (the last move keeps its own)."""
    return moves.withColumn("next_value", F.coalesce(F.lead(value).over(_by_game()), F.col(value)))


def td_target(reward: Column, done: Column, next_value: Column, n_step: int = 5,
              gamma: float = 0.99) -> Column:
    return reward + F.when(done, 0.0).otherwise(gamma ** n_step * next_value)


def td_error(value: Column, target: Column) -> Column:
    return F.abs(value - target)


def transition_positions(transitions: DataFrame) -> DataFrame:
    """Stones before the move and before the next one, seen from each mover."""
    own, opp = rp.stones_before(F.col("ply"))
    next_own, next_opp = rp.stones_before(F.col("next_ply"))
    return (
        transitions.withColumn("own_cells", own).withColumn("opp_cells", opp)
        .withColumn("next_own_cells", next_own).withColumn("next_opp_cells", next_opp)
        .drop("black_line", "white_line")
    )


def augment_transitions(transitions: DataFrame, n: int, convention: str = "canonical") -> DataFrame:
    """Eight rows per transition; action, position, next position and policy move alike."""
    return augment_examples(transitions, n, convention)
