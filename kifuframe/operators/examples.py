"""Labelled training examples, their symmetries and epoch batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifuframe.functions import board, policy
from kifuframe.functions.arrays import let
from kifuframe.functions.keyed_random import keyed_u32
from kifuframe.operators import replay as rp
from kifuframe.operators.ordering import shuffled_positions


def value_target(outcome: Column, player: Column) -> Column:
    """0 for a drawn or unknown game, else 1 or -1 for the mover."""
    return (F.signum(outcome).cast("int") * player).cast("double")


def examples(games: DataFrame, moves: DataFrame, n: int) -> DataFrame:
    """One row per on-board move: position, action, player and value target.

    The outcome is joined to the game-level line first, so the moves table takes part
    in one join only.
    """
    ranges = rp.move_ranges(moves)
    lines = rp.with_header(rp.lines_of_ranges(ranges, n), games.select("game_id", "outcome"))
    return _labelled(rp.replay_ranges(ranges, n, lines))


def examples_from_games(games: DataFrame, n: int | Column, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Examples from parsed records; from file scan to example without a shuffle."""
    return _labelled(rp.replay_games(games, n, keys + ("outcome",)))


def _labelled(replayed: DataFrame) -> DataFrame:
    on_board = replayed.where(F.col("in_bounds"))
    return (
        rp.board_at(on_board)
        .withColumn("action", F.col("cell"))
        .withColumn("value", value_target(F.col("outcome"), F.col("player")))
        .drop(*rp.LINE)
    )


def turned_lines(lines: DataFrame, n: int, convention: str = "canonical") -> DataFrame:
    """Eight rows per row with a line: the line under each symmetry, and the ``images`` of all cells."""
    turned = lines.select("*", F.inline(board.transforms_literal(n, convention)))
    for name in ("black_line", "white_line"):
        turned = turned.withColumn(name, let(F.col("images"), lambda images: F.transform(
            name, lambda c: F.get(images, c))))
    return turned


def augmented_examples(games: DataFrame, moves: DataFrame, n: int, convention: str = "canonical") -> DataFrame:
    """The result of ``augment_examples(examples(...))``, with the symmetries applied per game.

    A turned position is a prefix of a turned line, so cells are mapped once per range of moves and
    symmetry instead of once per position. Lines are turned after their join, which so moves each line once and not eight times.
    """
    ranges = rp.move_ranges(moves)
    lines = rp.with_header(rp.lines_of_ranges(ranges, n), games.select("game_id", "outcome"))
    turned = turned_lines(rp.ranges_with_lines(ranges, lines), n, convention)
    return _turned_back(_labelled(rp.moves_of_ranges(turned, n)))


def augmented_examples_from_games(games: DataFrame, n: int, keys: tuple[str, ...] = ("game_id",),
                                  convention: str = "canonical") -> DataFrame:
    """Augmented examples from parsed records, without a shuffle."""
    lined = turned_lines(rp.line_from_moves(games, n), n, convention)
    return _turned_back(_labelled(rp.replay_lines(lined, n, keys + ("outcome", "transform_id", "images"))))


def _turned_back(labelled: DataFrame) -> DataFrame:
    return labelled.withColumn("action", F.get("images", F.col("action"))).drop("images")


def policy_target(df: DataFrame, n: int, action: str = "action") -> DataFrame:
    """One-hot policy of the played cell."""
    return df.withColumn("policy", policy.one_hot(F.col(action), n * n))


def augment_examples(examples: DataFrame, n: int, convention: str = "canonical") -> DataFrame:
    """Eight rows per example; action, stones and policy move together.

    The symmetries are exploded from a literal, so this stays in the scan stage.
    """
    moved = examples.withColumn("_t", F.explode(board.transforms_literal(n, convention)))
    t = F.col("_t")
    moved = moved.withColumn("transform_id", t["transform_id"])
    for name in ("action", "next_action"):
        if name in examples.columns:
            moved = moved.withColumn(name, board.apply_transform(F.col(name), t))
    for name in ("own_cells", "opp_cells", "legal_cells", "next_own_cells", "next_opp_cells"):
        if name in examples.columns:
            moved = moved.withColumn(name, board.transform_cells(F.col(name), t))
    if "policy" in examples.columns:
        moved = moved.withColumn(
            "policy", board.transform_vector(F.col("policy"), F.col("transform_id"), n, convention))
    return moved.drop("_t")


def symmetry_map(n: int, cells: DataFrame, cell: str = "cell", convention: str = "canonical") -> DataFrame:
    """``from_cell, transform_id, to_cell`` for every cell row given."""
    return cells.withColumn("_t", F.explode(board.transforms_literal(n, convention))).select(
        *[c for c in cells.columns if c != cell],
        F.col(cell).alias("from_cell"),
        F.col("_t")["transform_id"].alias("transform_id"),
        board.apply_transform(F.col(cell), F.col("_t")).alias("to_cell"),
    )


def epoch_batches(examples: DataFrame, batch_size: int, seed: int, epochs: int,
                  keys: tuple[str, ...] = ("game_id", "ply"), bits: int | None = None) -> DataFrame:
    """Shuffled fixed-size batches per epoch; the last batch of an epoch may be short.

    The examples are read once and exchanged once for all epochs, so they may be a long derivation. ``bits`` is taken
    for older callers and changes nothing: the shuffle needs no width to be set.
    """
    drawn = (
        examples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("_draw", keyed_u32(F.lit(seed) + F.col("epoch"), *[F.col(k) for k in keys]))
    )
    placed = shuffled_positions(drawn, "epoch", "_draw", keys, "_position")
    return (
        placed.withColumn("batch", F.call_function("div", F.col("_position"), F.lit(batch_size)))
        .withColumn("slot", F.col("_position") % batch_size)
        .drop("_draw", "_position")
    )
