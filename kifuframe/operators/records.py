"""From record text to the ``games`` and ``moves`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kifuframe.functions import board, sgf
from kifuframe.functions.arrays import computed_once

SEGMENT = 1_024


def parse_properties(records: DataFrame, text: str = "text") -> DataFrame:
    """Add ``body`` (text without comments) and ``properties``."""
    stripped = computed_once(records, body=sgf.strip_comments(F.col(text)))
    return computed_once(stripped, properties=sgf.extract_properties(F.col("body")))


def game_header(records: DataFrame) -> DataFrame:
    """Typed header columns from ``properties``, with the defaults of the format."""
    def prop(key: str):
        return F.try_element_at(F.col("properties"), F.lit(key))

    def text(key: str):
        return F.coalesce(prop(key), F.lit(""))

    return (
        records.withColumn("board_size", sgf.parse_board_size(prop("SZ")))
        .withColumn("result", text("RE"))
        .withColumn("black_player", text("PB"))
        .withColumn("white_player", text("PW"))
        .withColumn("game_date", text("DT"))
        .withColumn("komi", sgf.parse_komi(prop("KM")))
    )


def parse_headers(records: DataFrame, text: str = "text", board_size: int | None = None) -> DataFrame:
    """Records with their header columns; ``body`` is left for :func:`parse_moves`."""
    games = game_header(parse_properties(records, text)).drop(text)
    return games if board_size is None else filter_board_size(games, board_size)


def parse_moves(headed: DataFrame, strict: bool = False) -> DataFrame:
    """Games with their moves as an array and their outcome."""
    return computed_once(
        headed, moves=sgf.move_array(F.col("body"), strict), outcome=sgf.parse_result(F.col("result"))).drop("body")


def parse_games(records: DataFrame, text: str = "text", board_size: int | None = None,
                strict: bool = False) -> DataFrame:
    """Records to ``games`` with the moves kept as an array: no shuffle, no Python.

    The size filter runs on the header, before any move is decoded or exploded.
    """
    return parse_moves(parse_headers(records, text, board_size), strict)


def filter_board_size(games: DataFrame, n: int) -> DataFrame:
    return games.where(F.col("board_size") == n)


def extract_moves(games: DataFrame, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """One row per move from the ``moves`` array."""
    return games.select(*keys, F.posexplode("moves").alias("ply", "move")).select(
        *keys, "ply", "move.color", "move.row", "move.col")


def with_cell(moves: DataFrame, n: int) -> DataFrame:
    """Cell id of each move; null off the board."""
    row, col = F.col("row"), F.col("col")
    return moves.withColumn("cell", F.when(board.in_bounds(row, col, n), board.cell_of(row, col, n)))


def with_row_col(cells: DataFrame, n: int, cell: str = "cell") -> DataFrame:
    return cells.withColumn("row", board.row_of(F.col(cell), n)).withColumn(
        "col", board.col_of(F.col(cell), n))


def move_sequence(moves: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Positions in order, one array per game.

    Plies are gathered in ranges of ``segment`` first, so that sorting a long game is shared by many tasks
    and the game itself only strings its ranges together.
    """
    parts = (
        moves.groupBy("game_id", F.call_function("div", F.col("ply"), F.lit(segment)).alias("segment"))
        .agg(F.transform(
            F.sort_array(F.collect_list(F.struct("ply", "row", "col"))),
            lambda m: F.struct(m["row"].alias("row"), m["col"].alias("col"))).alias("part")))
    return parts.groupBy("game_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("segment", "part"))), lambda p: p["part"])).alias("positions"))
