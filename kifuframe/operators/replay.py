"""Replay of games as set operations.

A move is accepted when it is on the board and its cell was not played before, so a
board is the set of accepted moves so far. A game has at most n*n of them however
long its log is. They are kept as its *line*, three arrays in order of play:
``line_plies`` (when), ``black_line`` and ``white_line`` (where). The side to move
alternates with accepted moves, so a position is a prefix of the two cell arrays. Every
board quantity follows from the line and a ply by plain array functions, without a
window over the game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifuframe.functions import board
from kifuframe.functions.arrays import computed_once, let
from kifuframe.operators.ordering import CHUNK, chunk_of

LINE = ("line_plies", "black_line", "white_line")


def _every_other(cells: Column, first: int) -> Column:
    return F.filter(cells, lambda _, i: i % 2 == first)


def line_from_moves(games: DataFrame, n: int | Column, moves: str = "moves") -> DataFrame:
    """Line of each game from its move array; row-local, no shuffle. ``n`` may be a column of the game."""
    cells = F.transform(F.col(moves), lambda m: F.when(
        board.in_bounds(m["row"], m["col"], n), board.cell_of(m["row"], m["col"], n)))
    touched = computed_once(games, _cells=cells)
    touched = computed_once(touched, _taken=F.array_distinct(F.array_compact("_cells")))
    plies = let(F.col("_cells"), lambda found: F.transform(
        "_taken", lambda c: (F.array_position(found, c) - 1).cast("int")))
    return computed_once(
        touched, line_plies=plies, black_line=_every_other(F.col("_taken"), 0),
        white_line=_every_other(F.col("_taken"), 1), n_moves=F.size(moves).cast("bigint"),
    ).drop("_cells", "_taken")


def game_lines(moves: DataFrame, n: int) -> DataFrame:
    """``game_id, line_plies, black_line, white_line, last_ply, n_moves`` from a moves table.

    First touches are combined per (game, cell) before the shuffle, so a game with any
    number of moves sends at most n*n + 1 rows per map task.
    """
    on_board = F.when(
        board.in_bounds(F.col("row"), F.col("col"), n), board.cell_of(F.col("row"), F.col("col"), n))
    touches = (
        moves.select("game_id", "ply", on_board.alias("cell"))
        .groupBy("game_id", "cell")
        .agg(F.min("ply").alias("first_ply"), F.max("ply").alias("last_ply"), F.count("*").alias("n_moves"))
    )
    stone = F.when(F.col("cell").isNotNull(), F.struct(F.col("first_ply").alias("ply"), "cell"))
    played = touches.groupBy("game_id").agg(
        F.sort_array(F.collect_list(stone)).alias("stones"),
        F.max("last_ply").alias("last_ply"),
        F.sum("n_moves").alias("n_moves"),
    )
    return _as_lines(played)


def _as_lines(played: DataFrame) -> DataFrame:
    """Stones in order of play as the three arrays of a line."""
    return played.select(
        "game_id",
        F.col("stones.ply").alias("line_plies"),
        _every_other(F.col("stones.cell"), 0).alias("black_line"),
        _every_other(F.col("stones.cell"), 1).alias("white_line"),
        "last_ply", "n_moves",
    )


def place_moves(moves: DataFrame, n: int | Column) -> DataFrame:
    """Add the replay columns to moves that already carry their game's line."""
    here = board.in_bounds(F.col("row"), F.col("col"), n)
    # the ply's place among the sorted accepted plies is the number of earlier ones
    before = F.array_position(F.sort_array(F.array_append("line_plies", F.col("ply"))), F.col("ply")) - 1
    placed = moves.select(
        "*",
        here.alias("in_bounds"),
        F.when(here, board.cell_of(F.col("row"), F.col("col"), n)).alias("cell"),
        before.cast("int").alias("n_before"),
        F.array_contains("line_plies", F.col("ply")).alias("accepted"),
    )
    return placed.withColumn("player", F.when(F.col("n_before") % 2 == 0, 1).otherwise(-1))


def move_ranges(moves: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``game_id, _chunk, _moves``: the moves of each range of plies in order, as one bounded array.

    The only exchange of move-size data in a replay. A game with very many moves has many
    ranges, which different tasks hold; other games have one.
    """
    columns = ["ply", *(c for c in moves.columns if c not in ("game_id", "ply", "cell"))]
    # what the join back would filter out is filtered here, so that both uses of the ranges share one exchange
    at = chunk_of(F.col("ply"), chunk)
    placed = moves.where(F.col("game_id").isNotNull() & F.col("ply").isNotNull() & at.isNotNull())
    return placed.groupBy("game_id", at.alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("_moves"))


def lines_of_ranges(ranges: DataFrame, n: int) -> DataFrame:
    """The lines of :func:`game_lines` from ranges: their first touches, at most n*n small rows per range, are merged."""
    found = F.transform("_moves", lambda m: F.when(
        board.in_bounds(m["row"], m["col"], n), board.cell_of(m["row"], m["col"], n)))
    held = computed_once(
        ranges.select("game_id", "_moves", F.get(F.col("_moves.ply"), F.size("_moves") - 1).alias("last_ply")), _cells=found)
    touched = F.transform(F.array_distinct(F.array_compact("_cells")), lambda c: F.struct(
        F.get(F.col("_moves.ply"), (F.array_position("_cells", c) - 1).cast("int")).alias("ply"), c.alias("cell")))
    # a range without a stone still counts its moves
    each = held.select("game_id", "last_ply", F.size("_moves").alias("moves"), F.posexplode_outer(touched).alias("at", "touch"))
    firsts = each.groupBy("game_id", "touch.cell").agg(
        F.min("touch.ply").alias("ply"), F.max("last_ply").alias("last_ply"),
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, F.col("moves"))).alias("n_moves"))
    played = firsts.groupBy("game_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("ply", "cell")))).alias("stones"),
        F.max("last_ply").alias("last_ply"), F.sum("n_moves").alias("n_moves"))
    return _as_lines(played)


def with_header(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines with the columns of their game's header.

    The hint keeps lines off the driver: Spark takes an array for one element, so it would broadcast far more than its limit.
    """
    return lines.hint("merge").join(headers, "game_id")


def ranges_with_lines(ranges: DataFrame, lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ranges of moves with the columns of their game's line.

    Lines are copied once per range and joined to the ranges, which lie where their exchange put them; for the hint see
    :func:`with_header`.
    """
    spread = lines.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("bigint"), chunk_of(F.col("last_ply"), chunk)))).drop("last_ply", "n_moves")
    return ranges.join(spread.hint("merge"), ["game_id", "_chunk"])


def moves_of_ranges(joined: DataFrame, n: int) -> DataFrame:
    """Moves with the replay columns, from ranges that carry their game's line."""
    others = [c for c in joined.columns if c not in ("game_id", "_chunk", "_moves")]
    return place_moves(joined.select("game_id", *others, F.inline("_moves")), n)


def replay_ranges(ranges: DataFrame, n: int, lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Moves with the replay columns and the columns of their game's line."""
    return moves_of_ranges(ranges_with_lines(ranges, lines, chunk), n)


def replay(moves: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """Moves with ``in_bounds, cell, n_before, accepted, player`` and the game's line."""
    ranges = move_ranges(moves, chunk)
    return replay_ranges(ranges, n, lines_of_ranges(ranges, n), chunk)


def replay_games(games: DataFrame, n: int | Column, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Replay straight from ``games`` with move arrays; no shuffle at all.

    ``n`` may be a column that is one of the ``keys``, for games on boards of different sizes.
    """
    return replay_lines(line_from_moves(games, n), n, keys)


def replay_lines(lined: DataFrame, n: int | Column, keys: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Replay of games that carry both their move array and their line."""
    moves = lined.select(*keys, *LINE, F.posexplode("moves").alias("ply", "move")).select(
        *keys, *LINE, "ply", "move.color", "move.row", "move.col")
    return place_moves(moves, n)


def stones_before(count: Column) -> tuple[Column, Column]:
    """Cells of the player to move and of the opponent after ``count`` accepted moves."""
    black = F.slice("black_line", F.lit(1), F.shiftright(count + 1, 1))
    white = F.slice("white_line", F.lit(1), F.shiftright(count, 1))
    black_to_move = count % 2 == 0
    return (
        F.sort_array(F.when(black_to_move, black).otherwise(white)),
        F.sort_array(F.when(black_to_move, white).otherwise(black)),
    )


def board_at(replayed: DataFrame) -> DataFrame:
    """Stones before each ply, as ``own_cells`` and ``opp_cells`` of the player to move."""
    own, opp = stones_before(F.col("n_before"))
    return replayed.withColumn("own_cells", own).withColumn("opp_cells", opp)


def legal_moves(positions: DataFrame, n: int) -> DataFrame:
    return positions.withColumn("legal_cells", board.legal_cells(F.col("own_cells"), F.col("opp_cells"), n))


def positions(moves: DataFrame, n: int) -> DataFrame:
    """One row per ply: player, own, opponent and legal cells before the move."""
    return legal_moves(board_at(replay(moves, n)), n)


def state_planes(positions: DataFrame, n: int, legal_plane: bool = True) -> DataFrame:
    return positions.withColumn("planes", board.state_planes(
        F.col("own_cells"), F.col("opp_cells"), F.col("player"), n, legal_plane))


def final_board(lines: DataFrame) -> DataFrame:
    """Black and white cells after the last move."""
    return lines.withColumn("black_cells", F.sort_array("black_line")).withColumn(
        "white_cells", F.sort_array("white_line"))


def stone_score(lines: DataFrame) -> DataFrame:
    """Stones on the board per colour."""
    return lines.withColumn("black", F.size("black_line")).withColumn("white", F.size("white_line"))


def game_outcome(lines: DataFrame, n: int | Column, require_full: bool = False) -> DataFrame:
    """Sign of the stone difference; with ``require_full`` null until the board is full.

    Colours alternate, so black is never behind: on a full odd board black always wins.
    """
    scored = stone_score(lines)
    sign = F.signum(F.col("black") - F.col("white")).cast("int")
    if require_full:
        sign = F.when(F.size("line_plies") >= n * n, sign)
    return scored.withColumn("stone_outcome", sign)


def territory_diff(replayed: DataFrame, n: int) -> DataFrame:
    """(black - white) / n^2 before the ply, seen from the player to move."""
    # colours alternate: black is one stone ahead after an odd number of moves
    ahead = F.col("n_before") % 2 * F.col("player")
    return replayed.withColumn("territory_diff", ahead / F.lit(float(n * n)))


def liberties(positions: DataFrame, n: int, keys: tuple[str, ...] = ("game_id", "ply")) -> DataFrame:
    """Empty neighbours of every stone; row-local instead of a neighbour join.

    The marks of all cells are laid out once per position and looked up by cell before the stones become rows.
    """
    player = F.col("player")
    each = let(board.signs(F.col("own_cells"), F.col("opp_cells"), n), lambda marks: F.transform(
        F.concat("own_cells", "opp_cells"), lambda cell: F.struct(
            cell.alias("cell"), (F.get(marks, cell) * player).alias("color"), board.liberties(cell, marks, n).alias("liberties"))))
    return positions.select(*keys, F.inline(each))


def validate_moves(positions: DataFrame, n: int) -> DataFrame:
    """Whether the move is on the board and its cell is empty; bounds are tested first."""
    taken = F.array_contains(F.concat("own_cells", "opp_cells"), F.col("row") * n + F.col("col"))
    return positions.withColumn(
        "valid", board.in_bounds(F.col("row"), F.col("col"), n) & ~taken)


def render_board(boards: DataFrame, n: int) -> DataFrame:
    return boards.withColumn("picture", board.render(F.col("black_cells"), F.col("white_cells"), n))


def game_summary(lines: DataFrame, games: DataFrame, n: int) -> DataFrame:
    """Per game: accepted moves, strict stone outcome and recorded result."""
    played = game_outcome(lines, n, require_full=True).select(
        "game_id", F.size("line_plies").alias("num_moves"), "stone_outcome")
    return with_header(played, games.select("game_id", "result", "outcome"))
