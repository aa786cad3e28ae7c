import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifuframe.functions import board
from kifuframe.operators import replay

N = 5


@pytest.fixture(scope="module")
def logs():
    """Random logs with off-board and repeated moves; one is far longer than a board."""
    rng = random.Random(11)
    lengths = [0, 1, 7, 40, 40, 400]
    return {g: [(rng.randint(0, N), rng.randint(0, N)) for _ in range(k)] for g, k in enumerate(lengths)}


def play(log):
    """Plain loop over one game: state before each move."""
    grid, player, count, out = np.zeros((N, N), int), 1, 0, []
    for ply, (row, col) in enumerate(log):
        on = 0 <= row < N and 0 <= col < N
        ok = bool(on and grid[row, col] == 0)
        out.append((ply, on, ok, count, player, grid.copy()))
        if ok:
            grid[row, col], player, count = player, -player, count + 1
    return out, grid


@pytest.fixture(scope="module")
def moves(spark, logs):
    rows = [(g, p, "BW"[p % 2], r, c) for g, log in logs.items() for p, (r, c) in enumerate(log)]
    return spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int").cache()


@pytest.mark.parametrize("chunk", [3, 65_536])
def test_replay_equals_loop(moves, logs, chunk):
    positions = replay.legal_moves(replay.board_at(replay.replay(moves, N, chunk=chunk)), N)
    got = {(r.game_id, r.ply): r for r in positions.collect()}
    assert len(got) == sum(len(log) for log in logs.values())
    for g, log in logs.items():
        for ply, on, ok, count, player, grid in play(log)[0]:
            row = got[g, ply]
            assert (row.in_bounds, row.accepted, row.n_before, row.player) == (on, ok, count, player)
            flat = grid.ravel()
            assert row.own_cells == np.flatnonzero(flat == player).tolist()
            assert row.opp_cells == np.flatnonzero(flat == -player).tolist()
            assert row.legal_cells == np.flatnonzero(flat == 0).tolist()


def test_array_replay_equals_table_replay(spark, moves, logs):
    games = spark.createDataFrame(
        [(g, [("B", r, c) for r, c in log]) for g, log in logs.items()],
        "game_id bigint, moves array<struct<color:string,row:int,col:int>>")
    columns = ["game_id", "ply", "cell", "in_bounds", "accepted", "n_before", "player"]
    by_array = sorted(map(tuple, replay.replay_games(games, N).select(*columns).collect()), key=str)
    by_table = sorted(map(tuple, replay.replay(moves, N).select(*columns).collect()), key=str)
    assert by_array == by_table


def test_replay_of_arrays_needs_no_shuffle(spark):
    games = spark.createDataFrame(
        [(1, [("B", 0, 0)])], "game_id bigint, moves array<struct<color:string,row:int,col:int>>")
    plan = replay.board_at(replay.replay_games(games, N))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_planes(moves, logs):
    planes = replay.state_planes(replay.positions(moves, N), N)
    bare = replay.state_planes(replay.positions(moves, N), N, legal_plane=False)
    got = {(r.game_id, r.ply): r.planes for r in planes.collect()}
    for g, log in logs.items():
        for ply, _, _, _, player, grid in play(log)[0]:
            want = np.zeros((19, N, N))
            want[0], want[8], want[16], want[17] = grid == player, grid == -player, player, grid == 0
            assert got[g, ply] == want.ravel().tolist()
    assert all(sum(map(abs, r.planes[17 * N * N:])) == 0 for r in bare.collect())


def test_game_level(moves, logs):
    lines = replay.final_board(replay.game_outcome(replay.game_lines(moves, N), N))
    full = {r.game_id: r.stone_outcome for r in replay.game_outcome(replay.game_lines(moves, N), N, True).collect()}
    seen = {r.game_id: r for r in lines.collect()}
    assert 0 not in seen
    for g, log in logs.items():
        if not log:
            continue
        grid = play(log)[1]
        row = seen[g]
        assert (row.black, row.white, row.n_moves) == ((grid == 1).sum(), (grid == -1).sum(), len(log))
        assert row.black_cells == np.flatnonzero(grid.ravel() == 1).tolist()
        assert row.stone_outcome == np.sign(grid.sum())
        assert full[g] == (np.sign(grid.sum()) if (grid != 0).all() else None)


def test_territory_liberties_validation(moves, logs):
    held = replay.board_at(replay.replay(moves, N))
    diff = {(r.game_id, r.ply): r.territory_diff for r in replay.territory_diff(held, N).collect()}
    valid = {(r.game_id, r.ply): r.valid for r in replay.validate_moves(held, N).collect()}
    libs = {(r.game_id, r.ply, r.cell): (r.color, r.liberties) for r in replay.liberties(held, N).collect()}
    count = 0
    for g, log in logs.items():
        for ply, _, ok, _, player, grid in play(log)[0]:
            assert diff[g, ply] == pytest.approx(grid.sum() / N / N * player)
            assert valid[g, ply] == ok
            for r, c in zip(*np.nonzero(grid)):
                near = [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
                free = sum(0 <= a < N and 0 <= b < N and grid[a, b] == 0 for a, b in near)
                assert libs[g, ply, r * N + c] == (grid[r, c], free)
                count += 1
    assert count == len(libs)


def test_empty_board_and_first_move(spark):
    df = spark.createDataFrame([(1, 0, "B", 0, 0), (1, 1, "W", 0, 1)], "game_id bigint, ply int, color string, row int, col int")
    first, second = replay.positions(df, 9).orderBy("ply").collect()
    assert len(first.legal_cells) == 81 and first.player == 1
    assert second.opp_cells == [0] and second.player == -1 and len(second.legal_cells) == 80


def test_render(spark):
    df = spark.createDataFrame([([0], [4])], "black_cells array<int>, white_cells array<int>")
    assert replay.render_board(df, 3).first().picture == "  0 1 2\n0 ● . . \n1 . ○ . \n2 . . . "


def test_summary(spark, moves):
    games = spark.createDataFrame([(1, "B+1.5", 1), (2, "", 0)], "game_id bigint, result string, outcome int")
    rows = {r.game_id: r for r in replay.game_summary(replay.game_lines(moves, N), games, N).collect()}
    assert set(rows) == {1, 2} and rows[1].result == "B+1.5"


def test_cell_maths(spark):
    df = spark.range(81).select(F.col("id").cast("int").alias("cell"))
    rows = df.select("cell", board.row_of(F.col("cell"), 9).alias("r"), board.col_of(F.col("cell"), 9).alias("c")).collect()
    assert all(row.r * 9 + row.c == row.cell and 0 <= row.c < 9 for row in rows)
