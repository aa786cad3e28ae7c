import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifuframe.functions import board
from kifuframe.operators import examples as ex
from kifuframe.operators import replay, trajectory


def turn(grid, tid):
    return [
        lambda g: g, np.rot90, lambda g: np.rot90(g, 2), lambda g: np.rot90(g, 3), np.fliplr, np.flipud,
        np.transpose, lambda g: np.flipud(np.fliplr(g.T))][tid](grid)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 19])
def test_symmetries_match_arrays_and_form_a_group(n):
    grid = np.arange(n * n).reshape(n, n)
    maps = [board.image_cells(tid, n) for tid in range(8)]
    for tid, images in enumerate(maps):
        moved = np.empty(n * n, int)
        moved[images] = grid.ravel()
        assert (moved.reshape(n, n) == turn(grid, tid)).all()
        assert [maps[board.INVERSE_TRANSFORM[tid]][c] for c in images] == list(range(n * n))
        for other in maps:
            assert [other[c] for c in images] in maps
    assert len({tuple(m) for m in maps}) == (8 if n > 2 else len({tuple(m) for m in maps}))


def test_loader_convention_swaps_the_flips():
    assert board.image_cells(4, 9, "loader") == board.image_cells(5, 9)
    assert board.image_cells(1, 9, "loader") == board.image_cells(1, 9)


def test_vector_and_planes(spark):
    n = 3
    vec, planes = np.arange(9.0), np.arange(19 * 9.0).reshape(19, n, n)
    df = spark.range(8).select(
        F.col("id").cast("int").alias("tid"), F.lit(vec.tolist()).alias("v"), F.lit(planes.ravel().tolist()).alias("p"))
    out = df.select(
        "tid", board.transform_vector(F.col("v"), F.col("tid"), n).alias("v"),
        board.transform_planes(F.col("p"), F.col("tid"), n).alias("p")).collect()
    for row in out:
        assert row.v == turn(vec.reshape(n, n), row.tid).ravel().tolist()
        assert row.p == np.stack([turn(p, row.tid) for p in planes]).ravel().tolist()


@pytest.fixture(scope="module")
def four_moves(spark):
    rows = [(1, i, "BW"[i % 2], r, c) for i, (r, c) in enumerate([(3, 3), (15, 15), (3, 15), (15, 3)])]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int")
    games = spark.createDataFrame([(1, "B+1.5", 1)], "game_id bigint, result string, outcome int")
    return games, moves


def test_golden_examples(four_moves):
    games, moves = four_moves
    rows = ex.policy_target(ex.examples(games, moves, 19), 19).orderBy("ply").collect()
    assert [(r.action, r.value, r.player) for r in rows] == [
        (60, 1.0, 1), (300, -1.0, -1), (72, 1.0, 1), (288, -1.0, -1)]
    assert all(len(r.policy) == 361 and sum(r.policy) == 1.0 and r.policy[r.action] == 1.0 for r in rows)


def test_occupied_and_off_board_moves(spark):
    rows = [(1, 0, "B", 0, 0), (1, 1, "W", 0, 0), (1, 2, "B", 9, 0), (1, 3, "W", 1, 1)]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int")
    games = spark.createDataFrame([(1, -1)], "game_id bigint, outcome int")
    got = [(r.ply, r.action, r.player, r.value, r.accepted) for r in ex.examples(games, moves, 9).orderBy("ply").collect()]
    assert got == [(0, 0, 1, -1.0, True), (1, 0, -1, 1.0, False), (3, 10, -1, 1.0, True)]


def test_augmentation_moves_everything_together(four_moves):
    games, moves = four_moves
    base = ex.policy_target(ex.examples(games, moves, 19), 19)
    for row in ex.augment_examples(base, 19).collect():
        images = board.image_cells(row.transform_id, 19)
        before = [60, 300, 72, 288][:row.ply]
        assert row.policy.index(1.0) == row.action == images[[60, 300, 72, 288][row.ply]]
        assert sorted(row.own_cells + row.opp_cells) == sorted(images[c] for c in before)
        assert row.own_cells == sorted(row.own_cells)


def test_augmenting_per_game_equals_augmenting_per_position(spark):
    rng = np.random.default_rng(12)
    logs = {g: rng.integers(0, 30, (40, 2)).tolist() for g in range(4)}
    rows = [(g, p, "B", r % 6, c % 6) for g, log in logs.items() for p, (r, c) in enumerate(log)]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int")
    games = spark.createDataFrame([(g, g % 3 - 1) for g in logs], "game_id bigint, outcome int")
    columns = ["game_id", "ply", "transform_id", "action", "player", "value", "own_cells", "opp_cells"]
    for convention in ("canonical", "loader"):
        one = ex.augment_examples(ex.examples(games, moves, 5), 5, convention).select(*columns).collect()
        two = ex.augmented_examples(games, moves, 5, convention).select(*columns).collect()
        arrays = spark.createDataFrame(
            [(g, g % 3 - 1, [("B", r % 6, c % 6) for r, c in log]) for g, log in logs.items()],
            "game_id bigint, outcome int, moves array<struct<color:string,row:int,col:int>>")
        three = ex.augmented_examples_from_games(arrays, 5, convention=convention)
        assert "Exchange" not in three._jdf.queryExecution().executedPlan().toString()
        assert len(one) == 8 * sum(r % 6 < 5 and c % 6 < 5 for log in logs.values() for r, c in log)
        assert sorted(map(str, one)) == sorted(map(str, two)) == sorted(map(str, three.select(*columns).collect()))


def test_value_is_zero_without_winner(spark):
    df = spark.createDataFrame([(0, 1), (0, -1), (1, -1), (-1, -1)], "o int, p int")
    assert [str(r.v) for r in df.select(ex.value_target(F.col("o"), F.col("p")).alias("v")).collect()] == [
        "0.0", "0.0", "-1.0", "1.0"]


def test_epoch_batches_cover_each_epoch_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("game_id"), F.col("id").alias("ply"))
    for bits in (2, 16):
        rows = ex.epoch_batches(df, 64, 5, 3, bits=bits).collect()
        assert len(rows) == 3000
        orders = []
        for epoch in range(3):
            mine = sorted((r.batch, r.slot, r.ply) for r in rows if r.epoch == epoch)
            assert [b * 64 + s for b, s, _ in mine] == list(range(1000))
            assert sorted(p for _, _, p in mine) == list(range(1000))
            orders.append([p for _, _, p in mine])
        assert orders[0] != orders[1] and orders[0] != list(range(1000))


def test_epoch_batches_read_their_input_once_and_follow_the_draw(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    # a third of the rows is one game, and some rows are repeated
    rows = [(0 if i % 3 == 0 else i % 11, i // 2, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "game_id bigint, ply bigint, extra int").mapInPandas(
        watched, "game_id bigint, ply bigint, extra int")
    got = ex.epoch_batches(df, 100, 9, 2).collect()
    assert seen.value == len(rows) and len(got) == 2 * len(rows)
    for epoch in range(2):
        draws = [(int(hashlib.md5(f"{g}:{p}:{9 + epoch}".encode()).hexdigest()[:8], 16), g, p) for g, p, _ in rows]
        mine = sorted((r.batch * 100 + r.slot, r.game_id, r.ply) for r in got if r.epoch == epoch)
        assert [at for at, _, _ in mine] == list(range(len(rows)))
        assert [(g, p) for _, g, p in mine] == [(g, p) for _, g, p in sorted(draws)]
        assert {r.extra for r in got if r.epoch == epoch} == set(range(1500))


def test_epoch_batches_of_nothing(spark):
    assert ex.epoch_batches(spark.createDataFrame([], "game_id bigint, ply bigint"), 8, 1, 2).count() == 0


def test_trajectory_equals_loop(spark):
    rng = np.random.default_rng(5)
    n, gamma, steps = 4, 0.9, 3
    logs = {g: rng.integers(0, n * n + 3, 30).tolist() for g in range(5)}
    rows = [(g, p, "B", c // n, c % n) for g, log in logs.items() for p, c in enumerate(log)]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int")
    lines = replay.game_outcome(replay.game_lines(moves, n), n)
    held = trajectory.rewards(
        trajectory.transitions(trajectory.accepted_moves(lines, n)), "stone_outcome", steps, gamma)
    held = trajectory.next_values(held, "territory_diff")
    target = trajectory.td_target(F.col("reward"), F.col("done"), F.col("next_value"), steps, gamma)
    got = {(r.game_id, r.ply): r for r in held.withColumn("target", target).collect()}
    for g, log in logs.items():
        cells = list(dict.fromkeys(c for c in log if c < n * n))
        diffs, players, ahead = [], [], 0
        for i in range(len(cells)):
            player = 1 if i % 2 == 0 else -1
            diffs.append(ahead / n / n * player)
            players.append(player)
            ahead += player
        for i, cell in enumerate(cells):
            last = i == len(cells) - 1
            reward = sum(gamma ** j * d for j, d in enumerate(diffs[i:i + steps]))
            if last:
                reward = diffs[i] + np.sign(ahead)
            row = got[g, i]
            assert (row.action, row.player, row.done, row.next_ply) == (cell, players[i], last, i if last else i + 1)
            assert row.reward == pytest.approx(reward)
            assert row.target == pytest.approx(reward + (0 if last else gamma ** steps * diffs[i + 1]))
    assert len(got) == sum(len(set(c for c in log if c < n * n)) for log in logs.values())


def test_augmented_transitions_turn_the_next_position(spark):
    rows = [(1, 0, "B", 0, 1), (1, 1, "W", 2, 2)]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int")
    held = trajectory.transition_positions(
        trajectory.transitions(trajectory.accepted_moves(replay.game_lines(moves, 3), 3)))
    out = trajectory.augment_transitions(held, 3).where("ply = 0").collect()
    assert len(out) == 8
    for row in out:
        images = board.image_cells(row.transform_id, 3)
        assert row.action == images[1] and row.next_opp_cells == [images[1]] and row.own_cells == []


def test_lines_are_not_broadcast(spark):
    """Spark takes an array column for one element, so lines (eight of each, with their images) went through the driver."""
    rows = [(g, p, "B", (p + g) % 6, p // 6) for g in range(6) for p in range(30)]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int").withColumn("ply", F.col("ply").cast("bigint"))
    games = spark.createDataFrame([(g, g % 3 - 1) for g in range(6)], "game_id bigint, outcome int")
    for df in (ex.augmented_examples(games, moves, 5), ex.examples(games, moves, 5)):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan.split("Initial Plan")[0]
