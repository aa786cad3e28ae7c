"""Registered queries: every operator over the given tables.

Arrays are rendered as text or exploded, and computed doubles rounded to six digits,
so the results compare value by value with the SQL of ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.functions import board, policy, sgf
from kifuframe.functions.arrays import computed_once
from kifuframe.operators import examples as ex
from kifuframe.operators import losses, models, predictions, ratings, records, replay, trajectory
from kifuframe.operators import replay_table as rt
from kifuframe.plans import corpus
from kifuframe.plans import fixtures as fx
from kifuframe.plans.fixtures import LOGIT_N, SEED, N
from kifuframe.session import scratch_path
from kifuframe.sources import records as sources
from kifuframe.streaming import ratings as stream_ratings
from kifuframe.streaming import records as stream_records
from kifuframe.streaming import replay as replay_stream
from kifuframe.streaming import sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
#: Rows in the ring buffer of the replay queries.
RING = 2_500


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def text_of(cells: Column | str) -> Column:
    return F.array_join(F.col(cells) if isinstance(cells, str) else cells, ",")


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


# --- records -----------------------------------------------------------------------


@query
def strip_comments(spark, sf):
    return fx.records(spark, sf).select("game_id", "part", sgf.strip_comments(F.col("text")).alias("body"))


@query
def extract_properties(spark, sf):
    parsed = records.parse_properties(fx.records(spark, sf))
    return parsed.select("game_id", "part", F.explode("properties").alias("key", "value"))


@query
def game_header(spark, sf):
    return records.parse_games(fx.records(spark, sf)).select(
        "game_id", "part", "board_size", "result", "black_player", "white_player", "game_date", "komi", "outcome")


@query
def extract_moves(spark, sf):
    games = records.parse_games(fx.records(spark, sf))
    return records.extract_moves(games, ("game_id", "part"))


@query
def extract_moves_strict(spark, sf):
    games = records.parse_games(fx.records(spark, sf), strict=True)
    return records.extract_moves(games, ("game_id", "part"))


@query
def decode_coord(spark, sf):
    """Every coordinate pair that occurs in the records, decoded."""
    body = sgf.strip_comments(F.col("text"))
    coords = fx.records(spark, sf).select(
        F.explode(F.regexp_extract_all(body, F.lit(sgf.MOVE_PATTERN), F.lit(2))).alias("coord"))
    counted = coords.groupBy("coord").agg(F.count("*").alias("times"))
    return counted.withColumn("at", sgf.decode_coord(F.col("coord"))).select("coord", "times", "at.row", "at.col")


@query
def cell_index(spark, sf):
    cells = records.with_cell(fx.moves(spark, sf), N).select("game_id", "ply", "cell")
    return records.with_row_col(cells, N)


@query
def filter_board_size(spark, sf):
    return records.parse_games(fx.records(spark, sf), board_size=19).select(
        "game_id", "part", "board_size", F.size("moves").alias("n_moves"))


@query
def move_sequence(spark, sf):
    sequences = records.move_sequence(fx.moves(spark, sf))
    return sequences.select("game_id", F.array_join(
        F.transform("positions", lambda p: F.concat_ws(":", p["row"], p["col"])), " ").alias("positions"))


@query
def parse_result(spark, sf):
    return fx.games(spark, sf).select("game_id", "result", "outcome")


# --- replay and boards -------------------------------------------------------------


@query
def replay_moves(spark, sf):
    return replay.replay(fx.moves(spark, sf), N).select(
        "game_id", "ply", "color", "row", "col", "cell", "in_bounds", "accepted", "n_before", "player")


@query
def replay_records(spark, sf):
    """Replay straight from record text, without a shuffle after the text is there."""
    games = records.parse_games(fx.records(spark, sf))
    return replay.replay_games(games, F.col("board_size"), ("game_id", "part", "board_size")).select(
        "game_id", "part", "ply", "cell", "in_bounds", "accepted", "n_before", "player")


@query
def board_at(spark, sf):
    return replay.board_at(replay.replay(fx.moves(spark, sf), N)).select(
        "game_id", "ply", "player", text_of("own_cells").alias("own_cells"), text_of("opp_cells").alias("opp_cells"))


@query
def legal_moves(spark, sf):
    return replay.positions(fx.moves(spark, sf), N).select(
        "game_id", "ply", F.size("legal_cells").alias("n_legal"), text_of("legal_cells").alias("legal_cells"))


@query
def state_planes(spark, sf):
    planes = replay.state_planes(replay.positions(fx.moves(spark, sf), N), N)
    return planes.select("game_id", "ply", F.array_join(
        F.col("planes").cast("array<int>").cast("array<string>"), "").alias("planes"))


@query
def final_board(spark, sf):
    return replay.final_board(replay.game_lines(fx.moves(spark, sf), N)).select(
        "game_id", text_of("black_cells").alias("black_cells"), text_of("white_cells").alias("white_cells"))


@query
def stone_score(spark, sf):
    return replay.stone_score(replay.game_lines(fx.moves(spark, sf), N)).select("game_id", "black", "white")


@query
def game_outcome(spark, sf):
    lines = replay.game_lines(fx.moves(spark, sf), N)
    counted = replay.game_outcome(lines, N).withColumnRenamed("stone_outcome", "outcome_now")
    return replay.game_outcome(counted, N, require_full=True).select(
        "game_id", "outcome_now", F.col("stone_outcome").alias("outcome_full"))


@query
def territory_diff(spark, sf):
    return replay.territory_diff(replay.replay(fx.moves(spark, sf), N), N).select(
        "game_id", "ply", "player", r6("territory_diff").alias("territory_diff"))


@query
def liberties(spark, sf):
    return replay.liberties(replay.board_at(replay.replay(fx.moves(spark, sf), N)), N)


@query
def validate_moves(spark, sf):
    positions = replay.board_at(replay.replay(fx.moves(spark, sf), N))
    return replay.validate_moves(positions, N).select("game_id", "ply", "row", "col", "valid")


@query
def render_board(spark, sf):
    boards = replay.final_board(replay.game_lines(fx.moves(spark, sf), N))
    return replay.render_board(boards, N).select("game_id", "picture")


@query
def game_summary(spark, sf):
    return replay.game_summary(replay.game_lines(fx.moves(spark, sf), N), fx.games(spark, sf), N)


@query
def recorded_versus_stones(spark, sf):
    """Recorded result against stone count, from record text to one row per record."""
    games = records.parse_games(fx.records(spark, sf))
    size = F.col("board_size")
    scored = replay.game_outcome(replay.line_from_moves(games, size), size)
    return scored.select(
        "game_id", "part", "result", "outcome", F.col("n_moves").cast("int").alias("n_moves"), "black", "white",
        "stone_outcome", (F.col("outcome") == F.col("stone_outcome")).alias("agrees"))


# --- examples and symmetry ---------------------------------------------------------


def _examples(spark, sf):
    return ex.examples(fx.games(spark, sf), fx.moves(spark, sf), N)


@query
def examples(spark, sf):
    return _examples(spark, sf).select(
        "game_id", "ply", "player", "action", "value", "accepted",
        text_of("own_cells").alias("own_cells"), text_of("opp_cells").alias("opp_cells"))


@query
def examples_from_records(spark, sf):
    games = records.parse_games(fx.records(spark, sf))
    return ex.examples_from_games(games, F.col("board_size"), ("game_id", "part", "board_size")).select(
        "game_id", "part", "ply", "player", "action", "value")


@query
def policy_target(spark, sf):
    """One-hot target of every move; null off the board."""
    cells = records.with_cell(fx.moves(spark, sf), N)
    return ex.policy_target(cells, N, "cell").select("game_id", "ply", F.array_join(
        F.col("policy").cast("array<int>").cast("array<string>"), "").alias("policy"))


@query
def value_target(spark, sf):
    """Value targets counted per player to move."""
    return _examples(spark, sf).groupBy("player", "value").agg(F.count("*").alias("examples"))


@query
def epoch_batches(spark, sf):
    """Batches of two epochs; the examples are derived once for both."""
    rows = _examples(spark, sf).select("game_id", "ply", "action", "value")
    return ex.epoch_batches(rows, 256, SEED, 2).select("epoch", "batch", "slot", "game_id", "ply")


@query
def symmetry_map(spark, sf):
    cells = records.with_cell(fx.moves(spark, sf), N).where(F.col("cell").isNotNull())
    return ex.symmetry_map(N, cells.select("game_id", "ply", "cell"))


@query
def augment_examples(spark, sf):
    return ex.augment_examples(_examples(spark, sf), N).select(
        "game_id", "ply", "transform_id", "player", "action", "value",
        text_of("own_cells").alias("own_cells"), text_of("opp_cells").alias("opp_cells"))


@query
def augmented_examples(spark, sf):
    """The same rows with the symmetries applied per game instead of per position."""
    return ex.augmented_examples(fx.games(spark, sf), fx.moves(spark, sf), N).select(
        "game_id", "ply", "transform_id", "player", "action", "value",
        text_of("own_cells").alias("own_cells"), text_of("opp_cells").alias("opp_cells"))


@query
def transform_vector(spark, sf):
    """Each policy vector under the symmetry of its position id, one row per cell."""
    tid = (F.col("position_id") % 8).cast("int")
    turned = fx.logits(spark, sf).select(
        "position_id", tid.alias("transform_id"),
        F.posexplode(board.transform_vector(F.col("logits"), tid, LOGIT_N)).alias("cell", "logit"))
    return turned.withColumn("logit", r6("logit"))


@query
def transform_planes(spark, sf):
    """Planes of every position turned by the symmetry ``ply % 8``; stones of both planes."""
    held = replay.state_planes(replay.positions(fx.moves(spark, sf), N), N)
    tid = (F.col("ply") % 8).cast("int")
    turned = computed_once(held, turned=board.transform_planes(F.col("planes"), tid, N))

    def marked(plane: int) -> Column:
        cells = F.slice("turned", plane * N * N + 1, N * N)
        return text_of(F.array_compact(F.transform(cells, lambda x, i: F.when(x == 1, i))))

    return turned.select(
        "game_id", "ply", tid.alias("transform_id"), F.size("turned").alias("n_values"),
        marked(0).alias("own_cells"), marked(8).alias("opp_cells"))


# --- trajectories ------------------------------------------------------------------


def _transitions(spark, sf):
    lines = replay.game_outcome(replay.game_lines(fx.moves(spark, sf), N), N, require_full=True)
    lines = replay.with_header(lines, fx.games(spark, sf).select("game_id", "outcome"))
    return trajectory.transitions(trajectory.accepted_moves(lines, N))


@query
def transitions(spark, sf):
    return _transitions(spark, sf).select("game_id", "ply", "player", "action", "next_ply", "done")


@query
def n_step_return(spark, sf):
    return trajectory.n_step_return(_transitions(spark, sf)).select(
        "game_id", "ply", r6("n_step_return").alias("n_step_return"))


@query
def rewards(spark, sf):
    """Rewards with the recorded outcome as the final result."""
    return trajectory.rewards(_transitions(spark, sf), "outcome").select(
        "game_id", "ply", "done", r6("reward").alias("reward"))


@query
def td_target(spark, sf):
    """TD target and error with the territory difference as the value prediction."""
    moved = trajectory.rewards(_transitions(spark, sf), "outcome")
    moved = trajectory.next_values(moved, "territory_diff")
    target = trajectory.td_target(F.col("reward"), F.col("done"), F.col("next_value"))
    return moved.select(
        "game_id", "ply", r6(target).alias("td_target"),
        r6(trajectory.td_error(F.col("territory_diff"), target)).alias("td_error"))


@query
def augment_transitions(spark, sf):
    moved = trajectory.transition_positions(trajectory.rewards(_transitions(spark, sf), "outcome"))
    return trajectory.augment_transitions(moved, N).select(
        "game_id", "ply", "transform_id", "action", r6("reward").alias("reward"), "next_ply", "done",
        text_of("own_cells").alias("own_cells"), text_of("next_own_cells").alias("next_own_cells"))


# --- replay table ------------------------------------------------------------------


def _pushed(spark, sf):
    """The clicks of the table pushed onto it as a new batch; their old numbers have gaps."""
    held = fx.replay_rows(spark, sf)
    return rt.push(held, held.where(F.col("event_type") == "click").drop("priority"), ["user_id", "seq"])


@query
def replay_push(spark, sf):
    return _pushed(spark, sf).withColumn("priority", r6("priority"))


@query
def replay_push_evict(spark, sf):
    return rt.evict(_pushed(spark, sf), RING).withColumn("priority", r6("priority"))


@query
def transition_replay(spark, sf):
    """Transitions and their symmetries into an empty replay table, through its ring, and a draw from it."""
    moved = trajectory.transition_positions(trajectory.rewards(_transitions(spark, sf), "outcome"))
    queue = trajectory.augment_transitions(moved, N).select("game_id", "ply", "transform_id", "action", "reward", "done")
    empty = queue.limit(0).select("*", F.lit(0).cast("bigint").alias("seq"), F.lit(0.0).alias("priority"))
    ring = rt.evict(rt.push(empty, queue, ["game_id", "ply", "transform_id"]), RING)
    return rt.sample(ring, 64, SEED).select(
        "seq", "game_id", "ply", "transform_id", "action", r6("reward").alias("reward"), "done", "priority")


@query
def replay_evict(spark, sf):
    return rt.evict(fx.replay_rows(spark, sf), RING).withColumn("priority", r6("priority"))


@query
def sampling_probs(spark, sf):
    probs = rt.sampling_probs(fx.replay_rows(spark, sf))
    return probs.select("seq", F.round(F.col("prob") * 1000, 6).alias("prob_per_mille"))


@query
def replay_sample(spark, sf):
    return rt.sample(fx.replay_rows(spark, sf), 64, SEED).select("seq", r6("priority").alias("priority"))


@query
def importance_weights(spark, sf):
    probs = rt.sampling_probs(fx.replay_rows(spark, sf))
    drawn = rt.sample(probs, 64, SEED)
    return rt.importance_weights(drawn, probs).select("seq", r6("weight").alias("weight"))


@query
def update_priorities(spark, sf):
    updated = rt.update_priorities(fx.replay_rows(spark, sf), fx.td_errors(spark, sf))
    return updated.select("seq", r6("priority").alias("priority"))


@query
def sample_uniform(spark, sf):
    return rt.sample_uniform(fx.replay_rows(spark, sf), 64, SEED).select("seq", "weight")


# --- prediction tables -------------------------------------------------------------


def _cells(df: DataFrame, column: str = "probs", name: str = "prob") -> DataFrame:
    return df.select("position_id", F.posexplode(column).alias("cell", name)).withColumn(name, r6(name))


@query
def softmax(spark, sf):
    return _cells(predictions.softmax(fx.logits(spark, sf), 0.5))


@query
def masked_policy(spark, sf):
    return _cells(predictions.masked_policy(fx.logits(spark, sf)))


@query
def greedy_move(spark, sf):
    return predictions.greedy_move(fx.logits(spark, sf)).select("position_id", "move")


@query
def sample_move(spark, sf):
    return predictions.sample_move(fx.logits(spark, sf), SEED).select("position_id", "move")


@query
def candidate_moves(spark, sf):
    return predictions.candidate_moves(fx.logits(spark, sf), 5).withColumn("prob", r6("prob"))


@query
def suggest_moves(spark, sf):
    return predictions.suggest_moves(fx.logits(spark, sf), LOGIT_N, 5).withColumn("prob", r6("prob"))


@query
def evaluate_positions(spark, sf):
    return predictions.evaluate_positions(fx.logits(spark, sf)).withColumn(
        "best_prob", r6("best_prob")).withColumn("value", r6("value"))


def next_value_rows(df: DataFrame, k: int) -> DataFrame:
    """Value after each candidate: here read off the fast policy of the same cell."""
    top = predictions.suggest_moves(df, LOGIT_N, k, keys=("position_id", "fast_logits"))
    return top.select("position_id", "cell", F.tanh(F.get("fast_logits", F.col("cell"))).alias("next_value"))


@query
def blend_select(spark, sf):
    held = fx.logits(spark, sf)
    return predictions.blend_select(held, next_value_rows(held, 5), 5).withColumn("score", r6("score"))


@query
def policy_distribution(spark, sf):
    return _cells(predictions.policy_distribution(fx.logits(spark, sf), 2.0))


@query
def compare_heads(spark, sf):
    return predictions.compare_heads(fx.logits(spark, sf), LOGIT_N, 5).withColumn("prob", r6("prob"))


@query
def expand_positions(spark, sf):
    """Children of every position under the first three cells of a flat policy."""
    held = replay.positions(fx.moves(spark, sf), N)
    flat = held.withColumn("logits", F.array_repeat(F.lit(0.0), N * N))
    tried = predictions.candidate_array(3, legal="legal_cells")
    return predictions.expand_positions(flat, tried).select(
        "game_id", "ply", "child_cell", "player",
        text_of("own_cells").alias("own_cells"), text_of("opp_cells").alias("opp_cells"))


@query
def backup_tree(spark, sf):
    return predictions.backup_tree(fx.tree(spark, sf)).select("node", "level", r6("value").alias("value"))


# --- losses and schedules ----------------------------------------------------------


def _target() -> Column:
    return policy.one_hot(F.col("target_action"), LOGIT_N * LOGIT_N)


def _losses(spark, sf):
    df = losses.policy_cross_entropy(fx.logits(spark, sf), _target())
    return losses.fast_kl(losses.value_mse(df))


@query
def policy_cross_entropy(spark, sf):
    return losses.policy_cross_entropy(fx.logits(spark, sf), _target()).select(
        "position_id", r6("policy_loss").alias("policy_loss"))


@query
def value_mse(spark, sf):
    return losses.value_mse(fx.logits(spark, sf)).select("position_id", r6("value_loss").alias("value_loss"))


@query
def fast_kl(spark, sf):
    return losses.fast_kl(fx.logits(spark, sf)).groupBy("batch").agg(r6(F.avg("fast_loss")).alias("fast_loss"))


@query
def fast_cross_entropy(spark, sf):
    return losses.fast_cross_entropy(fx.logits(spark, sf)).select(
        "position_id", r6("fast_loss").alias("fast_loss"))


@query
def total_loss(spark, sf):
    df = losses.policy_cross_entropy(fx.logits(spark, sf), _target())
    df = losses.fast_cross_entropy(losses.value_mse(df))
    out = losses.total_loss(df, ["epoch", "batch"], "weight")
    return out.select("epoch", "batch", *[
        r6(c).alias(c) for c in ("policy_loss", "value_loss", "fast_loss", "total_loss")])


@query
def epoch_loss(spark, sf):
    batches = losses.total_loss(_losses(spark, sf), ["epoch", "batch"])
    return losses.epoch_loss(batches).withColumn("loss", r6("loss"))


@query
def cosine_lr(spark, sf):
    """Learning rate at each step of a log with one step per event."""
    step = F.col("event_id")
    return fx.table(spark, sf, "events").select(
        step.alias("step"), F.round(losses.cosine_lr(step) * 1000, 6).alias("lr_e3"))


@query
def temperature(spark, sf):
    step = F.col("event_id")
    return fx.table(spark, sf, "events").select(step.alias("step"), r6(losses.temperature(step)).alias("temperature"))


# --- ratings -----------------------------------------------------------------------


@query
def tally(spark, sf):
    return ratings.tally(fx.matches(spark, sf))


@query
def win_rate(spark, sf):
    return ratings.win_rate(fx.matches(spark, sf)).select("player", "num_games", r6("win_rate").alias("win_rate"))


@query
def elo(spark, sf):
    return ratings.elo(fx.matches(spark, sf)).withColumn("elo", r6("elo"))


@query
def elo_fixed_1500(spark, sf):
    return ratings.elo(fx.matches(spark, sf), 1500.0, 1500.0).withColumn("elo", r6("elo"))


@query
def elo_history(spark, sf):
    return ratings.elo_history(fx.matches(spark, sf)).withColumn("elo", r6("elo"))


@query
def tally_history(spark, sf):
    return ratings.tally_history(fx.matches(spark, sf))


@query
def elo_tally(spark, sf):
    return ratings.elo_tally(fx.matches(spark, sf))


@query
def head_to_head(spark, sf):
    return ratings.head_to_head(fx.pairings(spark, sf))


@query
def latency_summary(spark, sf):
    out = ratings.latency_summary(fx.timings(spark, sf), ["run"])
    return out.select("run", "num_positions", *[
        r6(c).alias(c) for c in ("avg_time", "min_time", "max_time", "positions_per_second")])


# --- sources and sinks -------------------------------------------------------------


def _loaded(games: DataFrame, name: str) -> DataFrame:
    return games.select(
        *corpus.ids_of(name), "board_size", "result", "komi", F.size("moves").alias("n_moves"))


@query
def read_game_dir(spark, sf):
    return _loaded(sources.read_game_dir(spark, corpus.file_corpus(spark, sf), board_size=9), "source")


@query
def read_game_file(spark, sf):
    """Every file by its own path, given as a glob."""
    folder = corpus.file_corpus(spark, sf)
    return _loaded(sources.read_game_file(spark, f"{folder}/d*/*-*.*"), "source")


@query
def read_game_archive(spark, sf):
    """Every archive by its own path, given as a glob."""
    folder = corpus.archive_corpus(spark, sf)
    return _loaded(sources.read_game_archive(spark, f"{folder}/games-*.tgz"), "member")


@query
def read_game_archives(spark, sf):
    return _loaded(sources.read_game_archives(spark, corpus.archive_corpus(spark, sf)), "member")


@query
def limit_games(spark, sf):
    """The cap as a feature: the first 50 games by path."""
    folder = corpus.file_corpus(spark, sf)
    return _loaded(sources.read_game_dir(spark, folder, board_size=9, max_games=50), "source")


@query
def write_and_read_games(spark, sf):
    path = scratch_path(spark, "games")
    games = records.parse_games(fx.records(spark, sf))
    sources.write_games(games.select(
        "game_id", "part", "board_size", "outcome",
        F.transform("moves", lambda m: board.cell_of(m["row"], m["col"], 19)).alias("cells")), path)
    back = sources.read_games(spark, path)
    return back.select("game_id", "part", "board_size", "outcome", text_of("cells").alias("cells"))


# --- models ------------------------------------------------------------------------


def _finite(*names: str) -> Column:
    held = F.lit(True)
    for name in names:
        held = held & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < F.lit(float("inf")))
    return held


@query
def pretrain(spark, sf):
    """Supervised fit on all examples; the report as one row, and whether each loss beats a constant guess."""
    held = _examples(spark, sf)
    _, report = models.pretrain(held, N, epochs=3)
    spread = held.agg(F.var_pop("value")).scalar()
    guess = float(np.log(N * N))
    return spark.createDataFrame([report]).select(
        "epochs", "total_examples", (F.col("policy_loss") < guess).alias("policy_learns"),
        (F.col("fast_loss") < guess).alias("fast_learns"), (F.col("value_loss") < spread + 1e-9).alias("value_learns"),
        (F.abs(F.col("pretrain_loss") - F.col("policy_loss") - F.col("value_loss") - 0.5 * F.col("fast_loss")) < 1e-9)
        .alias("adds_up"))


@query
def write_and_read_run(spark, sf):
    """Metadata and stages of a stored run; fitted losses only as whether they are numbers."""
    model, report = models.pretrain(_examples(spark, sf), N, epochs=2)
    path = scratch_path(spark, "run")
    sources.write_run(model, {"phase": "pretrain", **report}, path, spark)
    loaded, metadata = sources.read_run(spark, path)
    number = F.col("value").cast("double")
    shown = F.when(F.col("key").endswith("loss"), F.when(number >= 0, "number").otherwise("odd")).otherwise(F.col("value"))
    return metadata.select("key", shown.alias("value"), F.lit(len(loaded.stages)).alias("stages"))


@query
def score_with_pipeline(spark, sf):
    """Every position scored: whether the moves are on the board and the values are numbers."""
    held = _examples(spark, sf)
    model, _ = models.pretrain(held, N, epochs=2)
    scored = models.score(held.select("game_id", "ply", "player", "own_cells", "opp_cells"), model, N)
    best, fast = policy.best_cell(F.col("logits")), policy.best_cell(F.col("fast_logits"))
    return scored.select(
        "game_id", "ply", best.between(0, N * N - 1).alias("on_board"), fast.between(0, N * N - 1).alias("fast_on_board"),
        _finite("value_output").alias("is_number"))


def stone_count_predictor():
    """Array function standing in for a network: empty points and stone counts."""
    def predict(planes):
        own, opp, empty = planes[:, 0], planes[:, 8], planes[:, 17]
        logits = (empty - 0.5 * own - opp).reshape(len(planes), -1).astype("float64")
        value = np.tanh((own - opp).sum(axis=(1, 2)).astype("float64"))
        return {"logits": logits, "value": value, "fast_logits": logits[:, ::-1]}

    return predict


@query
def score_with_function(spark, sf):
    planes = replay.state_planes(replay.positions(fx.moves(spark, sf), N), N).select("game_id", "ply", "planes")
    scored = models.score_with(planes, stone_count_predictor, N)
    return scored.select(
        "game_id", "ply", r6("value").alias("value"), policy.best_cell(F.col("logits")).alias("best_move"),
        r6(F.aggregate("logits", F.lit(0.0), lambda a, x: a + x)).alias("logit_sum"))


# --- streams -----------------------------------------------------------------------


@query
def stream_games(spark, sf):
    folder, out = corpus.file_corpus(spark, sf), scratch_path(spark, "stream-games")
    stream = stream_records.stream_games(spark, folder)
    sinks.write_batches(_loaded(stream, "source"), f"{out}/data", f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("batch_id")


def files_per_batch(spark, path: str, least: int, batches: int = 12) -> int:
    """Files per micro-batch for about ``batches`` of them, ``least`` at least: a micro-batch commits the state of all players, so
    their number must not grow with the input."""
    return max(least, -(-len(spark.read.parquet(path).inputFiles()) // batches))


@query
def stream_elo(spark, sf):
    """Final running rating and tally of each player."""
    out = scratch_path(spark, "stream-elo")
    # files of game ranges in order of writing, a few per micro-batch
    matches = fx.matches(spark, sf)
    for part, held in enumerate(("game_idx < 5", "game_idx >= 5 and game_idx < 15", "game_idx >= 15")):
        matches.where(held).write.mode("append" if part else "overwrite").parquet(f"{out}/matches")
    stream = spark.readStream.schema(matches.schema).option(
        "maxFilesPerTrigger", files_per_batch(spark, f"{out}/matches", 4)).parquet(f"{out}/matches")
    rated = stream_ratings.stream_elo(stream)
    sinks.write_batches(rated, f"{out}/data", f"{out}/log", "update").awaitTermination()
    last = F.max_by(F.struct("elo", "wins", "losses", "draws", "num_games"), "num_games").alias("last")
    return spark.read.parquet(f"{out}/data").groupBy("player").agg(last).select("player", "last.*").withColumn(
        "elo", r6("elo"))


@query
def stream_replay(spark, sf):
    """Four micro-batches through the ring, with the errors of all clicks fed back from the start."""
    out = scratch_path(spark, "stream-replay")
    events = fx.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    rows = events.count()
    for quarter in range(4):
        low, high = -(-quarter * rows // 4), -(-(quarter + 1) * rows // 4)
        events.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{out}/rows")
    fx.td_errors(spark, sf).write.parquet(f"{out}/errors")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/rows")
    replay_stream.stream_replay(
        stream, f"{out}/data", f"{out}/log", RING, errors=f"{out}/errors").awaitTermination()
    return replay_stream.read_replay(spark, f"{out}/data", RING, errors=f"{out}/errors").withColumn("priority", r6("priority"))
