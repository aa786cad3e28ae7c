import numpy as np
import pytest

from kifuframe.operators import examples as ex
from kifuframe.operators import models, ratings, replay
from kifuframe.operators import replay_table as rt
from kifuframe.sources import records as sources
from kifuframe.streaming import ratings as stream_ratings
from kifuframe.streaming import records as stream_records
from kifuframe.streaming import replay as stream_replay
from kifuframe.streaming import sinks


def test_stream_games_equals_batch_scan(spark, tmp_path):
    files, out = tmp_path / "in", str(tmp_path / "out")
    (files / "sub").mkdir(parents=True)
    for i in range(5):
        (files / "sub" / f"{i}.SGF").write_text(f"(;SZ[9]KM[{i}.5];B[aa];W[bb])")

    def drain():
        games = stream_records.stream_games(spark, str(files), 9, files_per_trigger=2).drop("properties")
        sinks.write_batches(games, f"{out}/data", f"{out}/log").awaitTermination()
        return sorted(map(str, spark.read.parquet(f"{out}/data").drop("batch_id").collect()))

    drain()
    (files / "late.sgf").write_text("(;SZ[9];B[cc])")
    want = sorted(map(str, sources.read_game_dir(spark, str(files), 9).drop("properties").collect()))
    assert drain() == want and len(want) == 6
    assert spark.read.parquet(f"{out}/data").select("batch_id").distinct().count() == 4


def test_stream_elo_over_batches_equals_batch_elo(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(p, i, i % 2 == 0, int(rng.integers(-1, 2))) for p in range(4) for i in range(30)]
    schema = "player bigint, game_idx bigint, plays_black boolean, outcome int"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    everything = spark.createDataFrame(rows, schema)
    for part in range(3):
        everything.where(f"game_idx div 10 = {part}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        sinks.write_batches(stream_ratings.stream_elo(stream), f"{out}/data", f"{out}/log", "update").awaitTermination()
    last = spark.read.parquet(f"{out}/data").where("num_games = 30")
    want = {r.player: r for r in ratings.elo(everything).collect()}
    tally = {r.player: r for r in ratings.tally(everything).collect()}
    got = last.collect()
    assert len(got) == 4
    for row in got:
        assert row.elo == pytest.approx(want[row.player].elo)
        assert (row.wins, row.losses, row.draws) == tuple(tally[row.player][c] for c in ("wins", "losses", "draws"))


def test_stream_elo_puts_games_in_order(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(p, i, i % 2 == 0, None if i == 5 else int(rng.integers(-1, 2))) for p in range(3) for i in range(40)]
    schema = "player bigint, game_idx bigint, plays_black boolean, outcome int"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    dealt = [[] for _ in range(4)]
    for row in rows:
        dealt[3 if row[1] == 0 else int(rng.integers(0, 4))].append(row)  # each player's first game comes last
    for part in dealt:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        sinks.write_batches(stream_ratings.stream_elo(stream), f"{out}/data", f"{out}/log", "update").awaitTermination()
    seen = spark.read.parquet(f"{out}/data")
    everything = spark.createDataFrame(rows, schema)
    want, tally = ({r.player: r for r in table.collect()} for table in (ratings.elo(everything), ratings.tally(everything)))
    got = {r.player: r for r in seen.where("num_games = 40").collect()}
    assert got.keys() == {0, 1, 2} and seen.where("num_games between 1 and 39").count() == 0
    for player, row in got.items():
        assert row.elo == pytest.approx(want[player].elo, abs=1e-9)
        assert (row.wins, row.losses, row.draws) == tuple(tally[player][c] for c in ("wins", "losses", "draws"))


def test_stream_elo_takes_the_type_of_its_players(spark, tmp_path):
    schema = "player string, game_idx bigint, plays_black boolean, outcome int"
    spark.createDataFrame([("ann", 0, True, 1), ("bob", 0, True, -1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    sinks.write_batches(stream_ratings.stream_elo(stream), f"{out}/data", f"{out}/log", "update").awaitTermination()
    assert {r.player: r.wins for r in spark.read.parquet(f"{out}/data").collect()} == {"ann": 1, "bob": 0}


def test_stream_replay_is_a_ring_with_feedback(spark, tmp_path):
    folder, out, errors = (str(tmp_path / name) for name in ("in", "out", "errors"))
    capacity, steps = 120, 5
    table = spark.createDataFrame([], "seq bigint, priority double")
    for step in range(steps):
        batch = spark.range(step * 50, step * 50 + 50).withColumnRenamed("id", "seq")
        batch.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("seq bigint").parquet(folder)
        stream_replay.stream_replay(
            stream, f"{out}/data", f"{out}/log", capacity, errors=errors, order="at").awaitTermination()
        table = rt.evict(rt.push(table, batch, ["seq"]), capacity)
        found = spark.createDataFrame([(step * 50 + 7, -float(9 - step), step)], "seq bigint, td_error double, at int")
        found.write.mode("append").parquet(errors)
        table = spark.createDataFrame(rt.update_priorities(table, found, "at").collect(), table.schema)
    got = stream_replay.read_replay(spark, f"{out}/data", capacity, errors=errors, order="at")
    assert sorted(map(tuple, got.select("seq", "priority").collect())) == sorted(map(tuple, table.collect()))
    assert got.count() == capacity
    # what had left the ring before the last micro-batch is gone from storage
    assert spark.read.parquet(f"{out}/data").count() == 200


@pytest.fixture(scope="module")
def diagonal(spark):
    rows = [(g, i, "B", i, i) for g in range(5) for i in range(9)]
    moves = spark.createDataFrame(rows, "game_id bigint, ply int, color string, row int, col int")
    games = spark.createDataFrame([(g, "B+1.5", 1) for g in range(5)], "game_id bigint, result string, outcome int")
    return ex.examples(games, moves, 9)


def test_pretrain_score_and_round_trip(spark, diagonal, tmp_path):
    model, report = models.pretrain(diagonal, 9, epochs=2)
    assert report["epochs"] == 2 and report["total_examples"] == 45 and np.isfinite(report["pretrain_loss"])
    sources.write_run(model, {"phase": "pretrain", **report}, str(tmp_path / "run"), spark)
    loaded, metadata = sources.read_run(spark, str(tmp_path / "run"))
    assert {r.key: r.value for r in metadata.collect()}["phase"] == "pretrain"
    first, again = (models.score(diagonal, m, 9).orderBy("game_id", "ply").collect() for m in (model, loaded))
    assert [r.logits for r in first] == [r.logits for r in again]
    assert len(first[0].logits) == 81 and all(np.isfinite(r.value_output) for r in first)


def test_pretrain_reaches_the_best_losses(spark):
    """Each position has its own features, so the unpenalised optimum predicts the shares and the mean seen at it."""
    rng = np.random.default_rng(12)
    rows = []
    for own, opp, player, chances in (([], [], 1, (6, 3, 1)), ([], [4], -1, (2, 2, 6)), ([4], [0], 1, (1, 8, 1))):
        for action in rng.choice([1, 2, 3], 400, p=np.array(chances) / 10).tolist():
            rows.append((own, opp, player, action, float(rng.choice([-1.0, 0.0, 1.0]))))
    table = spark.createDataFrame(rows, "own_cells array<int>, opp_cells array<int>, player int, action int, value double")
    _, report = models.pretrain(table, 3, epochs=200, reg=0.0)
    entropy = spread = 0.0
    for key in {str(r[:3]) for r in rows}:
        mine = [r for r in rows if str(r[:3]) == key]
        _, times = np.unique([r[3] for r in mine], return_counts=True)
        entropy -= float((times * np.log(times / len(mine))).sum()) / len(rows)
        spread += float(np.var([r[4] for r in mine])) * len(mine) / len(rows)
    assert report["policy_loss"] == pytest.approx(entropy, abs=2e-3) and report["policy_loss"] >= entropy - 1e-9
    assert report["fast_loss"] == pytest.approx(entropy, abs=2e-3)
    assert report["value_loss"] == pytest.approx(spread, abs=1e-6)
    assert report["pretrain_loss"] == pytest.approx(report["policy_loss"] + report["value_loss"] + 0.5 * report["fast_loss"])


def test_logits_cover_unplayed_cells(diagonal):
    model, _ = models.pretrain(diagonal.where("ply < 3"), 9, epochs=1)
    assert len(models.score(diagonal, model, 9).first().logits) == 81


def test_score_with_any_function(spark, diagonal):
    def make():
        def predict(planes):
            flat = planes.reshape(len(planes), -1).astype("float64")
            return {"logits": flat[:, :81] * 2, "value": flat[:, 16 * 81], "fast_logits": flat[:, 8 * 81:9 * 81]}
        return predict

    planes = replay.state_planes(replay.legal_moves(diagonal, 9), 9)
    rows = models.score_with(planes.select("game_id", "ply", "player", "own_cells", "planes"), make, 9, 16).collect()
    assert len(rows) == 45
    for row in rows:
        assert [i for i, x in enumerate(row.logits) if x] == row.own_cells and row.value == row.player


def test_stream_elo_calls_python_per_group_of_players(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_ratings, "GROUPS", 3)
    big = 1 << 60
    rows = [(p, i, i % 2 == 0, (i + j) % 3 - 1) for j, p in enumerate([None, *range(big, big + 20)]) for i in range(6)]
    schema = "player bigint, game_idx bigint, plays_black boolean, outcome int"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    everything = spark.createDataFrame(rows, schema)
    for part in ("game_idx >= 3", "game_idx < 3"):
        everything.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_ratings.stream_elo(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    assert "_group" in stream._jdf.queryExecution().analyzed().toString()
    sinks.write_batches(stream, f"{out}/data", f"{out}/log", "update").awaitTermination()
    got = {r.player: r for r in spark.read.parquet(f"{out}/data").where("num_games = 6").collect()}
    want = {r.player: r.elo for r in ratings.elo(everything).collect()}
    assert set(got) == {None, *range(big, big + 20)}
    assert all(got[p].elo == pytest.approx(want[p]) for p in want)
