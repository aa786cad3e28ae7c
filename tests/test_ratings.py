import numpy as np
import pytest
from pyspark.sql import functions as F

from kifuframe.operators import ordering, ratings

SCHEMA = "player bigint, game_idx bigint, plays_black boolean, outcome int"


@pytest.fixture(scope="module")
def series():
    """Outcomes per player; player 3 only wins, 4 only loses, 5 plays a long series."""
    rng = np.random.default_rng(1)
    made = {p: rng.choice([1, -1, 0, None], k).tolist() for p, k in enumerate([1, 9, 35])}
    made[3] = [1 if i % 2 == 0 else -1 for i in range(50)]
    made[4] = [-1 if i % 2 == 0 else 1 for i in range(50)]
    made[5] = rng.choice([1, -1, 0], 4000).tolist()
    return made


@pytest.fixture(scope="module")
def matches(spark, series):
    rows = [(p, i, i % 2 == 0, o) for p, outcomes in series.items() for i, o in enumerate(outcomes)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def seen(outcomes):
    return [0 if o is None else (o if i % 2 == 0 else -o) for i, o in enumerate(outcomes)]


def fold(outcomes, start, opponent):
    rating, out = start, []
    for s in seen(outcomes):
        rating += 32 * ({1: 1.0, -1: 0.0}.get(s, 0.5) - 1 / (1 + 10 ** ((opponent - rating) / 400)))
        out.append(rating)
    return out


@pytest.mark.parametrize("chunk", [5, 1500, 65_536])
@pytest.mark.parametrize("start, opponent", [(1000.0, 1000.0), (1500.0, 1500.0), (1200.0, 1500.0)])
def test_elo_equals_loop(matches, series, chunk, start, opponent):
    got = {r.player: (r.elo, r.num_games) for r in ratings.elo(matches, start, opponent, chunk=chunk).collect()}
    for player, outcomes in series.items():
        assert got[player] == (pytest.approx(fold(outcomes, start, opponent)[-1], abs=1e-6), len(outcomes))


@pytest.mark.parametrize("chunk", [7, 1500, 65_536])
def test_histories_equal_loop(matches, series, chunk):
    elo = {(r.player, r.games): r.elo for r in ratings.elo_history(matches, 10, chunk=chunk).collect()}
    counts = {(r.player, r.games): (r.wins, r.losses, r.draws) for r in ratings.tally_history(matches, 10, chunk).collect()}
    want_elo, want_counts = {}, {}
    for player, outcomes in series.items():
        rated, side = fold(outcomes, 1000.0, 1000.0), seen(outcomes)
        for games in range(10, len(outcomes) + 1, 10):
            want_elo[player, games] = rated[games - 1]
            want_counts[player, games] = tuple(side[:games].count(v) for v in (1, -1, 0))
    assert elo == pytest.approx(want_elo, abs=1e-6)
    assert counts == want_counts


def test_long_series_settle(matches):
    """Mixed results forget where they started, so their chunks fold side by side."""
    chunks = ratings._score_chunks(matches.where("player = 5"), 1500)
    low = ratings._fold(F.col("scores"), F.lit(-5000.0), 1000.0, 32.0)
    high = ratings._fold(F.col("scores"), F.lit(7000.0), 1000.0, 32.0)
    gaps = [r.gap for r in chunks.where("chunk < 2").select((high - low).alias("gap")).collect()]
    assert len(gaps) == 2 and max(gaps) < ratings.SETTLED_GAP


def test_tallies(matches, series):
    tally = {r.player: r for r in ratings.tally(matches).collect()}
    strict = {r.player: r for r in ratings.elo_tally(matches).collect()}
    rate = {r.player: r.win_rate for r in ratings.win_rate(matches).collect()}
    for player, outcomes in series.items():
        side = seen(outcomes)
        row = tally[player]
        assert (row.wins, row.losses, row.draws) == tuple(side.count(v) for v in (1, -1, 0))
        assert row.num_games == len(outcomes) and rate[player] == pytest.approx(side.count(1) / len(outcomes))
        assert strict[player].draws == row.draws - outcomes.count(None)


def test_colours_and_pairs(spark):
    df = spark.createDataFrame([(0,), (1,)], "i int")
    assert [r.b for r in df.select(ratings.plays_black(F.col("i"), False).alias("b")).collect()] == [False, True]
    games = spark.createDataFrame([(1, 2, 1), (1, 2, -1), (1, 2, None), (2, 1, 0)], "black int, white int, outcome int")
    rows = {(r.black, r.white): (r.black_wins, r.white_wins, r.draws, r.num_games) for r in ratings.head_to_head(games).collect()}
    assert rows == {(1, 2): (1, 1, 1, 3), (2, 1): (0, 0, 1, 1)}


def test_latency(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("z", 0.0)], "run string, seconds double")
    rows = {r.run: r for r in ratings.latency_summary(df, ["run"]).collect()}
    assert (rows["a"].avg_time, rows["a"].positions_per_second, rows["z"].positions_per_second) == (1.0, 1.0, 0.0)


def test_row_numbers_of_hot_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.choice([1, 1, 1, 2, 3, 4], 3000), rng.integers(0, 500, 3000)))]
    df = spark.createDataFrame(rows, "key int, t int, id int")
    numbered = ordering.number_rows(df.repartition(7), "key", ["t", "id"], "at")
    got = {r.id: r["at"] for r in numbered.collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == key)
        assert [got[i] for _, i in mine] == list(range(len(mine)))
    assert len(got) == 3000


@pytest.mark.parametrize("k", [32.0, 694.0, 2000.0, 6000.0])
def test_elo_of_any_step_equals_the_loop(spark, k):
    rng = np.random.default_rng(8)
    rows = [(p, i, bool(i % 2), int(rng.integers(-1, 2))) for p in range(12) for i in range(200)]
    df = spark.createDataFrame(rows, "player int, game_idx int, plays_black boolean, outcome int")
    got = {r.player: r.elo for r in ratings.elo(df, k=k, chunk=32).collect()}
    for player in range(12):
        rating = 1000.0
        for _, _, black, outcome in rows[player * 200:(player + 1) * 200]:
            score = {1: 1.0, -1: 0.0, 0: 0.5}[outcome if black else -outcome]
            rating += k * (score - 1 / (1 + 10 ** ((1000.0 - rating) / 400)))
        assert got[player] == pytest.approx(rating, abs=1e-6)
