"""Win-rate and Elo tables from ``matches(player, game_idx, plays_black, outcome)``.

``game_idx`` counts a player's games from 0. ``outcome`` is 1 (black won), -1 (white
won), 0 (drawn) or null (unfinished).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.functions.arrays import computed_once, let
from kifuframe.operators.ordering import CHUNK, chunk_of, running_sums

# Fixed values.
K_FACTOR = 32.0
ELO_SCALE = 400.0
# Rating bounds of the first guess, far outside what any series of games reaches.
RATING_SPAN = 6_000.0
# Largest k for which the rating after a game still grows with the rating before it.
MONOTONE_K = 4 * ELO_SCALE / math.log(10)
SETTLED_GAP = 1e-9
# Games per array where a point is kept for some of them; enough for a series to settle.
HISTORY_CHUNK = 8_192


def plays_black(game_idx: Column, player_first: bool = True) -> Column:
    """Colours alternate by game; ``player_first`` gives black to even games."""
    return (game_idx % 2 == 0) == F.lit(player_first)


def side_result(outcome: Column, black: Column) -> Column:
    """Outcome seen from the player: 1 won, -1 lost, 0 drawn or unfinished."""
    return F.coalesce(outcome * F.when(black, 1).otherwise(-1), F.lit(0))


def score_of(outcome: Column, black: Column) -> Column:
    """1, 0 or 0.5."""
    seen = side_result(outcome, black)
    return F.when(seen == 1, 1.0).when(seen == -1, 0.0).otherwise(0.5)


def _wld() -> dict[str, Column]:
    seen = side_result(F.col("outcome"), F.col("plays_black"))
    return {"wins": seen == 1, "losses": seen == -1, "draws": seen == 0}


def tally(matches: DataFrame) -> DataFrame:
    """Wins, losses and draws per player; unfinished games count as draws."""
    return matches.groupBy("player").agg(
        *[F.count_if(hit).alias(name) for name, hit in _wld().items()], F.count("*").alias("num_games"))


def win_rate(matches: DataFrame) -> DataFrame:
    return tally(matches).withColumn("win_rate", F.col("wins") / F.col("num_games"))


def elo_tally(matches: DataFrame) -> DataFrame:
    """Counts of 1, -1 and 0 from the player's side; unfinished games are in no count."""
    seen = F.col("outcome") * F.when(F.col("plays_black"), 1).otherwise(-1)
    return matches.groupBy("player").agg(
        F.count_if(seen == 1).alias("wins"),
        F.count_if(seen == -1).alias("losses"),
        F.count_if(seen == 0).alias("draws"),
        F.count("*").alias("num_games"),
    )


def tally_history(matches: DataFrame, every: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Running wins, losses and draws after each ``every``-th game."""
    counts = {name: hit.cast("bigint") for name, hit in _wld().items()}
    running = running_sums(matches, "player", "game_idx", counts, chunk)
    return running.withColumn("games", F.col("game_idx") + 1).where(F.col("games") % every == 0).select(
        "player", "games", "wins", "losses", "draws")


def head_to_head(games: DataFrame) -> DataFrame:
    """Results per ordered pair from ``games(black, white, outcome)``."""
    return games.groupBy("black", "white").agg(
        F.count_if(F.col("outcome") == 1).alias("black_wins"),
        F.count_if(F.col("outcome") == -1).alias("white_wins"),
        F.count_if(F.coalesce(F.col("outcome"), F.lit(0)) == 0).alias("draws"),
        F.count("*").alias("num_games"),
    )


def latency_summary(timings: DataFrame, by: list[str]) -> DataFrame:
    """Average, minimum, maximum and positions per second (0 when the average is 0)."""
    return timings.groupBy(*by).agg(
        F.avg("seconds").alias("avg_time"), F.min("seconds").alias("min_time"),
        F.max("seconds").alias("max_time"), F.count("*").alias("num_positions"),
    ).withColumn("positions_per_second", F.coalesce(F.try_divide(F.lit(1.0), F.col("avg_time")), F.lit(0.0)))


# --- Elo ---------------------------------------------------------------------------


def _update(rating: Column, score: Column, opponent: float, k: float) -> Column:
    expected = 1.0 / (1.0 + F.pow(F.lit(10.0), (opponent - rating) / ELO_SCALE))
    return rating + k * (score - expected)


def _fold(scores: Column, start: Column, opponent: float, k: float) -> Column:
    return F.aggregate(scores, start, lambda acc, s: _update(acc, s, opponent, k))


def _score_chunks(matches: DataFrame, chunk: int) -> DataFrame:
    """Scores in order per player and range of games: ``player, chunk, scores``."""
    scored = matches.select(
        "player", "game_idx", score_of(F.col("outcome"), F.col("plays_black")).alias("score"),
        chunk_of(F.col("game_idx"), chunk).alias("chunk"))
    ordered = F.sort_array(F.collect_list(F.struct("game_idx", "score")))
    return scored.groupBy("player", "chunk").agg(F.transform(ordered, lambda m: m["score"]).alias("scores"))


def _chunk_starts(chunks: DataFrame, initial: float, opponent: float, k: float, chunk: int) -> DataFrame:
    """Rating at the start of each chunk after a player's first one.

    The rating after a game grows with the rating before it and the difference of two
    ratings shrinks with every game. Folding a chunk from a rating below and from one
    above every reachable rating therefore brackets the true result. When both
    meet, the chunk *settles* (for ``k`` up to MONOTONE_K; a larger one is folded in order): its end does not depend on its start, and all chunks are
    folded in parallel. Chunks that do not settle (nothing but wins, or but losses)
    keep their scores, one score and a count where all are equal, and are folded from
    the rating carried over, in order.

    Only full chunks have a successor. Their folds run where the chunks are; a settled
    chunk sends three numbers to its player's task.
    """
    low = F.lit(min(initial, opponent) - RATING_SPAN)
    high = F.lit(max(initial, opponent) + RATING_SPAN)
    settled = F.lit(k <= MONOTONE_K) & (F.abs(F.col("_high") - F.col("_low")) < SETTLED_GAP)
    even = F.array_min("scores") == F.array_max("scores")
    ends = (
        computed_once(
            chunks.where(F.size("scores") == chunk),
            _low=_fold(F.col("scores"), low, opponent, k), _high=_fold(F.col("scores"), high, opponent, k))
        .select(
            "player", "chunk", F.when(settled, F.col("_high")).alias("end"),
            # scores doubled, a byte each: an unsettled chunk is 64 KB and Arrow batches are bounded in bytes
            F.when(~settled, F.transform(
                F.when(even, F.slice("scores", 1, 1)).otherwise(F.col("scores")), lambda s: (s * 2).cast("tinyint"),
            )).alias("scores"),
            F.when(even, F.size("scores")).otherwise(1).alias("times"))
    )
    ordered = ends.repartition("player").sortWithinPartitions("player", "chunk")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, rating = None, initial
        for batch in batches:
            after = []
            for who, end, scores, times in zip(batch["player"], batch["end"], batch["scores"], batch["times"]):
                if who != player:
                    player, rating = who, initial
                if scores is None:
                    rating = end
                else:
                    for score in itertools.chain.from_iterable(itertools.repeat(scores, times)):
                        rating += k * (score / 2 - 1.0 / (1.0 + 10.0 ** ((opponent - rating) / ELO_SCALE)))
                after.append(rating)
            yield pd.DataFrame({"player": batch["player"], "chunk": batch["chunk"] + 1, "start": after})

    kind = chunks.schema["player"].dataType.simpleString()
    return ordered.mapInPandas(carry, f"player {kind}, chunk bigint, start double")


def _started_chunks(matches: DataFrame, initial: float, opponent: float, k: float,
                    chunk: int) -> DataFrame:
    """Score chunks with the rating each one starts from."""
    chunks = _score_chunks(matches, chunk)
    starts = _chunk_starts(chunks, initial, opponent, k, chunk)
    return chunks.join(starts, ["player", "chunk"], "left").withColumn(
        "start", F.coalesce(F.col("start"), F.lit(initial)))


def elo(matches: DataFrame, initial: float = 1000.0, opponent: float = 1000.0, k: float = K_FACTOR,
        chunk: int = CHUNK) -> DataFrame:
    """Final rating per player against an opponent of fixed rating.

    The two common set-ups are ``initial=1500, opponent=1500`` and ``initial`` equal to
    an opponent of 1000.
    """
    ended = _started_chunks(matches, initial, opponent, k, chunk).withColumn(
        "_end", _fold(F.col("scores"), F.col("start"), opponent, k))
    return ended.groupBy("player").agg(
        F.max_by("_end", "chunk").alias("elo"), F.sum(F.size("scores")).alias("num_games"))


def elo_history(matches: DataFrame, every: int = 10, initial: float = 1000.0, opponent: float = 1000.0,
                k: float = K_FACTOR, chunk: int = HISTORY_CHUNK) -> DataFrame:
    """Rating after each ``every``-th game.

    Inside a chunk the games between two points are folded as one block, so the array of
    points is extended once per block and not once per game.
    """
    first = F.lit(every) - F.col("chunk") * chunk % every
    blocks = F.when(F.size("scores") >= first, F.sequence(
        F.lit(0).cast("bigint"), F.call_function("div", F.size("scores") - first, F.lit(every))))

    def step(acc: Column, block: Column, scores: Column, first_end: Column) -> Column:
        begin = F.greatest(first_end + (block - 1) * every, F.lit(0))
        length = first_end + block * every - begin
        games = F.slice(scores, (begin + 1).cast("int"), length.cast("int"))
        return let(_fold(games, acc["rating"], opponent, k), lambda rating: F.struct(
            rating.alias("rating"), F.array_append(acc["points"], rating).alias("points")))

    start = F.struct(F.col("start").alias("rating"), F.array().cast("array<double>").alias("points"))
    points = F.aggregate(
        F.col("_blocks"), start, lambda acc, b: step(acc, b, F.col("scores"), F.col("_first")), lambda acc: acc["points"])
    started = _started_chunks(matches, initial, opponent, k, chunk).select(
        "player", "chunk", "scores", "start", first.alias("_first"), blocks.alias("_blocks"))
    return (
        started.where(F.col("_blocks").isNotNull())
        .select("player", "chunk", "_first", F.posexplode(points).alias("_at", "elo"))
        .select("player", (F.col("chunk") * chunk + F.col("_first") + F.col("_at") * every).alias("games"), "elo")
    )
