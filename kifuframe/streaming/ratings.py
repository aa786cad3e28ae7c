"""Running Elo and tally per player on a stream of matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kifuframe.operators.ratings import ELO_SCALE, K_FACTOR, score_of, side_result

OUTPUT = "elo double, wins bigint, losses bigint, draws bigint, num_games bigint"
#: Players share this many groups: a call of Python per player and micro-batch costs far more than the rating itself.
GROUPS = 4_096


def stream_elo(matches: DataFrame, initial: float = 1000.0, opponent: float = 1000.0,
               k: float = K_FACTOR, first: int = 0) -> DataFrame:
    """One updated row per player and micro-batch.

    A player's games are rated in the order of ``game_idx``, which counts them without gaps from ``first``, however they arrive: a
    game that comes before one of its predecessors waits in the player's state, so files in any order give the rating of the
    batch operator. The figures of a row are those of the games rated so far.

    * A game whose number was rated before, or is null, is rated when it arrives. Games after a gap that never fills are never rated.
    * A group's rows are held for one micro-batch only, so the trigger's file or byte limit bounds them; what waits is held as numbers.
    * A group's players are one state, so the number of groups must stay the same while a checkpoint is used.
    """
    # null players have a group of their own, so that the others keep their type in pandas
    group = F.when(F.col("player").isNull(), -1).otherwise(F.pmod(F.xxhash64("player"), F.lit(GROUPS)).cast("int"))
    slim = matches.select(
        group.alias("_group"), "player", "game_idx", score_of(F.col("outcome"), F.col("plays_black")).alias("score"),
        side_result(F.col("outcome"), F.col("plays_black")).alias("seen"))

    def rate(held: tuple, arrived: list[tuple]) -> tuple:
        elo, wins, losses, draws, games, following, early = held
        waiting = sorted([*map(tuple, early or []), *((following - 1 if i is None else i, x, seen) for i, x, seen in arrived)],
                         key=lambda game: game[0])
        rated = 0
        for idx, score, seen in waiting:
            if idx > following:
                break
            elo += k * (score - 1.0 / (1.0 + 10.0 ** ((opponent - elo) / ELO_SCALE)))
            wins, losses, draws = wins + (seen == 1), losses + (seen == -1), draws + (seen == 0)
            following, rated = max(following, idx + 1), rated + 1
        return elo, wins, losses, draws, games + rated, following, waiting[rated:]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {row[0]: tuple(row)[1:] for row in state.get[0]} if state.exists else {}
        arrived: dict = {}
        for b in batches:
            players = [None] * len(b) if key[0] == -1 else b["player"].tolist()
            for player, i, score, seen in zip(players, b["game_idx"].tolist(), b["score"].tolist(), b["seen"].tolist(), strict=True):
                arrived.setdefault(player, []).append(
                    (None if pd.isna(i) else int(i), score, None if pd.isna(seen) else int(seen)))
        for player, games in arrived.items():
            held[player] = rate(held.get(player, (initial, 0, 0, 0, 0, first, [])), games)
        state.update(([(player, *figures) for player, figures in held.items()],))
        yield pd.DataFrame(
            [(player, *held[player][:5]) for player in arrived], columns=["player", "elo", "wins", "losses", "draws", "num_games"])

    kind = matches.schema["player"].dataType.simpleString()
    each = f"player:{kind},elo:double,wins:bigint,losses:bigint,draws:bigint,num_games:bigint,following:bigint,"
    return slim.groupBy("_group").applyInPandasWithState(
        update, f"player {kind}, {OUTPUT}", f"players array<struct<{each}early:array<struct<idx:bigint,score:double,seen:int>>>>",
        "update", GroupStateTimeout.NoTimeout)
