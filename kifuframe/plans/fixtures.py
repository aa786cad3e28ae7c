"""Game tables derived from the event, order, part, line-item and embedding tables.

The registered queries and the tests read these, so their work grows with the given
tables. Users of the library bring their own records.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.functions.arrays import int_div
from kifuframe.operators.ordering import number_rows
from kifuframe.session import scratch_path

N = 9
LOGIT_N = 8
TREE_ARITY = 5
RESULTS = ["B+2.5", "W+R", "Draw", "", "b+resign", "White wins", "Jigo", "B 3", "W 0", "B 0", "?", "0"]
SEED = 7


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Derive a table once per session and folder; later uses read what was written."""
    @wraps(fn)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _STORED:
            path = scratch_path(spark, f"derived/{fn.__name__}")
            fn(spark, sf_dir).write.parquet(path)
            _STORED[key] = path
        return spark.read.parquet(_STORED[key])

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@stored_once
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in time order as the moves of one game on a 9 x 9 board."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("game_id"), "ts", "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    numbered = number_rows(events, "game_id", ["ts", "event_id"], "at")
    ply = F.col("at").cast("bigint")
    return numbered.select(
        "game_id", ply.alias("ply"), "k", int_div(F.col("k"), N).alias("row"),
        (F.col("k") % N).alias("col"), F.when(ply % 2 == 0, "B").otherwise("W").alias("color"))


def _result(game_id: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in RESULTS]), (game_id % len(RESULTS)).cast("int"))


@stored_once
def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header row per game."""
    from kifuframe.functions.sgf import parse_result

    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id")).distinct()
    return _headers(ids).withColumn("outcome", parse_result(F.col("result")))


def _headers(ids: DataFrame) -> DataFrame:
    g = F.col("game_id")
    return ids.select(
        *ids.columns,
        F.when(g % 10 == 0, 19).otherwise(9).alias("board_size"),
        _result(g).alias("result"),
        F.concat(F.lit("P"), g % 7).alias("black_player"),
        F.concat(F.lit("P"), g % 5).alias("white_player"),
        F.concat(F.lit("2024-01-"), F.lpad((g % 28 + 1).cast("string"), 2, "0")).alias("game_date"),
        F.when(g % 2 == 0, 6.5).otherwise(7.5).alias("komi"),
    )


@stored_once
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games as SGF text: ``game_id, part, text``; a game is one record, its part 0, however long."""
    letter = lambda c: F.char(F.lit(97) + c)
    move = F.concat(F.lit(";"), F.col("color"), F.lit("["), letter(F.col("col")), letter(F.col("row")), F.lit("]"))
    parts = (
        moves(spark, sf_dir)
        .select("game_id", F.lit(0).alias("part"), "ply", move.alias("move"))
        .groupBy("game_id", "part")
        .agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("ply", "move"))), lambda m: m["move"]), "").alias("body"))
    )
    g = F.col("game_id")

    def only(step: int, text: str) -> Column:
        return F.when(g % step == 0, text).otherwise("")

    def prop(key: str, name: str) -> Column:
        return F.concat(F.lit(f"{key}["), F.col(name).cast("string"), F.lit("]"))

    text = F.concat(
        F.lit("(;FF[4]"), prop("SZ", "board_size"), prop("RE", "result"), prop("PB", "black_player"),
        prop("PW", "white_player"), prop("DT", "game_date"), prop("KM", "komi"),
        only(7, "KM[0.5]"), only(9, "PC[Tokyo]"), only(6, "AB[ee]"), only(5, "C[x [n] y]"),
        F.col("body"), only(4, ";W[tt]"), F.lit(")"))
    return _headers(parts).select("game_id", "part", text.alias("text"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on an 8 x 8 board from the embeddings."""
    vec = F.col("vec_id")
    values = F.col("embedding").cast("array<double>")
    size = LOGIT_N * LOGIT_N
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("position_id"),
        values.alias("logits"),
        F.reverse(values).alias("fast_logits"),
        F.tanh(3 * F.get(values, F.lit(0))).alias("value"),
        F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (vec * 31 + i * 7) % 5 != 0).alias("legal"),
        F.col("label").alias("target_action"),
        (F.col("label") % 3 - 1).cast("double").alias("target_value"),
        F.call_function("div", vec, F.lit(64)).alias("batch"),
        (vec % 2).alias("epoch"),
        (F.lit(1.0) / (F.col("label") + 1)).alias("weight"),
    )


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay table: one row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type",
        (F.col("value") / 100 + 1e-6).alias("priority"))


def td_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TD errors of the rows a training step has visited."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "click").select(
        F.col("event_id").alias("seq"), (F.col("value") / 50).alias("td_error"))


@stored_once
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in date order as the games of one player."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("player"), "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")
    numbered = number_rows(orders, "player", ["o_orderdate", "o_orderkey"], "at")
    outcome = (
        F.when(F.col("o_orderpriority").startswith("1-"), None)
        .when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0))
    return numbered.select(
        "player", F.col("at").cast("bigint").alias("game_idx"), (F.col("at") % 2 == 0).alias("plays_black"),
        outcome.cast("int").alias("outcome"), "o_orderkey")


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black, white and outcome of each order taken as one game."""
    outcome = (
        F.when(F.col("o_orderpriority").startswith("1-"), None)
        .when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("black"), (F.col("o_orderkey") % 50).alias("white"),
        outcome.cast("int").alias("outcome"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"), (F.col("l_quantity") / 1000).alias("seconds"))


def tree_level_starts() -> list[int]:
    """First node id of each level of the complete tree, as far as a bigint goes."""
    starts, first, width = [], 0, 1
    while first < 1 << 63:
        starts.append(first)
        first += width
        width *= TREE_ARITY
    return starts


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as the nodes of one complete 5-ary tree."""
    node = F.col("p_partkey")
    level = sum((F.when(node >= first, 1).otherwise(0) for first in tree_level_starts()[1:]), F.lit(0))
    return table(spark, sf_dir, "part").select(
        node.alias("node"),
        F.when(node > 0, F.call_function("div", node - 1, F.lit(TREE_ARITY))).alias("parent"),
        level.alias("level"),
        ((F.col("p_size") - 25) / 25.0).alias("reward"),
        (F.col("p_retailprice") % 100 / 100).alias("leaf_value"),
    )
