import random
import re

import pytest
from pyspark.sql import functions as F

from kifuframe.functions import sgf
from kifuframe.operators import records
from kifuframe.sources.records import decode_text

GOLDEN = "(;FF[4]SZ[19]RE[B+2.5]PB[Black]PW[White]KM[6.5];B[pd];W[dp];B[pp])"


def texts(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "game_id string, text string")


def cut_comments(text):
    kept, depth, at = [], 0, 0
    while at < len(text):
        if depth == 0 and text.startswith("C[", at):
            depth, at = 1, at + 2
            continue
        if depth:
            depth += {"[": 1, "]": -1}.get(text[at], 0)
        else:
            kept.append(text[at])
        at += 1
    return "".join(kept)


def test_golden_record(spark):
    game = records.parse_games(texts(spark, [GOLDEN])).first()
    assert (game.board_size, game.result, game.black_player, game.white_player, game.komi, game.outcome) == (
        19, "B+2.5", "Black", "White", 6.5, 1)
    assert [(m.color, m.row, m.col) for m in game.moves] == [("B", 3, 15), ("W", 15, 3), ("B", 15, 15)]
    assert game.properties["FF"] == "4"


def test_strip_comments_equals_bracket_count(spark):
    rng = random.Random(3)
    pieces = ["C[", "[", "]", "PC[", "x", "B[dd]", ";", "C", "\n", "\\]"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    deep = "C[" + "[" * 12 + "a" + "]" * 12 + "]B[aa]"
    rng2 = random.Random(4)
    made += ["".join(rng2.choice("[[[]]]C") for _ in range(60)) for _ in range(500)]
    made += ["C[x][" + "[" * d + "]" * d + "C[" + "[" * e + "]" * e for d in range(7, 12) for e in range(6, 12)]
    made += ["(;SZ[9]C[cut off" + ";B[aa];W[bb]" * 5_000, deep, "x" + deep + deep, "C[never closed B[aa]", "CC[a][x]", "", "C[" + "y" * 200_000 + "]B[cc]"]
    rows = texts(spark, made).select("game_id", sgf.strip_comments(F.col("text")).alias("body")).collect()
    for row in rows:
        assert row.body == cut_comments(made[int(row.game_id)])


def test_properties_merge_repeated_keys(spark):
    text = "(;GM[1]KM[6.5]KM[0.5]AB[aa]AB[bb];B[cc];B[dd];W[ee]N[a]N[b]N[]XYZ[q])"
    body = texts(spark, [text]).select(sgf.extract_properties(F.col("text")).alias("p")).first().p
    want = {}
    for key, value in re.findall(r"([A-Z]{1,2})\[(.*?)\]", text):
        if key not in want:
            want[key] = value
        elif key not in ("AB", "AW", "B", "W"):
            want[key] += "|" + value
    assert body == want


@pytest.mark.parametrize("size, expected", [("9", 9), (" 13 ", 13), ("+7", 7), ("9.5", 19), ("x", 19), ("", 19), ("9|9", 19)])
def test_board_size_default(spark, size, expected):
    assert records.parse_games(texts(spark, [f"(;SZ[{size}])"])).first().board_size == expected


@pytest.mark.parametrize("komi, expected", [
    ("7.5", 7.5), ("0", 0.0), ("-5.5", -5.5), (".5", 0.5), ("7.", 7.0), ("1e1", 10.0), ("6.5d", 6.5), ("5f", 6.5),
    ("abc", 6.5), ("6.5|0.5", 6.5)])
def test_komi_default(spark, komi, expected):
    assert records.parse_games(texts(spark, [f"(;KM[{komi}])"])).first().komi == expected


def test_missing_header(spark):
    game = records.parse_games(texts(spark, ["no record at all"])).first()
    assert (game.board_size, game.result, game.black_player, game.game_date, game.komi, game.outcome) == (
        19, "", "", "", 6.5, 0)
    assert game.moves == []


def test_parse_result(spark):
    cases = {
        "B+2.5": 1, "W+R": -1, "b+resign": 1, "White wins": -1, "BLACK": 1, "Draw": 0, "jigo": 0, "": 0, "?": 0,
        "B+2.5|W+R": 1, "W+1|B+2": 1, "B 3": 1, "B 0": -1, "W 0": 1, "W 2": -1, "0": 0, "12": 0, "B": 0, "W1.2.3": 0,
        " B+ ": 1, "VOID": 0}
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", sgf.parse_result(F.col("r")).alias("o"))
    assert {row.r: row.o for row in df.collect()} == cases


def test_moves_flatten_variations_and_setup(spark):
    text = "(;AB[ee]PB[ab];B[aa](;W[bb];B[])(;W[tt];W[ccc];B[sa]))"
    game = records.parse_games(texts(spark, [text])).first()
    assert [(m.color, m.row, m.col) for m in game.moves] == [
        ("B", 4, 4), ("B", 1, 0), ("B", 0, 0), ("W", 1, 1), ("B", 0, 18)]
    strict = records.parse_games(texts(spark, [text]), strict=True).first()
    assert [(m.row, m.col) for m in strict.moves] == [(0, 0), (1, 1), (0, 18)]


def test_size_filter_and_sequence(spark):
    games = records.parse_games(texts(spark, ["(;SZ[9];B[aa];W[bb])", "(;SZ[13];B[aa])"]), board_size=9)
    moves = records.extract_moves(games)
    assert moves.count() == 2
    for segment in (1, 1_024):
        sequence = records.move_sequence(moves, segment).collect()
        assert [[(p.row, p.col) for p in r.positions] for r in sequence] == [[(0, 0), (1, 1)]]


def test_long_game_is_one_row(spark):
    moves = spark.range(1_500).selectExpr("7L AS game_id", "id AS ply", "cast(id % 9 AS int) AS row", "cast(id % 5 AS int) AS col")
    sequence = records.move_sequence(moves.repartition(5), segment=100).collect()
    assert len(sequence) == 1 and [(p.row, p.col) for p in sequence[0].positions] == [(i % 9, i % 5) for i in range(1_500)]


def test_decode_text_drops_bad_bytes(spark):
    raws = [b"ok\r\nB\rC\n", b"\xffa\xe2\x28\xa1b\xed\xa0\x80c\xf0\x9f\x98", "kept �".encode(), "棋".encode() + b"\x80\xef\xbf\xbd"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw binary")
    got = {r.i: r.t for r in df.select("i", decode_text(F.col("raw")).alias("t")).collect()}
    for i, raw in enumerate(raws):
        assert got[i] == re.sub("\r\n?", "\n", raw.decode("utf-8", errors="ignore"))
