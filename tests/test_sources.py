import io
import tarfile

import pytest

from kifuframe.sources import records as sources
from kifuframe.sources.files import arrow_uri

SGF = "(;SZ[{}]RE[B+1];B[aa];W[bb])"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    (base / "deep" / "er").mkdir(parents=True)
    for name, size in [("a.sgf", 9), ("deep/b.SGF", 9), ("deep/er/c.Sgf", 19), ("note.txt", 9), ("deep/d.sgf", 9)]:
        (base / name).write_text(SGF.format(size))
    (base / "bad.sgf").write_bytes(b"(;SZ[9]PB[\xff\xfeabc];B[aa])")
    return str(base)


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    base = tmp_path_factory.mktemp("archives")
    (base / "sub").mkdir()

    def pack(path, members):
        with tarfile.open(path, "w:gz") as tar:
            for name, text in members:
                data = text.encode()
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))

    pack(base / "one.tgz", [("x/1.sgf", SGF.format(9)), ("x/2.SGF", SGF.format(19)), ("x/readme.md", "no")])
    pack(base / "sub" / "two.tar.gz", [(f"{i}.sgf", SGF.format(9)) for i in range(2500)])
    pack(base / "skip.tar", [("z.sgf", SGF.format(9))])
    return str(base)


def test_directory(spark, folder):
    assert sources.read_game_dir(spark, folder).count() == 5
    nine = sources.read_game_dir(spark, folder, board_size=9)
    assert sorted(r.source.rsplit("/", 1)[1] for r in nine.collect()) == ["a.sgf", "b.SGF", "bad.sgf", "d.sgf"]
    assert nine.where("source like '%bad.sgf'").first().black_player == "abc"


def test_limit_is_by_path_after_the_size_filter(spark, folder):
    games = sources.read_game_dir(spark, folder, board_size=9, max_games=3)
    assert sorted(r.source.rsplit("/", 1)[1] for r in games.collect()) == ["a.sgf", "b.SGF", "bad.sgf"]


def test_missing_paths_are_empty(spark):
    assert sources.read_game_dir(spark, "/nowhere/at/all").count() == 0
    assert sources.read_game_archives(spark, "/nowhere/at/all").count() == 0


def test_single_file(spark, folder):
    assert sources.read_game_file(spark, f"{folder}/a.sgf", 9).count() == 1
    assert sources.read_game_file(spark, f"{folder}/a.sgf", 19).count() == 0


def test_archives(spark, archives):
    assert sources.read_game_archive(spark, f"{archives}/one.tgz", 9).count() == 1
    games = sources.read_game_archives(spark, archives, board_size=9)
    assert games.count() == 2501
    assert sources.read_game_archives(spark, archives, 9, max_games=7).count() == 7
    assert len(games.where("member = 'x/1.sgf'").first().moves) == 2


def test_odd_names_and_repeated_members(spark, tmp_path):
    base = tmp_path / "a b#c %41"
    base.mkdir()
    with tarfile.open(base / "x y#z %20.tgz", "w:gz") as tar:
        for i in range(3):
            data = SGF.format(9 + i).encode()
            info = tarfile.TarInfo("same.sgf")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert sources.read_game_archives(spark, str(tmp_path)).count() == 3
    first = sources.read_game_archives(spark, str(tmp_path), max_games=1).collect()
    assert [r.board_size for r in first] == [9]


@pytest.mark.parametrize("path, uri", [
    ("s3a://bucket/a b#1.tgz", "s3://bucket/a%20b%231.tgz"), ("file:/x/%41", "file:///x/%2541"), ("/x y", "file:///x%20y"),
    ("hdfs://host:9000/a", "hdfs://host:9000/a")])
def test_paths_as_uris(path, uri):
    assert arrow_uri(path) == uri


def test_size_filter_is_below_the_move_parse(spark, folder):
    plan = sources.read_game_dir(spark, folder, board_size=9)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    moves_at = next(i for i, line in enumerate(lines) if "[BW]" in line)
    filter_at = next(i for i, line in enumerate(lines) if "Filter" in line and "9" in line)
    assert moves_at < filter_at


def test_write_and_read_games(spark, folder, tmp_path):
    games = sources.read_game_dir(spark, folder).select("game_id", "board_size", "outcome", "moves")
    sources.write_games(games, str(tmp_path / "games"))
    back = sources.read_games(spark, str(tmp_path / "games"))
    assert sorted(map(str, back.select(*games.columns).collect())) == sorted(map(str, games.collect()))
    plan = back.where("board_size = 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(board_size" in plan


@pytest.mark.parametrize("few", [1, 1_000])
def test_limit_by_a_cut(spark, few):
    rows = [(f"s{i % 7}", f"m{i % 3}" if i % 4 else None, i // 21, f"body {i}") for i in range(120)] + [("s3", "m1", 0, "again")] * 5
    table = spark.createDataFrame(rows, "source string, member string, place bigint, text string").repartition(4)
    order = sorted(((r[0], r[1] is not None, r[1] or "", r[2]) for r in rows))
    for n in (0, 2, 50, 63, 124, 125, 400):
        got = sorted((r.source, r.member is not None, r.member or "", r.place) for r in sources.limit_games(table, n, few).collect())
        assert got == (order[:n] if n else order), n
