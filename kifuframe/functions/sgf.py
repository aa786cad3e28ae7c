"""SGF text as column expressions; no Python runs per record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kifuframe.functions.arrays import let

# Fixed values.
DEFAULT_BOARD_SIZE = 19
DEFAULT_KOMI = 6.5
FIRST_VALUE_KEYS = ["AB", "AW", "B", "W"]  # repeated keys that keep only the first value
PROPERTY_PATTERN = r"([A-Z]{1,2})\[([^\n]*?)\]"
MOVE_PATTERN = r"([BW])\[([a-s]{2})\]"
STRICT_MOVE_PATTERN = r"(?<![A-Z])([BW])\[([a-s]{2})\]"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)\s*$"

MOVE_ARRAY = "array<struct<color:string,row:int,col:int>>"


def _balanced(depth: int) -> str:
    """Regex of text whose brackets nest up to ``depth`` levels and all close.

    Unrolled and possessive, so it neither recurses nor backtracks.
    """
    inner = r"[^\[\]]*+"
    for _ in range(depth):
        inner = rf"[^\[\]]*+(?:\[{inner}\][^\[\]]*+)*+"
    return inner


def strip_comments(text: Column, depth: int = 8) -> Column:
    """Drop ``C[...]``; brackets nest, an unclosed comment swallows the rest.

    One regex handles closed comments nested up to ``depth``, nearly all texts. Where
    ``C[`` is left afterwards, a second one also takes unclosed comments, unless some
    bracket nests deeper: then brackets are counted token by token. The later branches
    are lazy, so other texts do not pay for them.
    """
    inner = _balanced(depth)
    closed, any_comment = rf"C\[{inner}\]", rf"C\[(?:{inner}\]|[\s\S]*\z)"
    shallow = F.regexp_replace(text, rf"\[{inner}\]", "")
    return let(
        F.regexp_replace(text, closed, ""),
        lambda quick: F.when(~F.contains(quick, F.lit("C[")), quick)
        .when(~shallow.rlike(r"\[[^\]]*\]"), F.regexp_replace(text, any_comment, ""))
        .otherwise(_count_brackets(text)),
    )


def _count_brackets(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)C\[|\[|\]|[^\[\]C]++|C"), F.lit(0))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("depth"))

    def step(acc: Column, token: Column) -> Column:
        outside = acc["depth"] == 0
        opens = token.isin("C[", "[")
        depth = (
            F.when(outside, F.when(token == "C[", 1).otherwise(0))
            .when(opens, acc["depth"] + 1)
            .when(token == "]", acc["depth"] - 1)
            .otherwise(acc["depth"])
        )
        kept = F.when(outside & (token != "C["), F.concat(acc["kept"], token)).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), depth.alias("depth"))

    return F.aggregate(tokens, start, step, lambda acc: acc["kept"])


def extract_properties(stripped: Column) -> Column:
    """``KEY[value]`` pairs as a map; repeated keys are joined by ``|``."""
    def split(entry: Column) -> Column:
        at = F.instr(entry, "[")
        return F.struct(
            F.substr(entry, F.lit(1), at - 1).alias("k"),
            F.substr(entry, at + 1, F.length(entry) - at - 1).alias("v"),
        )

    def relevant(entries: Column) -> Column:
        # of the many moves only the first of each colour counts
        black = F.filter(entries, lambda e: F.startswith(e, F.lit("B[")))
        white = F.filter(entries, lambda e: F.startswith(e, F.lit("W[")))
        other = F.filter(entries, lambda e: ~F.startswith(e, F.lit("B[")) & ~F.startswith(e, F.lit("W[")))
        return F.concat(other, F.slice(black, 1, 1), F.slice(white, 1, 1))

    pairs = F.transform(
        let(F.regexp_extract_all(stripped, F.lit(PROPERTY_PATTERN), F.lit(0)), relevant), split)

    def merged(found: Column, key: Column) -> Column:
        mine = F.transform(F.filter(found, lambda p: p["k"] == key), lambda p: p["v"])
        return F.when(key.isin(FIRST_VALUE_KEYS), F.get(mine, F.lit(0))).otherwise(
            F.array_join(mine, "|")
        )

    return let(
        pairs,
        lambda found: let(
            F.array_distinct(F.transform(found, lambda p: p["k"])),
            lambda names: F.map_from_arrays(names, F.transform(names, lambda k: merged(found, k))),
        ),
    )


def decode_coord(coord: Column) -> Column:
    """Two letters to ``struct<row,col>``: the first letter is the column."""
    base = F.lit(97)
    return F.struct(
        (F.ascii(F.substring(coord, 2, 1)) - base).alias("row"),
        (F.ascii(F.substring(coord, 1, 1)) - base).alias("col"),
    )


def move_array(stripped: Column, strict: bool = False) -> Column:
    """All moves of a record in order, variations flattened."""
    pattern = F.lit(STRICT_MOVE_PATTERN if strict else MOVE_PATTERN)

    def move(entry: Column) -> Column:
        at = decode_coord(F.substring(entry, 3, 2))
        return F.struct(
            F.substring(entry, 1, 1).alias("color"), at["row"].alias("row"), at["col"].alias("col"))

    return F.transform(F.regexp_extract_all(stripped, pattern, F.lit(0)), move)


def parse_board_size(value: Column) -> Column:
    """Whole number or the default."""
    number = F.when(value.rlike(INTEGER_PATTERN), F.trim(value).try_cast("int"))
    return F.coalesce(number, F.lit(DEFAULT_BOARD_SIZE))


def parse_komi(value: Column) -> Column:
    """Number or the default; the pattern keeps out forms only Java reads (``6.5d``)."""
    number = F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))
    return F.coalesce(number, F.lit(DEFAULT_KOMI))


def parse_result(result: Column) -> Column:
    """Result text to 1 (black), -1 (white) or 0 (drawn or unknown)."""
    text = F.upper(F.trim(F.coalesce(result, F.lit(""))))
    score = F.regexp_replace(text, "[^0-9.]", "").try_cast("double")
    by_score = F.when(score > 0, 1).when(score <= 0, -1)
    return (
        F.when(text.contains("B+") | text.contains("BLACK"), 1)
        .when(text.contains("W+") | text.contains("WHITE"), -1)
        .when(text.contains("DRAW") | text.contains("JIGO"), 0)
        .when(text.contains("B"), F.coalesce(by_score, F.lit(0)))
        .when(text.contains("W"), F.coalesce(-by_score, F.lit(0)))
        .otherwise(0)
        .cast("int")
    )
