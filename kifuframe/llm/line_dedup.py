"""Line dedup: lines that many documents hold stay in one of them only.

Only DataFrame functions: normalise and hash the lines of each document, count the documents per
hash, mark the lines of frequent hashes and reassemble the rest by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifuframe.llm.common import BLANKS, LOWER, UPPER, fresh


def lines_of(text: Column) -> Column:
    """Lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lowered."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> list[Column]:
    """128 bits, as two hashes with seeds of their own."""
    return [F.xxhash64(F.lit(1), key).alias("h"), F.xxhash64(F.lit(2), key).alias("g")]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the text rewritten, and ``n_lines`` (before), ``n_dropped``.

    Line keys of ``min_chars`` code points or more found under ``min_docs`` different ``doc_id`` or more lose all
    their lines, except in the rows with the largest ``doc_id`` that holds them.

    * A null text counts as empty and becomes an empty text; a key repeated in one row counts once.
    * Rows of an equal ``doc_id`` are one document: they count once, and all keep the key if theirs is the largest. Null ids are
      one document too, which is never the largest, unless no other row holds the key.
    * An empty table gives an empty table. Input columns called ``n_lines`` or ``n_dropped``, in any case, are replaced.

    Work: the pairs of line hash and id are made distinct, so that no hash is a hot key, then counted, and the frequent hashes
    joined back as narrow rows (a frequent line is a skewed side that Spark splits); the texts move once, by document.
    """
    body, hashes, one, mark, th, tg = fresh(docs, "body", "hashes", "one", "mark", "th", "tg")
    keyed = F.filter(
        F.transform(lines_of(F.col(text)), lambda line, at: F.struct(at.alias("at"), line_key(line).alias("key"))),
        lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(keyed, lambda x: F.struct(x["at"].alias("at"), *_hash(x["key"])))
    same_text = _hash(F.coalesce(F.col(text), F.lit("")))
    long_lines = docs.select(
        F.col(doc_id).alias("id"), same_text[0].alias("th"), same_text[1].alias("tg"), hashed.alias("hashes"))
    frequent = (
        long_lines.select("id", F.explode(F.array_distinct(F.transform(
            "hashes", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))).alias("k"))
        .select("id", F.col("k.h").alias("fh"), F.col("k.g").alias("fg")).distinct().groupBy("fh", "fg")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        .where(F.col("n") >= min_docs)
        .repartition("top"))  # an exchange of its own below the join, so that Spark can split a frequent line
    dropped = (
        long_lines.select("id", "th", "tg", F.explode("hashes").alias("x"))
        .select("id", "th", "tg", F.col("x.at").alias("at"), F.col("x.h").alias("h"), F.col("x.g").alias("g"))
        .join(frequent, (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")))
        .where(~F.col("id").eqNullSafe(F.col("top")))
        .groupBy("id", "th", "tg").agg(F.collect_set("at").alias("drop"))
        .select(F.col("id").alias(mark), F.col("th").alias(f"{mark}h"), F.col("tg").alias(f"{mark}g"), F.col("drop").alias(one)))
    lines = lines_of(F.col(text))
    placed = docs.withColumns({th: same_text[0], tg: same_text[1]}).join(
        dropped,
        F.col(doc_id).eqNullSafe(F.col(mark)) & (F.col(th) == F.col(f"{mark}h")) & (F.col(tg) == F.col(f"{mark}g")),
        "left")
    kept = F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(body) - 1), F.col(one)), lambda i: F.get(F.col(body), i)), "\n")
    counts = {
        "n_lines": F.size(body).cast("bigint"),
        "n_dropped": F.coalesce(F.size(F.col(one)), F.lit(0)).cast("bigint"),
        text: F.when(F.col(one).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept),
    }
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    staged = placed.withColumn(body, lines)
    return staged.select(
        *[counts[c].alias(c) if c == text else F.col(c) for c in names],
        counts["n_lines"].alias("n_lines"), counts["n_dropped"].alias("n_dropped"))
