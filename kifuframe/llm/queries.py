"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.llm import (
    chat, html_text, jaccard, lexical, line_dedup, packing, pieces, quality, sharding, url_filter, warc, whitening, winnowing)
from kifuframe.llm.common import table
from kifuframe.session import scratch_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, drop_text=True)
    back = pieces.decode(coded, model)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_differing")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "llm/warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    ident = lambda c: F.regexp_extract(c, r"^<urn:record:(-?\d+):", 1)
    number = lambda c: F.when(ident(c) != "", ident(c).cast("bigint"))
    return warc.read_warc(spark, folder, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to_id").alias("refers_to"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = chat.preference_pairs(talks, chat.swapped_answers(talks))
    return pairs.select(
        "conv_id", "prompt_turns", "prompt", chat.text_of(F.col("chosen")).alias("chosen"),
        chat.mask_of(F.col("chosen")).alias("chosen_mask"), chat.text_of(F.col("rejected")).alias("rejected"),
        chat.mask_of(F.col("rejected")).alias("rejected_mask"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), added_tokens=True)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.uniform_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.select(
        "vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error")


#: Verdict, host and path of the query's rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES).drop("url")


REGISTRY = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_sharding": op7_sharding,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_winnowing": op10_winnowing,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
}
