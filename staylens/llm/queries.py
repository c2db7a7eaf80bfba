"""One query for each operator, over whole tables; each derives its digest columns from what its operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat, decontaminate, html_extract, mixing, ppm, quality, simhash, token_store, url_filter, warc, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
SIDES = alignment.Sides(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
RULES = quality.Rules(public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_example(table(spark, sf_dir, "conversations"))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), RULES)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "entry string, verdict string"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("lost bytes in"), "file", F.col("start").cast("string"), "gap")).cast("boolean")
    return found.filter(F.when(F.col("gap").isNull(), True).otherwise(lost)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_store.round_trip(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), SIDES)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_byte_bpe, op3_chat, op4_quality, op5_url_filter, op6_warc, op7_token_store, op8_ppm, op9_simhash, op10_html_extract, op11_alignment, op12_mixing, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
