"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents, with the rows that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import byte_bpe, decontaminate, near_copies, quality
from staylens.llm.common import row_key, table, without_rows, write_shared
from staylens.llm.queries import BYTE_RANKS, RULES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. Repeated rows share a verdict; an empty table stays empty."""
    return quality.keep_good(docs, RULES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) the document of the smallest doc_id stays.

    Texts without a word are copies of each other; a null doc_id comes last; of repeated rows one stays; an empty table stays empty.
    """
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go, told apart by doc_id and text. Null and empty texts have none and stay; repeated rows go or stay together."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    found = decontaminate.find_matches(keyed, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    hit = write_shared(found.select(F.col("doc_id").alias("_staylens_hit")).distinct())
    return without_rows(docs, hit, "_staylens_hit").drop("_staylens_row")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and byte ends of each token; a null or empty text has none; repeated rows each give a row."""
    return byte_bpe.encode(docs, BYTE_RANKS)


STAGES = [("quality rules", keep_quality), ("near duplicates", drop_near_copies), ("decontamination", drop_contaminated), ("byte-level BPE", encode)]

#: Tokenisers and fingerprints can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
