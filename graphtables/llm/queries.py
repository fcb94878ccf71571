"""One query per operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, oracles


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(common.read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(common.read(spark, sf_dir, "embeddings"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(common.read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, digest, find

    found = find(common.only(common.read(spark, sf_dir, "documents"), "doc_id", "text"))

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    named = F.size("named").cast("long")
    more = (named - F.size("base")).cast("long").alias("n_secret"), named.alias("n_named")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), *more)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(-1))
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs.where((fold != 1) & (fold >= 0)), bounded=False)
    return identify(docs.select("doc_id", "text", (fold == 1).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(common.read(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(common.only(common.read(spark, sf_dir, "pages"), "page_id", "html"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(common.read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(common.read(spark, sf_dir, "documents"), words=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_exact_topk": op3_exact_topk,
    "op4_fingerprints": op4_fingerprints,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_html_extraction": op8_html_extraction,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_near_duplicates": op10_near_duplicates,
}

#: The others learn, sketch, tokenize or pack; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": oracles.TOP_K,
    "op7_url_filters": oracles.URLS,
    "op10_near_duplicates": oracles.NEAR_DUPLICATES,
}
