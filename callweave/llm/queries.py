"""The operators as queries over a folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import filter_audit, language_id, license_scans, quality_gam, ranked_search, secret_scans
from callweave.llm.common import documents
from callweave.llm.image_copies import find_copies, images_of
from callweave.llm.line_dedup import dedup_lines
from callweave.llm.mixing import mix
from callweave.llm.quality_rules import apply_rules, train
from callweave.llm.sentence_pieces import digests
from callweave.llm.simhash_dedup import near_duplicates
from callweave.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return apply_rules(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scans.as_text(F.col("base_spans")), 256).alias("base_sha256"), secret_scans.as_text(F.col("spans")).alias("spans"))


ORACLES["op7_secret_scans"] = secret_scans.oracle()


@query
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(documents(spark, sf_dir))


ORACLES["op5_license_scans"] = license_scans.oracle()


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "n_tokens", "weight", "epoch", "block_key")


@query
def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(images_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op13_filter_audit"] = filter_audit.ORACLE


@query
def op11_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_gam.score(docs, quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_ranked_search"] = ranked_search.ORACLE
