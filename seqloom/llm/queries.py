"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, minhash, mixing, quality_classifier, quality_rules, simhash, toxicity, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages"), "page_id", "url", url_filter.RULES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the licenses in each document, in order, and the number of matches."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", names.alias("licenses"), F.size("matches").cast("long").alias("n_matches"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's block tables: how many other fingerprints each document's has within 3 bits."""
    return simhash.near_documents(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_verdicts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_mix_sources, op3_warc, op4_url_filter, op5_license_scan, op6_quality_classifier, op7_fingerprints, op8_near_dedup, op9_toxicity, op10_quality_rules, fingerprint_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op5_license_scan": licenses.ORACLE_SQL, "op8_near_dedup": minhash.ORACLE_SQL, "op4_url_filter": url_filter.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL}
