"""Tables of sequences from tables of the data set, which holds no DNA itself."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, HEX_BASES = "0123456789abcdef", "ACGT" * 4
LETTERS = "".join(u + l for u, l in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True))
LETTER_BASES = "".join(2 * "ACGT"[i % 4] for i in range(26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest_dna(key: Column, salts: str) -> Column:
    """32 bases for each salt, from the digits of an md5 digest."""
    return F.translate(F.concat(*[F.md5(F.concat(F.lit(s), key.cast("string")).cast("binary")) for s in salts]), HEX, HEX_BASES)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Narrow rows over as many tasks as a shuffle has, ahead of work that needs many; a small table is one task's otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def digest_sequences(spark: SparkSession, sf_dir: str, salts: str = "ab", source: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """seq_id and q of each row of a table. The ids are dealt out before the sequences are made."""
    keys = dealt(table(spark, sf_dir, source).select(F.col(key).alias("seq_id")), "seq_id")
    return keys.select("seq_id", digest_dna(F.col("seq_id"), salts).alias("q"))


def text_dna(text: Column) -> Column:
    """The letters A to Z, in either case, as bases in turn; all else is left out."""
    return F.regexp_replace(F.translate(text, LETTERS, LETTER_BASES), "[^ACGT]", "")


def document_sequences(spark: SparkSession, sf_dir: str, source: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, source).select(F.col(key).alias("seq_id"), text_dna(F.col("text")).alias("q"))


def records(rows: DataFrame, key: str = "seq_id", sequence: str = "q") -> DataFrame:
    """Rows as records (seq_id, q, features), without a feature so far."""
    empty = F.array().cast("array<struct<type:string,start:int,end:int,strand:int,qualifiers:map<string,array<string>>>>")
    return rows.select(F.col(key).alias("seq_id"), F.upper(F.col(sequence)).alias("q"), empty.alias("features"))
