"""From raw documents to tokens: quality rules, quality classifier, near-duplicates, mixing, BPE.

Each stage takes the documents that the one before it kept, written as Parquet and read again. All but the last return
the columns of `documents`, and any others, whatever their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, minhash, mixing, quality_classifier, quality_rules
from seqloom.llm.common import marked, new_path, release, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has no words and goes; a null source is a source of its own; rows that repeat are judged each, and
    so stay or go together; texts of any length are read whole."""
    return quality_rules.kept_rows(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the raw documents, since the stage before has removed many with label 0. A null text is
    scored as an empty one; without labels of both kinds all rows get one score; equal texts get equal scores; a score of
    0.5 stays."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.kept_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8. Of a group the smallest id stays; null and empty texts, and rows without an id, are
    linked with nothing and stay; of rows equal in id and text one stays."""
    return minhash.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice. A null source is a source, the last in order; null and empty texts
    weigh nothing; rows with equal ids, sizes and sources are taken all or none; a row without an id is drawn by its text."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text has no tokens; rows that repeat give repeated results; only the id and the text are read."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", tokens)]

#: The classifier, the network of links and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder goes when the next one is written."""
    docs, begun = table(spark, sf_dir, "documents"), marked()
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        release(spark, begun, keep=path)
    return docs
