"""Codon usage, as tables and as rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna


def genetic_code(spark) -> DataFrame:
    """codon, aa, is_stop: 64 rows."""
    return spark.createDataFrame([(c, a, a == "*") for c, a in dna.GENETIC_CODE.items()], "codon string, aa string, is_stop boolean")


def back_translation_table(code: DataFrame) -> DataFrame:
    """aa and its codons."""
    return code.groupBy("aa").agg(F.sort_array(F.collect_list("codon")).alias("codons"))


def usage_table(sequences: DataFrame, q: str = "q") -> DataFrame:
    """aa, codon, n and its share within the amino acid, for all 64 codons. Counts are summed before the shuffle."""
    counts = sequences.select(F.explode(dna.codons(F.col(q))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    rows = genetic_code(sequences.sparkSession).join(counts, "codon", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("aa"))
    return rows.select("aa", "codon", "n", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def usage_dict(table: DataFrame) -> dict[str, float]:
    return {r["codon"]: r["share"] for r in table.select("codon", "share").orderBy("codon").collect()}


def rare_codons(table: DataFrame, below: float) -> DataFrame:
    return table.where(F.col("share") < below)


def best_codons(q: Column, usage: dict[str, float]) -> Column:
    """The sequence with each codon replaced by its amino acid's most frequent one (of equal ones, the last)."""
    best = {c: max(dna.synonyms(a), key=lambda x: (usage.get(x, 0.0), x)) for c, a in dna.GENETIC_CODE.items()}
    return F.array_join(F.transform(dna.codons(q), lambda c: F.element_at(dna.mapping(best), c)), "")
