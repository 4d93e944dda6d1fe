"""Table functions for SQL: matches of a pattern as rows, for patterns of one's own too."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.patterns import pattern


@udtf(returnType="start: int, end: int, strand: int")
class FindMatches:
    """find_matches(sequence, pattern, strand): strand 1, -1, or 0 for both. Built-in expressions do the same faster; this
    is the place for patterns that they can't express."""

    def eval(self, sequence: str, text: str, strand: int):
        if sequence is not None and text is not None:
            yield from pattern(text).find(sequence, strand or 0)


def register(spark: SparkSession) -> None:
    spark.udtf.register("find_matches", FindMatches)
