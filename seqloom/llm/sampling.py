"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_positive: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """_id, _label and _text of at most max_rows labelled rows that may be learned from, in the order of a hash of their
    id; of label 1 at most max_positive. The chosen ids, max_rows at most, are broadcast; of rows with equal ids, the text
    with the least hash is taken, so that no more than one text an id leaves its partition."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where(f"_id IS NOT NULL AND _label IN (0, 1)").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    if max_positive is None:
        chosen = known.orderBy(*order).limit(max_rows)
    else:
        chosen = known.where("_label = 1").orderBy(*order).limit(max_positive).unionByName(known.where("_label = 0").orderBy(*order).limit(max_rows - max_positive))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_label").alias("_label"), F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text"))
