"""Operators on records with features, and on tables of enzymes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .intervals import segments
from .patterns import Pattern, pattern

FEATURES = "array<struct<type:string,start:int,end:int,strand:int,qualifiers:map<string,array<string>>>>"


def feature(start: Column, end: Column, strand: Column | int = 1, kind: str = "misc_feature", **qualifiers: Column | str) -> Column:
    pairs = [x for k, v in qualifiers.items() for x in (F.lit(k), F.array(v if isinstance(v, Column) else F.lit(v)))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
    return F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), (strand if isinstance(strand, Column) else F.lit(strand)).cast("int").alias("strand"), made.alias("qualifiers"))


def annotated(records: DataFrame, start: int | None = None, end: int | None = None, margin: int = 0, strand: int = 1, kind: str = "misc_feature", **qualifiers: str) -> DataFrame:
    """A feature more in each record: at a place, or without one over all but a margin at both ends."""
    a = F.lit(margin if start is None else start)
    b = F.length("q") - margin if end is None else F.lit(end)
    return records.withColumn("features", F.concat("features", F.array(feature(a, b, strand, kind, **qualifiers)).cast(FEATURES)))


def with_sequence(records: DataFrame, q: Column) -> DataFrame:
    """Other sequences, the features kept."""
    return records.withColumn("q", q)


def annotated_differences(records: DataFrame, reference: str, kind: str = "misc_feature", prefix: str = "#") -> DataFrame:
    """A feature for each run of bases that differ from a column of references, labelled with the prefix and the old bases."""
    found = segments(dna.differences(F.col("q"), F.col(reference)))
    added = F.transform(found, lambda x: feature(x["start"], x["end"], 1, kind, label=F.concat(F.lit(prefix), dna.part(F.col(reference), x["start"], x["end"]))))
    return records.withColumn("features", F.concat("features", added.cast(FEATURES)))


def annotated_occurrences(records: DataFrame, what: str | Pattern, kind: str = "misc_feature") -> DataFrame:
    """A feature for each match on the + strand."""
    p = pattern(what)
    added = F.transform(p.locations(F.col("q"), 1), lambda x: feature(x["start"], x["end"], 1, kind, label=p.name))
    return records.withColumn("features", F.concat("features", added.cast(FEATURES)))


def select_enzymes(table: DataFrame, lengths: Sequence[int] | None = None, temperatures: Sequence[float] | None = None, min_suppliers: int = 0, unlike: Sequence[str] = ()) -> DataFrame:
    """Enzymes (name, site, variants, opt_temp, suppliers) by the site's length, the best temperature and the number of
    suppliers, without those that share a variant of their site with the enzymes in `unlike`."""
    out = table
    if lengths is not None:
        out = out.where(F.length("site").isin(*lengths))
    if temperatures is not None:
        out = out.where(F.col("opt_temp").isin(*temperatures))
    if min_suppliers:
        out = out.where(F.size("suppliers") >= min_suppliers)
    if unlike:
        shared = table.where(F.col("name").isin(*unlike)).select(F.explode("variants").alias("variant"))
        alike = out.select("name", F.explode("variants").alias("variant")).join(shared, "variant", "left_semi").select("name").distinct()
        out = out.join(alike, "name", "left_anti")
    return out
