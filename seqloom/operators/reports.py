"""Reports on sequences before and after a search."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna, parsing
from .intervals import merged, segments
from .specs import AvoidChanges, EnforceTranslation, HarmonizeRCA, Spec


def before_after(rows: DataFrame, specs: dict[str, Spec], before: str = "before", after: str = "after", id_col: str = "seq_id", with_boost: bool = False) -> DataFrame:
    """A row for each specification of each pair: its place, both scores, and the edits in its place, by number and share;
    with_boost adds the boost."""
    parts = []
    for name, s in specs.items():
        a, b = F.col(before), F.col(after)
        start = F.lit(s.place[0]) if s.place else F.lit(0)
        end = F.lit(s.place[1]) if s.place else F.length(a)
        edits = dna.n_differences(dna.part(a, start, end), dna.part(b, start, end))
        fields = [F.lit(name).alias("spec"), start.cast("int").alias("start"), end.cast("int").alias("end"), s.score(a).alias("before"), s.score(b).alias("after"), edits.alias("edits"), (100.0 * edits / (end - start)).alias("edits_percent")]
        parts.append(F.struct(*fields, *([F.lit(float(s.boost)).alias("boost")] if with_boost else [])))
    return rows.select(id_col, F.explode(F.array(*parts)).alias("r")).select(id_col, "r.*")


def edit_features(rows: DataFrame, before: str = "before", after: str = "after", id_col: str = "seq_id") -> DataFrame:
    """A feature for each run of edits, labelled old=>new."""
    x = rows.select(id_col, before, after, F.explode(segments(dna.differences(F.col(before), F.col(after)))).alias("x"))
    cut = lambda c: dna.part(F.col(c), F.col("x.start"), F.col("x.end"))
    return x.select(id_col, F.lit("misc_feature").alias("type"), F.col("x.start"), F.col("x.end"), F.lit(0).alias("strand"), F.concat(cut(before), F.lit("=>"), cut(after)).alias("label"))


def evaluation_features(evaluated: DataFrame, keep: Callable[[Column], Column] | None = None, merge: bool = False) -> DataFrame:
    """A feature for each place of each evaluation, or each merged place, that a filter keeps, coloured by success."""
    colour = F.when(F.col("is_optimal"), "#7fbf5f").when(F.col("passes"), "#bfbf5f").otherwise("#bf7f5f")
    places = merged(F.col("locations")) if merge else F.col("locations")
    places = F.filter(places, lambda x: keep(x)) if keep else places
    return evaluated.select("seq_id", "spec", "role", F.explode(places).alias("x"), colour.alias("color")).select("seq_id", F.lit("misc_feature").alias("type"), F.col("x.start"), F.col("x.end"), F.col("x.strand"), F.concat(F.when(F.col("role") == "constraint", "@").otherwise("~"), F.col("spec")).alias("label"), "color")


def by_start(report: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """A report's rows by sequence and place."""
    return report.orderBy(id_col, "start", "end", "spec")


def source_digest(text: Column) -> Column:
    """The first eight hex digits of the md5 of a source's text, by which reports name it."""
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def truncated(message: Column, limit: int = 500) -> Column:
    """A long message as its head and tail."""
    half = (limit - 5) // 2
    return F.when(F.length(message) <= limit, message).otherwise(F.concat(F.substring(message, 1, half), F.lit(" ... "), F.substring(message, -half, half)))


def write_report(rows: DataFrame, specs: dict[str, Spec], folder: str, before: str = "before", after: str = "after") -> None:
    """Tables of scores and edits as CSV, and the sequences as JSON, below a folder."""
    before_after(rows, specs, before, after, with_boost=True).write.mode("overwrite").csv(f"{folder}/scores", header=True)
    edit_features(rows, before, after).write.mode("overwrite").csv(f"{folder}/edits", header=True)
    rows.write.mode("overwrite").json(f"{folder}/sequences")


def report_archive(rows: DataFrame, specs: dict[str, Spec], before: str = "before", after: str = "after", most: int = 1000) -> bytes:
    """The report on a few sequences, `most` at most, as a ZIP archive in memory: scores, edits and sequences as CSV."""
    few = rows.limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"more than {most} sequences: write_report takes any number")
    rows = rows.sparkSession.createDataFrame(few, rows.schema)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("scores.csv", by_start(before_after(rows, specs, before, after, with_boost=True)).toPandas().to_csv(index=False))
        z.writestr("edits.csv", edit_features(rows, before, after).toPandas().to_csv(index=False))
        z.writestr("sequences.csv", rows.toPandas().to_csv(index=False))
    return out.getvalue()


__all__ = ["before_after", "by_start", "edit_features", "evaluation_features", "optimize_with_report", "parsing", "report_archive", "source_digest", "truncated", "write_report"]


def optimize_with_report(sequences: DataFrame, constraints: dict[str, Spec], objectives: dict[str, Spec], folder: str, **options) -> DataFrame:
    """Solves each sequence and writes below a folder: what became of each (`results`), scores before and after and edits of
    the solved ones, and the messages of the others (`failures`). Gives the table of results."""
    from .solver import solve

    solve(sequences, list(constraints.values()), list(objectives.values()), **options).write.mode("overwrite").parquet(f"{folder}/results")
    found = sequences.sparkSession.read.parquet(f"{folder}/results")
    solved = found.where("status = 'solved'").withColumnRenamed("q", "after")
    # what takes its aim from the sequence takes it from the one before
    aims = {"target": F.col("before"), "original": F.col("before")}
    bound = {}
    for n, s in (constraints | objectives).items():
        open_ = {k: c for k, c in aims.items() if isinstance(s, (AvoidChanges, HarmonizeRCA)) and getattr(s, k, "") is None}
        if isinstance(s, EnforceTranslation) and s.protein is None:
            open_ = {"protein": dna.translate(s.region(F.col("before")), code=s.code)}
        bound[n] = replace(s, **open_) if open_ else s
    if bound:
        before_after(solved, bound, with_boost=True).write.mode("overwrite").csv(f"{folder}/scores", header=True)
    edit_features(solved).write.mode("overwrite").csv(f"{folder}/edits", header=True)
    found.where("status <> 'solved'").select("seq_id", "status", truncated(F.col("message")).alias("message")).write.mode("overwrite").csv(f"{folder}/failures", header=True)
    return found
