"""Many specifications over many sequences in one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import location_text, score_text
from .intervals import merged
from .specs import AvoidHairpins, AvoidPattern, EnforceGCContent, Spec


def scores(sequences: DataFrame, specs: dict[str, Spec], q: str = "q") -> DataFrame:
    """A column for each specification's score; no shuffle, and one scan for all."""
    return sequences.withColumns({name: s.score(F.col(q)) for name, s in specs.items()})


def evaluations(sequences: DataFrame, specs: dict[str, Spec], role: str = "constraint", q: str = "q") -> DataFrame:
    """seq_id, spec, role, score, passes, is_optimal, boost, locations; a row for each specification of each sequence."""
    rows = [F.struct(F.lit(n).alias("spec"), s.score(F.col(q)).alias("score"), F.lit(float(s.best)).alias("best"), F.lit(float(s.boost)).alias("boost"), F.lit(s.priority).alias("priority"), s.locations(F.col(q)).alias("locations")) for n, s in specs.items()]
    out = sequences.select("seq_id", F.explode(F.array(*rows)).alias("e")).select("seq_id", "e.*")
    return out.select("seq_id", "spec", F.lit(role).alias("role"), "score", (F.col("score") >= 0).alias("passes"), (F.col("score") == F.col("best")).alias("is_optimal"), "boost", "priority", "locations")


def enforced(specs: dict[str, Spec]) -> list[str]:
    """The specifications that the choice of bases makes pass: they needn't be evaluated in a search."""
    return [n for n, s in specs.items() if s.enforced()]


def subset(specs: dict[str, Spec], keep: Callable[[Spec], bool] | None = None, skip_enforced: bool = True) -> dict[str, Spec]:
    """The specifications that a filter keeps, without those that the choice of bases enforces."""
    return {n: s for n, s in specs.items() if (keep is None or keep(s)) and not (skip_enforced and s.enforced())}


def passing(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("passes")


def failing(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("NOT passes")


def optimal(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("is_optimal")


def suboptimal(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("NOT is_optimal")


def autopassed(evaluated: DataFrame, enforced: Sequence[str]) -> DataFrame:
    """Specifications that the choice of bases enforces pass with score 1."""
    on = F.col("spec").isin(*enforced) if enforced else F.lit(False)
    return evaluated.withColumn("score", F.when(on, 1.0).otherwise(F.col("score"))).withColumn("passes", on | F.col("passes"))


def total(specs: dict[str, Spec], q: Column) -> Column:
    """The sum of the boosted scores."""
    return sum((F.lit(float(s.boost)) * s.score(q) for s in specs.values()), F.lit(0.0))


def summary(evaluated: DataFrame) -> DataFrame:
    """all_pass, the sum of failing scores, and the boosted total of each sequence."""
    return evaluated.groupBy("seq_id").agg(F.bool_and("passes").alias("all_pass"), F.sum(F.when(~F.col("passes"), F.col("score")).otherwise(0.0)).alias("failing_sum"), F.sum(F.col("boost") * F.col("score")).alias("total"))


def messages(evaluated: DataFrame) -> DataFrame:
    """evaluated with a message: passed, or failed with the score and the places."""
    places = F.array_join(F.transform("locations", lambda x: location_text(x["start"], x["end"], x["strand"])), ", ")
    failed = F.concat(F.lit("Failed with score "), score_text(F.col("score"), 0), F.when(F.size("locations") > 0, F.concat(F.lit(": breaches at "), places)).otherwise(""))
    return evaluated.withColumn("message", F.when(F.col("passes"), F.concat(F.col("spec"), F.lit(" passed"))).otherwise(F.concat(F.col("spec"), F.lit(". "), failed)))


def next_overlaps(evaluated: DataFrame) -> DataFrame:
    """A row for each place, with whether the next place of the same sequence and specification overlaps it."""
    rows = evaluated.select("seq_id", "spec", F.explode("locations").alias("x")).select("seq_id", "spec", "x.*")
    order = Window.partitionBy("seq_id", "spec").orderBy("start", "end", "strand")
    return rows.withColumn("next_overlaps", F.coalesce(F.lead("start").over(order) < F.col("end"), F.lit(False)))


def breach_text(s: Spec, q: Column) -> Column:
    """The merged places that break the specification, as text; empty where it passes or has no places."""
    places = F.transform(merged(s.locations(q)), lambda x: location_text(x["start"], x["end"], x["strand"]))
    return F.when(s.score(q) < 0, F.coalesce(F.array_join(places, ", "), F.lit(""))).otherwise("")


def breaches(sequences: DataFrame, specs: dict[str, Spec], q: str = "q") -> DataFrame:
    """A row for each sequence, a column of text for each specification."""
    return sequences.select("seq_id", *[breach_text(s, F.col(q)).alias(n) for n, s in specs.items()])


def with_breaches(sequences: DataFrame, specs: dict[str, Spec], q: str = "q", colors: Sequence[str] = ("#bf3f3f", "#3f7fbf", "#5fbf7f", "#bf9f3f", "#7f5fbf")) -> DataFrame:
    """The sequences as records (seq_id, q, features): a feature for each merged place of a breach, named by what the breach
    is and coloured by specification. Within the row: no shuffle."""
    from .records import FEATURES, feature

    parts = []
    for i, (name, s) in enumerate(specs.items()):
        places = F.when(s.score(F.col(q)) < 0, merged(s.locations(F.col(q))))
        shown = lambda x, s=s, i=i, name=name: feature(x["start"], x["end"], F.when(x["strand"] == -1, -1).otherwise(1), label=s.breach_label(), specification=name, color=colors[i % len(colors)], is_a_breach="true")
        parts.append(F.coalesce(F.transform(places, _one(shown)), F.array()).cast(FEATURES))
    return sequences.select("seq_id", F.col(q).alias("q"), F.concat(*parts).alias("features"))


def _one(fn: Callable) -> Callable[[Column], Column]:
    """fn with one argument only, as array functions tell their arguments by number."""
    return lambda x: fn(x)


def sequences_from(spark: SparkSession, given: Mapping[str, str] | Iterable[tuple[str, str]] | DataFrame, name: str = "name", q: str = "q") -> DataFrame:
    """seq_id and q, from a dict, pairs of names and sequences, or a table of records."""
    if isinstance(given, DataFrame):
        return given.select(F.col(name).alias("seq_id"), F.upper(F.col(q)).alias("q"))
    pairs = list(given.items() if isinstance(given, Mapping) else given)
    return spark.createDataFrame([(str(n), s.upper()) for n, s in pairs], "seq_id string, q string")


def manufacturing_rules() -> dict[str, Spec]:
    """What makers of DNA commonly ask for: no sites of cutting enzymes, no long runs, no short repeats, no hairpins, and a
    balanced share of G and C."""
    # The patterns and limits that are commonly asked for.
    patterns = [*(f"{e}_site" for e in ("BsaI", "BsmBI", "BbsI", "SapI")), "9xA", "9xT", "6xG", "6xC", "5x3mer", "9x2mer"]
    rules: dict[str, Spec] = {f"no_{p.lower()}": AvoidPattern(p) for p in patterns}
    return rules | {"no_hairpin": AvoidHairpins(20, 200), "gc_window": EnforceGCContent(0.3, 0.7, window=100)}


def circular(q: Column, reach: int) -> Column:
    """A circular sequence as a linear one: with its first bases again at its end, as far as a place reaches."""
    return F.concat(q, F.substring(q, 1, max(0, reach - 1)))


def text_summary(evaluated: DataFrame, failed_only: bool = False) -> DataFrame:
    """One text for each sequence: a line for each specification, in the order of priority and name."""
    rows = evaluated.where("NOT passes") if failed_only else evaluated
    line = F.concat(F.when(F.col("passes"), "PASS  ").otherwise("FAIL  "), F.col("spec"), F.lit(" score "), F.format_string("%.2f", "score"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), F.col("spec").alias("s"), line.alias("line"))))
    return rows.groupBy("seq_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"))


def circular_evaluations(sequences: DataFrame, specs: dict[str, Spec], q: str = "q") -> DataFrame:
    """As evaluations, of circular sequences: a specification of the whole sequence also sees what lies across the origin.
    Its score is of the sequence with its first bases again at the end, as far as it reaches (three copies in a row where
    that isn't bounded); its places are those that meet one copy, counted from that copy's start, so they may begin below 0."""
    from .intervals import recentred

    rows = []
    for n, s in specs.items():
        whole = F.col(q)
        if s.place is None:
            seen = circular(whole, s.reach + 1) if s.reach is not None else F.repeat(whole, 3)
            score, places = s.score(seen), recentred(s.locations(F.repeat(whole, 3)), F.length(whole))
        else:
            score, places = s.score(whole), s.locations(whole)
        rows.append(F.struct(F.lit(n).alias("spec"), score.alias("score"), F.lit(float(s.best)).alias("best"), F.lit(float(s.boost)).alias("boost"), F.lit(s.priority).alias("priority"), places.alias("locations")))
    out = sequences.select("seq_id", F.explode(F.array(*rows)).alias("e")).select("seq_id", "e.*")
    return out.select("seq_id", "spec", F.lit("constraint").alias("role"), "score", (F.col("score") >= 0).alias("passes"), (F.col("score") == F.col("best")).alias("is_optimal"), "boost", "priority", "locations")
