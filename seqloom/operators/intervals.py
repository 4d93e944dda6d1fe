"""Operators on locations and positions: overlap, merging, grouping, subdivision, edits.

In-row forms work on arrays of structs (start, end, strand) and need no shuffle. What a fold gathers is kept in pieces of
CHUNK, so that a step copies no more than a piece, whatever the length. Table forms, for locations that are rows, use window
functions partitioned by the sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import let

CHUNK = 256
LOCATION = "struct<start:int,end:int,strand:int>"
LOCATIONS = f"array<{LOCATION}>"


def location(start: Column | int, end: Column | int, strand: Column | int = 0) -> Column:
    made = [x if isinstance(x, Column) else F.lit(x) for x in (start, end, strand)]
    return F.struct(*[x.cast("int").alias(n) for x, n in zip(made, ("start", "end", "strand"), strict=True)])


def no_locations() -> Column:
    return F.array().cast(LOCATIONS)


def overlap(a: Column, b: Column) -> Column:
    """What two locations share, on the first's strand; null if they only touch."""
    start, end = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.when(start < end, location(start, end, a["strand"]))


def windows_overlap(a: Column, b: Column) -> Column:
    """As overlap, but touching windows share an empty one."""
    start, end = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.when(start <= end, location(start, end, a["strand"]))


def shifted(loc: Column, by: Column | int) -> Column:
    return location(loc["start"] + by, loc["end"] + by, loc["strand"])


def extended(loc: Column, left: int = 0, right: int = 0, lower: int = 0, upper: Column | int | None = None) -> Column:
    """The location made longer, within the limits."""
    end = loc["end"] + right
    return location(F.greatest(F.lit(lower), loc["start"] - left), end if upper is None else F.least(F.lit(upper) if isinstance(upper, int) else upper, end), loc["strand"])


def indices(loc: Column) -> Column:
    """The positions of a location, last first on strand -1."""
    up = F.sequence(loc["start"], loc["end"] - 1)
    return F.when(loc["end"] <= loc["start"], F.array().cast("array<int>")).when(loc["strand"] == -1, F.reverse(up)).otherwise(up)


def codon_location(loc: Column, i: Column) -> Column:
    """The location of codon i of a location, counted from its end on strand -1."""
    return F.when(loc["strand"] == -1, location(loc["end"] - 3 * (i + 1), loc["end"] - 3 * i, loc["strand"])).otherwise(location(loc["start"] + 3 * i, loc["start"] + 3 * (i + 1), loc["strand"]))


def whole_codons(loc: Column, start: Column | int, end: Column | int) -> Column:
    """The whole codons of a location that [start, end) touches, counted from its end on strand -1; null if it touches none."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    a, b = F.greatest(loc["start"], start), F.least(loc["end"], end)
    down, up = lambda x: 3 * F.floor(x / 3), lambda x: 3 * F.ceil(x / 3)
    plus = location(loc["start"] + down(a - loc["start"]), F.least(loc["end"], loc["start"] + up(b - loc["start"])), loc["strand"])
    minus = location(F.greatest(loc["start"], loc["end"] - up(loc["end"] - a)), loc["end"] - down(loc["end"] - b), loc["strand"])
    return F.when(a < b, F.when(loc["strand"] == -1, minus).otherwise(plus))


def recentred(locations: Column, length: Column) -> Column:
    """Of locations on three copies in a row, those that meet the middle one, counted from its start."""
    meet = F.filter(locations, lambda x: (x["start"] < 2 * length) & (x["end"] > length))
    return F.transform(meet, lambda x: shifted(x, -length))


def gathered(items: Column, kind: str, first: Callable[[Column], Column], joins: Callable[[Column, Column], Column], grown: Callable[[Column, Column], Column]) -> Column:
    """Runs of items in order, as values of a type: an item that joins the open run changes it, any other one begins a run."""

    def step(a: Column, x: Column) -> Column:
        near = joins(a["open"], x)
        stays = a["open"].isNull() | near
        full = F.size(a["part"]) >= CHUNK
        whole = F.when(~stays & full, F.concat(a["whole"], F.array(a["part"]))).otherwise(a["whole"])
        part = F.when(stays, a["part"]).when(full, F.array(a["open"])).otherwise(F.concat(a["part"], F.array(a["open"])))
        return F.struct(whole.alias("whole"), part.alias("part"), F.when(near, grown(a["open"], x)).otherwise(first(x)).alias("open"))

    def closed(a: Column) -> Column:
        last = F.when(a["open"].isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(a["open"]))
        return F.concat(F.flatten(a["whole"]), a["part"], last)

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("whole"), F.array().cast(f"array<{kind}>").alias("part"), F.lit(None).cast(kind).alias("open"))
    return F.aggregate(items, start, step, closed)


def merged(locations: Column) -> Column:
    """Locations that overlap, merged; the strand is the first's."""
    grown = lambda run, x: location(run["start"], F.greatest(run["end"], x["end"]), run["strand"])
    return gathered(F.array_sort(locations), LOCATION, lambda x: location(x["start"], x["end"], x["strand"]), lambda run, x: x["start"] < run["end"], grown)


def grouped_spans(sorted_starts: Column, max_gap: int, max_spread: int | None = None) -> Column:
    """Runs of sorted positions, as structs of the run's first and last position, and its first index and size: a position
    joins while it is less than max_gap behind the last one and less than max_spread behind the run's first."""

    def span(first: Column, last: Column, at: Column, n: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), at.cast("int").alias("at"), n.cast("int").alias("n"))

    def joins(run: Column, x: Column) -> Column:
        near = x["x"] - run["last"] < max_gap
        return near if max_spread is None else near & (x["x"] - run["first"] < max_spread)

    placed = F.transform(sorted_starts.cast("array<int>"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return gathered(placed, "struct<first:int,last:int,at:int,n:int>", lambda x: span(x["x"], x["x"], x["i"], F.lit(1)), joins, lambda run, x: span(run["first"], x["x"], run["at"], run["n"] + 1))


def grouped(sorted_starts: Column, max_gap: int, max_spread: int | None = None) -> Column:
    """As grouped_spans; the runs are arrays of their positions."""
    positions = sorted_starts.cast("array<int>")
    return let(positions, lambda p: F.transform(grouped_spans(p, max_gap, max_spread), lambda r: F.slice(p, r["at"] + 1, r["n"])))


def grouped_segments(locations: Column, max_start_gap: int, max_start_spread: int | None = None) -> Column:
    """As grouped, by the starts of locations; a run becomes the location from its first start to its last end."""

    def run(first: Column, last: Column, end: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"), end.alias("end"))

    def joins(r: Column, x: Column) -> Column:
        near = x["start"] - r["last"] < max_start_gap
        return near if max_start_spread is None else near & (x["start"] - r["first"] < max_start_spread)

    runs = gathered(F.array_sort(locations), "struct<first:int,last:int,end:int>", lambda x: run(x["start"], x["start"], x["end"]), joins, lambda r, x: run(r["first"], x["start"], F.greatest(r["end"], x["end"])))
    return F.transform(runs, lambda r: location(r["first"], r["end"]))


def subdivided(loc: Column, span: int) -> Column:
    """Consecutive pieces of at most span."""
    starts = F.when(loc["end"] > loc["start"], F.sequence(loc["start"], loc["end"] - 1, F.lit(span))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: location(s, F.least(s + span, loc["end"]), loc["strand"]))


def segments(flags: Column) -> Column:
    """The maximal runs of true, as locations: from each true one behind none to each before none."""

    def runs(on: Column) -> Column:
        edge = lambda by: F.filter(F.transform(on, lambda x, i: F.when(x & ~F.coalesce(F.get(on, i + by), F.lit(False)), i)), lambda i: i.isNotNull())
        return F.zip_with(edge(-1), edge(1), lambda a, b: location(a, b + 1))

    return let(flags, runs)


# Tables of locations


def merge_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping rows (keys, start, end) merged, by islands: a row that starts at or behind the furthest end so far
    begins a new one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def group_rows(rows: DataFrame, keys: list[str], position: str, max_gap: int) -> DataFrame:
    """first, last and n of each run of positions that are less than max_gap apart."""
    order = Window.partitionBy(*keys).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(order) >= max_gap).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_run")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bin_size: int = 64) -> DataFrame:
    """Pairs of rows (keys, start, end) that overlap, with start_a, end_a, start_b, end_b and the overlap's start and end.
    The range condition is carried by an equi-join on bins; of the bins a pair shares, the first counts."""
    binned = lambda d, s: d.where("end > start").select(*keys, F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"), F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("_bin"))
    pairs = binned(a, "a").join(binned(b, "b"), [*keys, "_bin"])
    start, end = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    return pairs.where((start < end) & (F.col("_bin") == F.floor(start / bin_size))).withColumns({"start": start, "end": end}).drop("_bin")
