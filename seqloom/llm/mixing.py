"""Mixing sources to target weights (operator 2), with DataFrame operations only.

A source's target is its weight's share of all words, but never above max_repeat times the source's words; what is above
goes to the other sources by weight until none is above.

Within a source, a document's wanted number of copies grows with its size class, the number of binary digits of its size:
rate = min(max_repeat, c * class), with c so that the source's wanted words are its target. A document is taken
floor(rate) times for certain. The rest of the rate is the inclusion probability p of one more copy: documents are ranked
by Pareto order sampling, (u / (1 - u)) / (p / (1 - p)), with u a hash of the id, and taken in this order until the words
nearest to the target are reached. The sample's size is thus fixed, in words, to half of the document at the border.

What is taken is all below one border a source. It is found in two steps, neither of which is one task's work: ranks fall
into `buckets` ranges, cut by the distribution that the source's inclusion odds give, so that each has about as many
documents; their sums say in which range the border lies, and only that range is ordered by itself. Documents without
a rest of a rate have no rank. Neither rows nor texts are shuffled for the decision while Spark knows the table of
sources to be small; a larger one is dealt with salts.

Defined results: a null text has size 0 and a size-0 document takes 0 words; a null source is a source, the last in
order; rows with equal ids, sizes and sources are one unit, taken all or none; a row without an id is drawn by its text;
an empty table gives an empty table; a source without words has target 0. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, global_order, key_of, materialized, partitions, with_groups

BUCKETS = 4096


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """_source, source_size, target of rows(_source, _key, size). Weights repeat in the sources' order by code point.
    Each round of resharing sends two sums to the driver; a round caps one source at least, a few rounds end it."""
    sums = rows.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("size").alias("source_size"))
    sums = sums.withColumn("_last", F.col("_source").isNull())
    parts, before = global_order(sums, ["_last", "_source"], "sources")
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.element_at(start, F.col("_part")) + F.row_number().over(Window.partitionBy("_part").orderBy("_last", "_source")) - 1
    sums = parts.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    sums = materialized(sums.drop("_part", "_last"), "weights")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    level, limit = 0.0, F.lit(float(max_repeat)) * F.col("source_size")
    while True:
        over = F.col("_weight") * F.lit(level) >= limit
        capped, free = sums.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))).first()
        if not free or not total:
            break
        now = (total - capped) / free
        if now <= level * (1 + 1e-15):
            break
        level = now
    return sums.withColumn("target", F.least(limit, F.col("_weight") * F.lit(level))).drop("_weight")


def narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, ...]:
    """_id, _source, _key, _draw (what the random number is drawn by), size and _class as columns of docs."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), key_of(F.col(source_col)).alias("_key"), draw.alias("_draw"), size.alias("size")


def size_class(size: Column) -> Column:
    """The number of binary digits, by which a document's inclusion grows."""
    return F.length(F.bin(size))


def rates(rows: DataFrame, targets: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """targets with _rest (the words that uncertain copies should take) and _classes: class to n, whole copies and the odds of
    one more, null where there is none. A source has 64 classes at most, whatever its rows."""
    classes = rows.groupBy("_key", size_class(F.col("size")).alias("_class")).agg(F.count("*").alias("n"), F.sum("size").alias("w")).join(targets.select("_key", "target"), "_key")
    down, up = Window.partitionBy("_key").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key").orderBy("_class")
    above, mass = F.coalesce(F.sum("w").over(down), F.lit(0)), F.sum(F.col("_class") * F.col("w")).over(up)
    level = F.when(mass > 0, (F.col("target") - F.lit(float(max_repeat)) * above) / mass)
    classes = classes.withColumn("_level", F.when(level * F.col("_class") <= max_repeat, level))
    levels = classes.groupBy("_key").agg(F.max_by("_level", F.when(F.col("_level").isNotNull(), F.col("_class"))).alias("_level"), F.sum("w").alias("_words"))
    rate = F.when(F.col("_words") > 0, F.least(F.lit(float(max_repeat)), F.coalesce("_level", F.lit(float("inf"))) * F.col("_class"))).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    part = F.greatest(rate - whole, F.lit(0.0))
    of = classes.drop("_level").join(levels, "_key").select("_key", "_class", "n", "w", whole.alias("whole"), F.when(part > 0, part / (1 - part)).alias("odds"))
    of = of.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_class", F.struct("n", "whole", "odds")))).alias("_classes"), F.sum(F.col("whole") * F.col("w")).alias("_certain"))
    return targets.join(of, "_key").withColumn("_rest", F.col("target") - F.col("_certain")).drop("_certain")


def ranked(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """rows with their source's rates, as _rate, _rank and _bucket. A rank's bucket is the share of the source's documents
    that are expected to rank lower."""
    rate = F.element_at("_classes", size_class(F.col("size")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_draw")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)
    rows = rows.withColumn("_rate", rate).withColumn("_rank", (u / (1 - u)) / F.col("_rate.odds"))
    open_ = F.filter(F.map_values("_classes"), lambda c: c["odds"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    lower = lambda a, c: F.struct((a["s"] + c["n"] * (1 - 1 / (1 + F.col("_rank") * c["odds"]))).alias("s"), (a["n"] + c["n"]).alias("n"))
    share = F.aggregate(open_, zero, lower, lambda a: a["s"] / a["n"])
    return rows.withColumn("_bucket", F.when(F.col("_rank").isNotNull(), F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")))


def borders(rows: DataFrame, plans: DataFrame, seed: int, buckets: int) -> DataFrame:
    """plans with _cut, the bucket where the source's border lies (null: all is taken), and _last, the last unit taken in it
    (null: none)."""
    placed = ranked(with_groups(rows, plans, "_key", F.col("_draw")), seed, buckets).where("_rank IS NOT NULL")
    sums = materialized(placed.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest")), "buckets")
    until = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bucket"))
    crossed = sums.withColumn("_until", until).where("_until > _rest").groupBy("_key").agg(F.min(F.struct(F.col("_bucket").alias("b"), (F.col("_until") - F.col("_sum")).alias("before"))).alias("_c"))
    cuts = materialized(plans.join(crossed.select("_key", F.col("_c.b").alias("_cut"), F.col("_c.before").alias("_before")), "_key", "left"), "cuts")
    units = ranked(with_groups(rows, cuts, "_key", F.col("_draw")), seed, buckets).where("_bucket = _cut").groupBy("_key", "_rank", "_draw", "size").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    within = Window.partitionBy("_key").orderBy("_rank", "_draw", "size")
    taken = units.withColumn("_until", F.col("_before") + F.sum("_sum").over(within)).where(F.col("_until") - F.col("_sum") / 2 <= F.col("_rest"))
    last = taken.groupBy("_key").agg(F.max(F.struct("_rank", "_draw", "size")).alias("_last"))
    return cuts.drop("_before").join(last, "_key", "left")


def copies() -> Column:
    """How often a row of `ranked` with its source's border is taken."""
    here = F.struct("_rank", "_draw", "size") <= F.col("_last")
    more = F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")) | ((F.col("_bucket") == F.col("_cut")) & F.coalesce(here, F.lit(False)))
    return F.col("_rate.whole") + (F.col("_rank").isNotNull() & more).cast("long")


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], max_repeat: float, seed: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of docs, and a row for each source with its rates and border, both written."""
    rows = materialized(docs.select(*narrow(docs, id_col, text_col, source_col)), "sizes")
    targets = source_targets(rows, weights, max_repeat)
    rows = rows.drop("_source")
    plans = materialized(rates(rows, targets, max_repeat).drop("_source"), "rates")
    return rows, materialized(borders(rows, plans, seed, buckets), "borders")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0, seed: int = 1, buckets: int | None = None) -> DataFrame:
    """A row for each document: id_col, size, source_size, target (both of its source), copies, taken = copies * size.
    Texts are scanned once; later steps read an id, a source and a size."""
    buckets = buckets or max(BUCKETS, 4 * partitions(docs.sparkSession))
    rows, plans = plan(docs, id_col, text_col, source_col, weights, max_repeat, seed, buckets)
    out = ranked(with_groups(rows, plans, "_key", F.col("_draw")), seed, buckets).withColumn("_copies", copies())
    return out.select(F.col("_id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3.0, seed: int = 1, buckets: int | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns, whatever their names."""
    buckets = buckets or max(BUCKETS, 4 * partitions(docs.sparkSession))
    _, plans = plan(docs, id_col, text_col, source_col, weights, max_repeat, seed, buckets)
    _, _, key, draw, size = narrow(docs, id_col, text_col, source_col)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key, draw, size)
    taken = ranked(with_groups(rows, plans, "_key", F.col("_draw")), seed, buckets).withColumn("_copies", copies()).where("_copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(CAST(doc_id AS VARCHAR), concat('-', md5(coalesce(text, '')))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS wt, 3::DOUBLE * ss AS lim FROM s),
c AS (SELECT *, lim / wt AS r, coalesce(sum(lim) OVER o, 0) AS capped, coalesce(sum(wt) OVER o, 0) AS wcap FROM w WINDOW o AS (ORDER BY lim / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((t - capped) / (tw - wcap)) AS lam FROM c, (SELECT sum(ss)::DOUBLE AS t, sum(wt) AS tw FROM w) WHERE (t - capped) / (tw - wcap) <= r),
g AS (SELECT source, ss, least(lim, wt * lam) AS target FROM w, l),
k AS (SELECT d.source, length(bin(size)) AS cls, sum(size)::DOUBLE AS words, any_value(ss) AS ss, any_value(target) AS target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, cls),
v AS (SELECT *, (target - 3::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(cls * words) OVER (PARTITION BY source ORDER BY cls ROWS UNBOUNDED PRECEDING), 0) AS level FROM k),
z AS (SELECT source, max_by(level, cls) FILTER (WHERE level * cls <= 3) AS level FROM v GROUP BY source),
a AS (SELECT v.source, cls, words, ss, target, CASE WHEN ss > 0 THEN least(3::DOUBLE, coalesce(z.level, 'inf'::DOUBLE) * cls) ELSE 0 END AS rate FROM v JOIN z ON v.source IS NOT DISTINCT FROM z.source),
b AS (SELECT *, floor(rate + 1e-12) AS whole, greatest(rate - floor(rate + 1e-12), 0) AS p, target - sum(floor(rate + 1e-12) * words) OVER (PARTITION BY source) AS rest FROM a),
x AS (SELECT d.*, ss, target, whole, rest, p, (('0x' || substr(md5(concat('1:', draw)), 1, 10))::BIGINT + 0.5::DOUBLE) / 1099511627776::DOUBLE AS u FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND length(bin(size)) = cls),
y AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ratio FROM x),
q AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY ratio NULLS FIRST, draw, size RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY source, draw, size) / 2 AS middle FROM y),
m AS (SELECT *, (whole + (p > 0 AND middle <= rest)::INT)::BIGINT AS copies FROM q)
SELECT doc_id, size, ss AS source_size, round(target, 6) AS target, copies, (copies * size)::BIGINT AS taken FROM m
"""
