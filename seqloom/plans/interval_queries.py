"""Queries on locations and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.patterns import pattern
from ..sources.sequences import digest_sequences
from . import sql
from .registry import query



def at_word(spark, sf_dir, word: str, left: int, right: int):
    """seq_id, start and end around each place of a word."""
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(pattern(word).locations(F.col("q"), 1)).alias("x"))
    return rows.select("seq_id", F.greatest(F.lit(0), F.col("x.start") - left).cast("long").alias("start"), F.least(F.lit(64), F.col("x.start") + right).cast("long").alias("end"))


def _at(word: str, left: int, right: int, name: str) -> str:
    return f"{name} AS (SELECT seq_id, greatest(0, i - {left})::BIGINT AS start, least(64, i + {right})::BIGINT AS end FROM w{len(word)} WHERE w = '{word}')"


BASE = f"WITH {sql.seqs()}, {sql.kmers(2, name='w2')}, {sql.kmers(1, name='w1')}"


@query(f"""{BASE}, {_at('CG', 0, 6, 'l')}, f AS (SELECT *, CASE WHEN start < max(end) OVER (PARTITION BY seq_id ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY start, end ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT seq_id, min(start) AS start, max(end) AS end FROM g GROUP BY seq_id, k""".replace("max(end)", 'max("end")').replace("AS end", 'AS "end"').replace("start, end", 'start, "end"'))
def merge_intervals(spark, sf_dir):
    """Places that overlap, merged, as rows."""
    return iv.merge_rows(at_word(spark, sf_dir, "CG", 0, 6), ["seq_id"])


@query(f"""{BASE}, {_at('CG', 0, 6, 'l')}, f AS (SELECT *, CASE WHEN start < max(e) OVER (PARTITION BY seq_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT seq_id, start, "end" AS e FROM l)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS k FROM f), m AS (SELECT seq_id, min(start) AS a, max(e) AS b FROM g GROUP BY seq_id, k) SELECT seq_id, count(*)::BIGINT AS n, sum(b - a)::BIGINT AS covered FROM m GROUP BY seq_id""".replace("AS end", 'AS "end"'))
def merged_coverage(spark, sf_dir):
    """The same merging within the row, without a shuffle: how many places, and the bases they cover."""
    places = F.transform(pattern("CG").locations(F.col("q"), 1), lambda x: iv.location(x["start"], F.least(F.lit(64), x["start"] + 6)))
    rows = digest_sequences(spark, sf_dir).select("seq_id", iv.merged(places).alias("m")).where("size(m) > 0")
    return rows.select("seq_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("covered"))


@query(f"""{BASE}, {_at('CG', 2, 6, 'l')}, {_at('TA', 3, 5, 'r')} SELECT l.seq_id, l.start AS start_a, l.end AS end_a, r.start AS start_b, r.end AS end_b, greatest(l.start, r.start) AS start, least(l.end, r.end) AS end
FROM l JOIN r ON l.seq_id = r.seq_id AND greatest(l.start, r.start) < least(l.end, r.end)""".replace("AS end ", 'AS "end" ').replace("AS end\n", 'AS "end"\n').replace("l.end", 'l."end"').replace("r.end", 'r."end"'))
def interval_overlap_join(spark, sf_dir):
    return iv.overlap_join(at_word(spark, sf_dir, "CG", 2, 6), at_word(spark, sf_dir, "TA", 3, 5), ["seq_id"], 16)


_GAPS = f"""{BASE}, p AS (SELECT seq_id, i FROM w1 WHERE w = 'G'), n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY seq_id ORDER BY i) < 4 THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM n)"""


@query(f"{_GAPS} SELECT seq_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*)::BIGINT AS n FROM g GROUP BY seq_id, k")
def group_by_gap(spark, sf_dir):
    """Runs of G that are less than 4 apart, as rows."""
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(pattern("G").locations(F.col("q"), 1)).alias("x")).select("seq_id", F.col("x.start").cast("long").alias("at"))
    return iv.group_rows(rows, ["seq_id"], "at", 4)


@query(f"""{_GAPS[:_GAPS.index(', n AS')].replace('WITH ', 'WITH RECURSIVE ')}, o AS (SELECT seq_id, i, row_number() OVER (PARTITION BY seq_id ORDER BY i) AS k FROM p),
s AS (SELECT seq_id, k, i, i AS first FROM o WHERE k = 1 UNION ALL SELECT o.seq_id, o.k, o.i, CASE WHEN o.i - s.i < 6 AND o.i - s.first < 12 THEN s.first ELSE o.i END FROM s JOIN o ON o.seq_id = s.seq_id AND o.k = s.k + 1)
SELECT seq_id, first::BIGINT AS first, max(i)::BIGINT AS last, count(*)::BIGINT AS n FROM s GROUP BY seq_id, first""")
def group_by_spread(spark, sf_dir):
    """Runs of G less than 6 apart that spread over less than 12: greedy from the left, within the row."""
    at = F.transform(pattern("G").locations(F.col("q"), 1), lambda x: x["start"])
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(iv.grouped(at, 6, 12)).alias("g"))
    end = lambda f: F.get(F.col("g"), f).cast("long")
    return rows.select("seq_id", end(F.lit(0)).alias("first"), end(F.size("g") - 1).alias("last"), F.size("g").cast("long").alias("n"))


@query(f"WITH {sql.seqs()} SELECT seq_id, s::BIGINT AS start, least(s + 7, 60)::BIGINT AS \"end\" FROM seqs, (SELECT unnest(generate_series(5, 59, 7)) AS s)")
def subdivide_windows(spark, sf_dir):
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(iv.subdivided(iv.location(5, 60), 7)).alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query(f"""{BASE}, {_at('CG', 0, 2, 'l')} SELECT seq_id, (l.start + 10)::BIGINT AS shifted, greatest(0, l.start - 5)::BIGINT AS left_, least(64, l."end" + 3)::BIGINT AS right_, greatest(l.start, 20)::BIGINT AS overlap_start FROM l WHERE greatest(l.start, 20) < least(l."end", 44)""".replace("AS end", 'AS "end"'))
def location_arithmetic(spark, sf_dir):
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(pattern("CG").locations(F.col("q"), 1)).alias("x"))
    x, long = F.col("x"), lambda c, n: c.cast("long").alias(n)
    wide, common = iv.extended(x, 5, 3, upper=64), iv.overlap(x, iv.location(20, 44))
    return rows.where(common.isNotNull()).select("seq_id", long(iv.shifted(x, 10)["start"], "shifted"), long(wide["start"], "left_"), long(wide["end"], "right_"), long(common["start"], "overlap_start"))
