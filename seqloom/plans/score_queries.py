"""Queries on composition, k-mers, edits and fixed sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import batch
from ..operators.specs import (
    AvoidChanges,
    AvoidHairpins,
    AvoidPattern,
    EnforceChanges,
    EnforceChoice,
    EnforceGCContent,
    EnforceMeltingTemperature,
    EnforceRegionsCompatibility,
    EnforceSequence,
    EnforceTerminalGCContent,
    SequenceLengthBounds,
    UniquifyAllKmers,
    melting_temperature,
    ALL_STACKS,
    TERMINAL,
)
from ..sources.sequences import dealt, digest_dna, digest_sequences, document_sequences, table
from . import sql
from .common import r6
from .registry import query



@query(f"WITH {sql.seqs()} SELECT seq_id, {sql.r6(sql.gc('q'))} AS gc FROM seqs")
def seq_gc_global(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", r6(dna.gc_fraction(F.col("q"))).alias("gc"))


GC_WINDOWS = f"""WITH {sql.seqs()}, {sql.kmers(20)}, g AS (SELECT seq_id, i, {sql.gc('w')} AS gc FROM words),
b AS (SELECT seq_id, i, greatest(0.0::DOUBLE, 0.3 - gc) + greatest(0.0::DOUBLE, gc - 0.7) AS bad FROM g)"""


@query(f"{GC_WINDOWS} SELECT seq_id, {sql.r6('-sum(bad)')} AS score FROM b GROUP BY seq_id")
def seq_gc_window_score(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", r6(EnforceGCContent(0.3, 0.7, window=20).score(F.col("q"))).alias("score"))


@query(f"{GC_WINDOWS} SELECT seq_id, min(i)::BIGINT AS start, (max(i) + 20)::BIGINT AS end FROM b WHERE bad > 0 GROUP BY seq_id")
def seq_gc_window_breaches(spark, sf_dir):
    """Windows whose starts spread over less than 50 are one breach; in 64 bases all are."""
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(EnforceGCContent(0.3, 0.7, window=20).locations(F.col("q"))).alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query(f"""WITH {sql.seqs()}, e AS (SELECT seq_id, {sql.gc('substr(q, 1, 15)')} AS a, {sql.gc('right(q, 15)')} AS b FROM seqs)
SELECT seq_id, {sql.r6('-(greatest(0.0::DOUBLE, 0.4 - a) + greatest(0.0::DOUBLE, a - 0.6) + greatest(0.0::DOUBLE, 0.4 - b) + greatest(0.0::DOUBLE, b - 0.6))')} AS score FROM e""")
def seq_terminal_gc(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", r6(EnforceTerminalGCContent(15, 0.4, 0.6).score(F.col("q"))).alias("score"))


@query(f"WITH {sql.docs()} SELECT seq_id, length(q)::BIGINT AS n, CASE WHEN length(q) BETWEEN 500 AND 800 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM docs")
def seq_length_bounds(spark, sf_dir):
    return document_sequences(spark, sf_dir).select("seq_id", F.length("q").cast("long").alias("n"), SequenceLengthBounds(500, 800).score(F.col("q")).alias("score"))


@query(f"WITH {sql.seqs()} SELECT seq_id, translate(q, 'ACGT', 'TGCA') AS complement, {sql.rc('q')} AS revcomp FROM seqs")
def seq_revcomp(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", dna.complement(F.col("q")).alias("complement"), dna.reverse_complement(F.col("q")).alias("revcomp"))


@query(f"WITH {sql.seqs()} SELECT seq_id, substr(q, 11, 20) AS plus, {sql.rc('substr(q, 11, 20)')} AS minus FROM seqs")
def seq_extract(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", dna.part(F.col("q"), 10, 30).alias("plus"), dna.part(F.col("q"), 10, 30, -1).alias("minus"))


@query(f"""WITH {sql.seqs('abcd')}, {sql.kmers(6)}, m AS (SELECT seq_id, least(w, {sql.rc('w')}) AS m FROM words WHERE i + 6 < length(q)),
c AS (SELECT seq_id, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n FROM m GROUP BY seq_id, m)
SELECT seq_id, (0.0 - sum(n))::DOUBLE AS score FROM c GROUP BY seq_id""")
def unique_kmers_score(spark, sf_dir):
    return digest_sequences(spark, sf_dir, "abcd").select("seq_id", (UniquifyAllKmers(6).score(F.col("q")) + F.lit(0.0)).alias("score"))


@query(f"""WITH {sql.seqs('abcd')}, {sql.kmers(6)}, m AS (SELECT seq_id, i, least(w, {sql.rc('w')}) AS m FROM words WHERE i + 6 < length(q))
SELECT seq_id, i::BIGINT AS start FROM m QUALIFY count(*) OVER (PARTITION BY seq_id, m) > 1""")
def unique_kmers_places(spark, sf_dir):
    rows = digest_sequences(spark, sf_dir, "abcd").select("seq_id", F.explode(UniquifyAllKmers(6).locations(F.col("q"))).alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"))


@query(f"""WITH {sql.seqs()}, {sql.kmers(5)}, c AS (SELECT seq_id, any_value(length(q)) AS len, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n FROM words GROUP BY seq_id, w)
SELECT seq_id, {sql.r6('-9.0 * sum(n)::DOUBLE / max(len)')} AS score FROM c GROUP BY seq_id""")
def nonunique_kmer_density(spark, sf_dir):
    """Minus 9 times the share of places whose word isn't the only one."""
    n = -UniquifyAllKmers(5, both_strands=False, last=True).score(F.col("q"))
    return digest_sequences(spark, sf_dir).select("seq_id", r6(-9.0 * n / F.length("q")).alias("score"))


@query(f"""WITH {sql.seqs('abcd')}, {sql.kmers(5)}, a AS (SELECT seq_id, i, {sql.rc('w')} AS m FROM words WHERE i + 5 < length(q)),
h AS (SELECT DISTINCT a.seq_id, a.i FROM a JOIN words AS b ON a.seq_id = b.seq_id AND a.m = b.w AND b.i BETWEEN a.i + 5 AND a.i + 25)
SELECT s.seq_id, (0.0 - count(h.i))::DOUBLE AS score FROM seqs AS s LEFT JOIN h ON s.seq_id = h.seq_id GROUP BY s.seq_id""")
def hairpin_score(spark, sf_dir):
    return digest_sequences(spark, sf_dir, "abcd").select("seq_id", (AvoidHairpins(5, 30).score(F.col("q")) + F.lit(0.0)).alias("score"))


# pairs of sequences: the second differs from the first in the places where a third one agrees with it
PAIRS = f"""{sql.seqs('ab', 'first')}, {sql.seqs('cd', 'second')}, {sql.seqs('ef', 'third')},
letters AS (SELECT f.seq_id, i, substr(f.q, i::INT + 1, 1) AS a, CASE WHEN substr(s.q, i::INT + 1, 1) = substr(t.q, i::INT + 1, 1) THEN substr(s.q, i::INT + 1, 1) ELSE substr(f.q, i::INT + 1, 1) END AS b
  FROM first AS f JOIN second AS s ON f.seq_id = s.seq_id JOIN third AS t ON f.seq_id = t.seq_id, (SELECT unnest(generate_series(0, 63)) AS i)),
d AS (SELECT seq_id, i, a, b, a <> b AS differs FROM letters)"""


def pairs(spark, sf_dir):
    """seq_id, q and the edited sequence `edited`."""
    keys = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq_id")), "seq_id")
    rows = keys.select("seq_id", *[digest_dna(F.col("seq_id"), s).alias(n) for s, n in (("ab", "q"), ("cd", "_s"), ("ef", "_t"))])
    third = F.zip_with(dna.letters(F.col("_s")), dna.letters(F.col("_t")), lambda s, t: F.when(s == t, s))
    return rows.select("seq_id", "q", F.array_join(F.zip_with(dna.letters(F.col("q")), third, lambda a, b: F.coalesce(b, a)), "").alias("edited"))




@query(f"WITH {PAIRS} SELECT seq_id, count(*) FILTER (WHERE differs)::BIGINT AS edits FROM d GROUP BY seq_id")
def edit_count(spark, sf_dir):
    return pairs(spark, sf_dir).select("seq_id", dna.n_differences(F.col("q"), F.col("edited")).alias("edits"))


@query(f"""WITH {PAIRS}, e AS (SELECT seq_id, i, a, b, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS g FROM d WHERE differs)
SELECT seq_id, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS end, string_agg(a, '' ORDER BY i) || '=>' || string_agg(b, '' ORDER BY i) AS label FROM e GROUP BY seq_id, g""")
def edit_segments(spark, sf_dir):
    from ..operators.intervals import segments

    rows = pairs(spark, sf_dir).withColumn("x", F.explode(segments(dna.differences(F.col("q"), F.col("edited")))))
    old, new = (dna.part(c, F.col("x.start"), F.col("x.end")) for c in (F.col("q"), F.col("edited")))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.concat(old, F.lit("=>"), new).alias("label"))


@query(f"WITH {PAIRS} SELECT seq_id, (6 - count(*) FILTER (WHERE differs AND i BETWEEN 8 AND 47))::DOUBLE AS score FROM d GROUP BY seq_id")
def edit_budget_score(spark, sf_dir):
    """15 percent of a place of 40 bases may change: 6."""
    spec = AvoidChanges(max_edits_percent=15, target=F.col("q"), place=(8, 48, 0))
    return pairs(spark, sf_dir).select("seq_id", spec.score(F.col("edited")).alias("score"))


@query(f"""WITH {PAIRS} SELECT seq_id, (count(*) FILTER (WHERE differs) - 20)::DOUBLE AS least, (0 - abs(count(*) FILTER (WHERE differs) - 16))::DOUBLE AS exact FROM d GROUP BY seq_id""")
def change_target_score(spark, sf_dir):
    least, exact = EnforceChanges(minimum_percent=30, target=F.col("q")), EnforceChanges(amount=16, target=F.col("q"))
    return pairs(spark, sf_dir).select("seq_id", least.score(F.col("edited")).alias("least"), exact.score(F.col("edited")).alias("exact"))


def _wrong(word: str, at: int) -> str:
    from ..functions.dna import IUPAC

    return " + ".join(f"(strpos('{IUPAC[x]}', substr(q, {at + i + 1}, 1)) = 0)::INT" for i, x in enumerate(word))


@query(f"WITH {sql.seqs()} SELECT seq_id, (0 - ({_wrong('NRYSWKMBDHVACGT', 5)}))::DOUBLE AS score FROM seqs")
def degenerate_sequence_score(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", EnforceSequence("NRYSWKMBDHVACGT", place=(5, 20, 0)).score(F.col("q")).alias("score"))


@query(f"WITH {sql.seqs()} SELECT seq_id, CASE WHEN substr(q, 11, 3) IN ('ATT', 'ATC', 'ATA', 'GGA', 'GGC', 'GGG', 'GGT') THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM seqs")
def choice_membership(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", EnforceChoice(("ATH", "GGN"), place=(10, 13, 0)).score(F.col("q")).alias("score"))


_REGIONS = [(0, 16), (16, 32), (32, 48), (48, 64)]
_APART = [f"(SELECT count(*) FROM (SELECT unnest(generate_series(1, 16)) AS j) WHERE substr(q, {a} + j::INT, 1) <> substr(q, {b} + j::INT, 1)) < 11" for i, (a, _) in enumerate(_REGIONS) for b, _ in _REGIONS[i + 1 :]]


@query(f"""WITH {sql.seqs()}, r AS (SELECT seq_id, r, substr(q, 16 * r::INT + 1, 16) AS p FROM seqs, (SELECT unnest(generate_series(0, 3)) AS r))
SELECT a.seq_id, (0 - sum((hamming(a.p, b.p) < 11)::INT))::DOUBLE AS score FROM r AS a JOIN r AS b ON a.seq_id = b.seq_id AND a.r < b.r GROUP BY a.seq_id""")
def region_pair_incompatibility(spark, sf_dir):
    """Each two of four regions should differ in 11 bases or more."""
    spec = EnforceRegionsCompatibility(regions=tuple((a, b, 0) for a, b in _REGIONS), column_condition=lambda a, b: dna.n_differences(a, b) >= 11)
    return digest_sequences(spark, sf_dir).select("seq_id", (spec.score(F.col("q")) + F.lit(0.0)).alias("score"))


_HEAT = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in ALL_STACKS.items())
_ENDS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in TERMINAL.items())


TM_SQL = f"""{sql.kmers(2)}, st(w, h, s) AS (VALUES {_HEAT}), en(b, h, s) AS (VALUES {_ENDS}), t AS (SELECT seq_id, any_value(q) AS q, sum(h) AS h, sum(s) AS s FROM words JOIN st USING (w) GROUP BY seq_id),
tms AS (SELECT seq_id, 1000 * (t.h + x.h + y.h) / (t.s + x.s + y.s + 0.368 * (length(q) - 1) * ln(0.05::DOUBLE) + 1.987 * ln(50e-9::DOUBLE / 4)) - 273.15 AS tm FROM t JOIN en AS x ON x.b = left(q, 1) JOIN en AS y ON y.b = right(q, 1))"""


@query(f"""WITH {sql.seqs('a')}, {sql.kmers(2)}, st(w, h, s) AS (VALUES {_HEAT}), en(b, h, s) AS (VALUES {_ENDS}),
t AS (SELECT seq_id, any_value(q) AS q, sum(h) AS h, sum(s) AS s FROM words JOIN st USING (w) GROUP BY seq_id)
SELECT seq_id, round(1000 * (t.h + x.h + y.h) / (t.s + x.s + y.s + 0.368 * 31 * ln(0.05::DOUBLE) + 1.987 * ln(50e-9::DOUBLE / 4)) - 273.15, 4) AS tm,
  round(10.0 - abs(1000 * (t.h + x.h + y.h) / (t.s + x.s + y.s + 0.368 * 31 * ln(0.05::DOUBLE) + 1.987 * ln(50e-9::DOUBLE / 4)) - 273.15 - 60), 4) AS score
FROM t JOIN en AS x ON x.b = left(q, 1) JOIN en AS y ON y.b = right(q, 1)""")
def melting_temperature_score(spark, sf_dir):
    return digest_sequences(spark, sf_dir, "a").select("seq_id", F.round(melting_temperature(F.col("q")), 4).alias("tm"), F.round(EnforceMeltingTemperature(50, 70).score(F.col("q")), 4).alias("score"))


#: What a maker of DNA asks for, by column.
RULES = {
    "no_bsmbi": AvoidPattern("BsmBI_site"),
    "no_poly_a": AvoidPattern("5xA"),
    "gc_window": EnforceGCContent(0.25, 0.75, window=20),
    "gc_global": EnforceGCContent(0.4, 0.6),
    "unique_9mers": UniquifyAllKmers(9),
}
_SITE = f"(w IN ('CGTCTC', '{'GAGACG'}'))"
RULE_SCORES = f"""{sql.seqs()}, {sql.kmers(6, name='w6')}, {sql.kmers(5, name='w5')}, {sql.kmers(20, name='w20')}, {sql.kmers(9, name='w9')},
s1 AS (SELECT seq_id, 0.0 - sum({_SITE}::INT) AS no_bsmbi FROM w6 GROUP BY seq_id),
s2 AS (SELECT seq_id, 0.0 - sum((w = 'AAAAA')::INT + (w = 'TTTTT')::INT) AS no_poly_a FROM w5 GROUP BY seq_id),
s3 AS (SELECT seq_id, -sum(greatest(0.0::DOUBLE, 0.25 - {sql.gc('w')}) + greatest(0.0::DOUBLE, {sql.gc('w')} - 0.75)) AS gc_window FROM w20 GROUP BY seq_id),
s4 AS (SELECT seq_id, -(greatest(0.0::DOUBLE, 0.4 - {sql.gc('q')}) + greatest(0.0::DOUBLE, {sql.gc('q')} - 0.6)) AS gc_global FROM seqs),
m9 AS (SELECT seq_id, count(*) AS n FROM w9 WHERE i + 9 < length(q) GROUP BY seq_id, least(w, {sql.rc('w')})),
s5 AS (SELECT seq_id, 0.0 - sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS unique_9mers FROM m9 GROUP BY seq_id),
sc AS (SELECT seq_id, no_bsmbi::DOUBLE AS no_bsmbi, no_poly_a::DOUBLE AS no_poly_a, gc_window::DOUBLE AS gc_window, gc_global::DOUBLE AS gc_global, unique_9mers::DOUBLE AS unique_9mers
  FROM s1 JOIN s2 USING (seq_id) JOIN s3 USING (seq_id) JOIN s4 USING (seq_id) JOIN s5 USING (seq_id))"""


@query(f"WITH {RULE_SCORES} SELECT seq_id, " + ", ".join(f"{sql.r6(n)} AS {n}" for n in RULES) + f", {sql.r6('no_bsmbi + no_poly_a + gc_window + gc_global + unique_9mers')} AS total, (least(no_bsmbi, no_poly_a, gc_window, gc_global, unique_9mers) >= 0) AS all_pass FROM sc")
def rule_scores(spark, sf_dir):
    """All rules in one projection, with the total of scores and whether all pass."""
    rows = batch.scores(digest_sequences(spark, sf_dir), RULES)
    total = sum((F.col(n) for n in RULES), F.lit(0.0))
    return rows.select("seq_id", *[r6(F.col(n)).alias(n) for n in RULES], r6(total).alias("total"), (F.least(*RULES) >= 0).alias("all_pass"))


@query(f"WITH {RULE_SCORES}, u AS (UNPIVOT (SELECT * FROM sc) ON {', '.join(RULES)} INTO NAME spec VALUE score) SELECT seq_id, bool_and(score >= 0) AS all_pass, {sql.r6('sum(CASE WHEN score < 0 THEN score ELSE 0 END)')} AS failing_sum, {sql.r6('sum(score)')} AS total FROM u GROUP BY seq_id")
def constraint_summary(spark, sf_dir):
    """From evaluations as rows: all pass, the sum of failing scores, the boosted total."""
    s = batch.summary(batch.evaluations(digest_sequences(spark, sf_dir), RULES))
    return s.select("seq_id", "all_pass", r6(F.col("failing_sum")).alias("failing_sum"), r6(F.col("total")).alias("total"))


@query(f"""WITH {sql.seqs()}, c AS (SELECT seq_id, q || left(q, 5) AS q FROM seqs), {sql.kmers(6, 'c')}
SELECT seq_id, count(*) FILTER (WHERE w = 'GAATTC')::BIGINT AS sites FROM words GROUP BY seq_id""")
def circular_sites(spark, sf_dir):
    """Sites of circular sequences, those across the origin too, once each."""
    from ..operators.patterns import pattern

    return digest_sequences(spark, sf_dir).select("seq_id", pattern("EcoRI_site").count(batch.circular(F.col("q"), 6)).alias("sites"))


@query(f"""WITH {PAIRS}, e AS (SELECT seq_id, count(*) FILTER (WHERE differs) AS edits FROM d GROUP BY seq_id),
g AS (SELECT seq_id, count(*) FILTER (WHERE a IN ('G', 'C')) / 64.0::DOUBLE AS ga, count(*) FILTER (WHERE b IN ('G', 'C')) / 64.0::DOUBLE AS gb FROM d GROUP BY seq_id)
SELECT seq_id, {sql.r6('-(greatest(0.0::DOUBLE, 0.4 - ga) + greatest(0.0::DOUBLE, ga - 0.6))')} AS before, {sql.r6('-(greatest(0.0::DOUBLE, 0.4 - gb) + greatest(0.0::DOUBLE, gb - 0.6))')} AS after, edits::BIGINT AS edits, {sql.r6('100.0 * edits / 64')} AS edits_percent FROM e JOIN g USING (seq_id)""")
def before_after_report(spark, sf_dir):
    from ..operators.reports import before_after

    return before_after(pairs(spark, sf_dir), {"gc": EnforceGCContent(0.4, 0.6)}, "q", "edited").select("seq_id", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"), "edits", r6(F.col("edits_percent")).alias("edits_percent"))
