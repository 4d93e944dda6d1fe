"""Queries on mutation spaces and searches, and on places as arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import batch, solver, space
from ..operators import intervals as iv
from ..operators.patterns import pattern
from ..operators.specs import AvoidChanges, AvoidPattern, CodonOptimize, EnforceChoice, EnforceGCContent, EnforcePatternOccurence, EnforceTranslation
from ..sources.sequences import digest_sequences
from . import sql
from .codon_queries import USAGE, usage
from .common import r6
from .registry import query


def suppliers(spark, sf_dir, salts: str = "ab"):
    return digest_sequences(spark, sf_dir, salts, "supplier", "s_suppkey")


SUPPLIERS = sql.seqs("ab", "seqs", "supplier", "s_suppkey")
_SYN = ", ".join(f"('{c}', '{s}')" for c, a in dna.GENETIC_CODE.items() for s in dna.synonyms(a))


@query(f"WITH {sql.seqs()}, {sql.kmers(2)} SELECT seq_id, i::BIGINT AS at, greatest(i, 20)::BIGINT AS start, least(i + 2, 44)::BIGINT AS \"end\" FROM words WHERE w = 'CG' AND greatest(i, 20) <= least(i + 2, 44)")
def touching_windows(spark, sf_dir):
    """The overlap of windows, an empty one where they only touch."""
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(pattern("CG").locations(F.col("q"), 1)).alias("x"))
    common = iv.windows_overlap(F.col("x"), iv.location(20, 44))
    return rows.where(common.isNotNull()).select("seq_id", F.col("x.start").cast("long").alias("at"), common["start"].cast("long").alias("start"), common["end"].cast("long").alias("end"))


@query(f"WITH {SUPPLIERS}, p AS (SELECT seq_id, unnest(generate_series(0, 19)) AS i FROM seqs) SELECT seq_id, i::BIGINT AS i, (3 + 3 * i)::BIGINT AS plus, (60 - 3 * i)::BIGINT AS minus FROM p")
def codon_locations(spark, sf_dir):
    """Where each codon of a place begins, on either strand."""
    rows = suppliers(spark, sf_dir).select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    at = lambda strand: iv.codon_location(iv.location(3, 63, strand), F.col("i"))["start"].cast("long")
    return rows.select("seq_id", F.col("i").cast("long").alias("i"), at(1).alias("plus"), at(-1).alias("minus"))


@query("""WITH l AS (SELECT o_orderkey AS seq_id, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 7 AS b, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS s FROM orders)
SELECT seq_id, k::BIGINT AS k, (CASE WHEN s = 1 THEN a + k ELSE b - 1 - k END)::BIGINT AS at FROM (SELECT *, unnest(generate_series(0, b - a - 1)) AS k FROM l WHERE b > a)""")
def location_indices(spark, sf_dir):
    """The positions of a location, last first on the minus strand, none of an empty one."""
    i = F.col("seq_id")
    place = iv.location(i % 50, i % 50 + i % 7, F.when(i % 2 == 0, 1).otherwise(-1))
    return digest_sequences(spark, sf_dir).select("seq_id", F.posexplode(iv.indices(place)).alias("k", "at")).select("seq_id", F.col("k").cast("long").alias("k"), F.col("at").cast("long").alias("at"))


@query(f"""WITH {sql.seqs()}, c AS (SELECT seq_id, q || left(q, 5) AS q FROM seqs), {sql.kmers(6, 'c')}, l AS (SELECT seq_id, i FROM words WHERE w = 'GAATTC' AND i < 64)
SELECT seq_id, i::BIGINT AS start FROM l UNION ALL SELECT seq_id, (i - 64)::BIGINT AS start FROM l WHERE i + 6 > 64""")
def circular_places(spark, sf_dir):
    """Places of circular sequences; one across the origin is seen from both sides."""
    found = batch.circular_evaluations(digest_sequences(spark, sf_dir), {"site": AvoidPattern("EcoRI_site", strand=1)})
    return found.select("seq_id", F.explode("locations").alias("x")).select("seq_id", F.col("x.start").cast("long").alias("start"))


@query(f"""WITH {SUPPLIERS}, {sql.codons()}, y(c, s) AS (VALUES {_SYN}), n AS (SELECT seq_id, i, count(*) AS n, min(s) AS lowest FROM codons JOIN y USING (c) WHERE i < 20 GROUP BY seq_id, i)
SELECT seq_id, (3 * i)::BIGINT AS start, (3 * i + 3)::BIGINT AS "end", n::BIGINT AS n, lowest AS first FROM n UNION ALL SELECT seq_id, k::BIGINT AS start, (k + 1)::BIGINT AS "end", 4::BIGINT AS n, 'A' AS first FROM seqs, (SELECT unnest(generate_series(60, 63)) AS k)""")
def space_choices(spark, sf_dir):
    """What may stand at each place under a protein to keep: a row for each choice."""
    rows = space.choices_table(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 60, 1))])
    return rows.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.size("variants").cast("long").alias("n"), F.get("variants", F.lit(0)).alias("first"))


@query(f"""WITH {SUPPLIERS}, {sql.codons()}, y(c, s) AS (VALUES {_SYN}), k AS (SELECT seq_id, i, s FROM codons JOIN y USING (c) WHERE i < 20), j AS (SELECT unnest(generate_series(1, 3)) AS j),
p AS (SELECT seq_id, i, j FROM k, j GROUP BY seq_id, i, j HAVING count(DISTINCT substr(s, j::INT, 1)) > 1), r AS (SELECT seq_id, i, min(j) AS a, max(j) AS b FROM p GROUP BY seq_id, i)
SELECT k.seq_id, (3 * k.i + a - 1)::BIGINT AS start, (3 * k.i + b)::BIGINT AS "end", count(DISTINCT substr(s, a::INT, (b - a + 1)::INT))::BIGINT AS n FROM k JOIN r ON r.seq_id = k.seq_id AND r.i = k.i GROUP BY k.seq_id, k.i, a, b""")
def varying_parts(spark, sf_dir):
    """The part of each codon's choice that varies, without its constant flanks."""
    rows = space.choices_table(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 60, 1))], split=True).where("start < 60 AND size(variants) > 1")
    return rows.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.size("variants").cast("long").alias("n"))


@query(f"""WITH {SUPPLIERS}, {sql.codons()}, y(c, s) AS (VALUES {_SYN}), v AS (SELECT a.seq_id, x.s || z.s AS v FROM codons AS a JOIN codons AS b ON a.seq_id = b.seq_id AND b.i = 1 JOIN y AS x ON x.c = a.c JOIN y AS z ON z.c = b.c WHERE a.i = 0),
k AS (SELECT seq_id, v FROM v WHERE regexp_full_match(substr(v, 3, 2), '[AG][ACGT]')) SELECT s.seq_id, count(v)::BIGINT AS n, coalesce(string_agg(v, ',' ORDER BY v), '') AS variants FROM seqs AS s LEFT JOIN k ON k.seq_id = s.seq_id GROUP BY s.seq_id""")
def merged_choices(spark, sf_dir):
    """The joint choices of two codons and of a word that overlaps both: a merge join of variants."""
    rows = space.choices_table(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 6, 1)), EnforceChoice(("RN",), place=(2, 4, 0))]).where("start < 6")
    return rows.groupBy("seq_id").agg(F.first(F.size("variants")).cast("long").alias("n"), F.first(F.array_join("variants", ",")).alias("variants"))


@query(f"WITH {SUPPLIERS}, {sql.codons()}, y(c, s) AS (VALUES {_SYN}), n AS (SELECT seq_id, i, count(*) AS n FROM codons JOIN y USING (c) WHERE i BETWEEN 2 AND 4 GROUP BY seq_id, i) SELECT seq_id, round(exp(sum(ln(n))))::BIGINT AS n, round(exp(sum(ln(n))))::BIGINT AS distinct_n, true AS inside, true AS random_inside FROM n GROUP BY seq_id")
def space_variants(spark, sf_dir):
    """All sequences of a part of a space: as many as the choices' product, all different, all in the space; and random
    ones are in the space too."""
    rows = space.variants_table(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 60, 1))], (6, 15))
    same = dna.translate(F.substring("variant", 1, 60)) == dna.translate(F.substring("q", 1, 60))
    return rows.groupBy("seq_id").agg(F.count_if(F.col("ordinal") >= 0).alias("n"), F.count_distinct(F.when(F.col("ordinal") >= 0, F.col("variant"))).alias("distinct_n"), F.bool_and(same | (F.col("ordinal") < 0)).alias("inside"), F.bool_and(same | (F.col("ordinal") >= 0)).alias("random_inside"))


_FREE = "SELECT seq_id, length(regexp_replace(left(q, 8) || substr(q, 15, 50), '[^GC]', '', 'g')) AS c FROM seqs"


@query(f"WITH {SUPPLIERS}, o AS ({_FREE}), b AS (SELECT seq_id, min(abs((c + x) / 64.0::DOUBLE - 0.5)) AS apart FROM o, (SELECT unnest(generate_series(0, 6)) AS x) GROUP BY seq_id) SELECT seq_id, 'solved' AS status, {sql.r6('-apart')} AS objective, true AS kept FROM b")
def optimize_batch(spark, sf_dir):
    """Towards half G and C where six bases may change: the best that can be reached, with the rest kept."""
    found = solver.solve(suppliers(spark, sf_dir), [AvoidChanges(place=(0, 8, 0)), AvoidChanges(place=(14, 64, 0))], [EnforceGCContent(target=0.5, place=None)])
    kept = (F.substring("before", 1, 8) == F.substring("q", 1, 8)) & (F.substring("before", 15, 50) == F.substring("q", 15, 50))
    return found.select("seq_id", "status", r6(F.col("objective_after")).alias("objective"), kept.alias("kept"))


@query(f"""WITH {USAGE}, best AS (SELECT aa, max(f) AS f FROM usage GROUP BY aa), {sql.seqs('ab', 'sup', 'supplier', 's_suppkey')}, {sql.codons('sup', 'sc')},
t AS (SELECT sc.seq_id, sum(ln(CASE WHEN u.f > 0 THEN u.f ELSE 0.001 END)) AS now FROM sc JOIN usage AS u USING (c) GROUP BY sc.seq_id) SELECT seq_id, 'solved' AS status, 0.0::DOUBLE AS objective, true AS best_codons FROM t""")
def optimize_codons(spark, sf_dir):
    """The best codons under a protein to keep: the search gets to what the closed form gives."""
    shares = usage(spark, sf_dir)
    found = solver.solve(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 63, 1))], [CodonOptimize(shares, place=(0, 63, 1))])
    top = {a: max(shares[c] for c in dna.synonyms(a)) for a in set(dna.GENETIC_CODE.values())}
    share, best = dna.mapping({c: float(v) for c, v in shares.items()}), dna.mapping({c: float(top[a]) for c, a in dna.GENETIC_CODE.items()})
    all_best = F.forall(dna.codons(F.substring("q", 1, 63)), lambda c: F.element_at(share, c) == F.element_at(best, c))
    same = dna.translate(F.substring("before", 1, 63)) == dna.translate(F.substring("q", 1, 63))
    return found.select("seq_id", "status", r6(F.col("objective_after")).alias("objective"), (all_best & same).alias("best_codons"))


@query(f"WITH {SUPPLIERS} SELECT seq_id, 'solved' AS status, 1::BIGINT AS n FROM seqs")
def insert_pattern(spark, sf_dir):
    """A site put in where there is none, taken out where there are more."""
    found = solver.solve(suppliers(spark, sf_dir), [EnforcePatternOccurence("BsmBI_site", occurences=1)])
    return found.select("seq_id", "status", pattern("BsmBI_site").count(F.col("q")).alias("n"))


@query(f"WITH {SUPPLIERS} SELECT seq_id, 'solved' AS status, 0::BIGINT AS sites FROM seqs")
def solve_circular(spark, sf_dir):
    """No site left in a circular sequence, across the origin either."""
    found = solver.solve(suppliers(spark, sf_dir), [AvoidPattern("ACGT"), AvoidPattern("CGWC")], circular=True)
    seen = batch.circular(F.col("q"), 4)
    return found.select("seq_id", "status", (pattern("ACGT").count(seen) + pattern("CGWC").count(seen)).alias("sites"))


@query(f"WITH {SUPPLIERS}, {sql.kmers(4)}, n AS (SELECT seq_id, count(*) FILTER (WHERE w = 'ACGT' AND i BETWEEN 0 AND 6) AS n FROM words GROUP BY seq_id) SELECT seq_id, CASE WHEN n > 0 THEN 'no solution' ELSE 'solved' END AS status, (n = 0) AS all_pass FROM n")
def frozen_breaches(spark, sf_dir):
    """A pattern to avoid where nothing may change: a status for those rows that have it, and never a failed job."""
    found = solver.solve(suppliers(spark, sf_dir), [AvoidChanges(place=(0, 10, 0)), AvoidPattern("ACGT", strand=1, place=(0, 10, 1))])
    return found.select("seq_id", "status", "all_pass")


@query("SELECT 20::BIGINT AS n, true AS lengths, true AS passing, 20::BIGINT AS different")
def random_compatible(spark, sf_dir):
    """Random sequences that meet constraints, by seed."""
    rules = [AvoidPattern("4xA"), AvoidPattern("BsmBI_site"), EnforceGCContent(0.4, 0.6, window=30)]
    made = spark.createDataFrame([(k, solver.random_compatible(90, rules, seed=k)) for k in range(20)], "seed long, q string")
    passing = rules[0].passes(F.col("q")) & rules[1].passes(F.col("q")) & rules[2].passes(F.col("q"))
    return made.agg(F.count("*").alias("n"), F.bool_and(F.length("q") == 90).alias("lengths"), F.bool_and(passing).alias("passing"), F.count_distinct("q").alias("different"))


_RANKED = ", ".join(f"('{c}', '{v}', {k})" for c, a in dna.GENETIC_CODE.items() for k, v in enumerate(dna.synonyms(a)))


@query(f"""WITH {SUPPLIERS}, y(c, s, k) AS (VALUES {_RANKED}), h AS (SELECT seq_id, q, c, k AS here FROM seqs JOIN y ON c = substr(q, 7, 3) AND s = c),
v AS (SELECT seq_id, q, s, row_number() OVER (PARTITION BY seq_id ORDER BY abs(k - here), s) - 1 AS n FROM h JOIN y USING (c) QUALIFY count(*) OVER (PARTITION BY seq_id) > 1)
SELECT seq_id, n::BIGINT AS ordinal, left(q, 6) || s || substr(q, 10, 55) AS variant FROM v""")
def variant_order(spark, sf_dir):
    """The variants of one codon, in the order in which a search tries them: nearest in rank first."""
    rows = space.variants_table(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 60, 1))], (6, 9), drawn=0)
    return rows.where("variant <> q OR ordinal = 0").join(rows.groupBy("seq_id").count().where("count > 1").select("seq_id"), "seq_id").select("seq_id", "ordinal", "variant")


@query(f"WITH {SUPPLIERS}, p AS (SELECT unnest(generate_series(0, 58)) AS i), r AS (SELECT i, row_number() OVER (ORDER BY abs(i - 29), i) - 1 AS n FROM p) SELECT seq_id, n::BIGINT AS n, left(q, i::INT) || 'GAATTC' || substr(q, i::INT + 7, 64) AS q FROM seqs, r")
def insertion_order(spark, sf_dir):
    """Where a site is put in, in the order of tries: from the centre out."""
    import pandas as pd

    spec = EnforcePatternOccurence("EcoRI_site", strand=1)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, n, x) for k, s in zip(pdf["seq_id"], pdf["q"], strict=True) for n, x in enumerate(spec.insertions(s))], columns=["seq_id", "n", "q"])

    return suppliers(spark, sf_dir).mapInPandas(run, "seq_id long, n long, q string")


@query(f"WITH {SUPPLIERS}, v AS (SELECT seq_id, q, unnest(['A', 'C', 'G', 'T']) AS b FROM seqs), t AS (SELECT seq_id, q, left(q, 20) || b || substr(q, 22, 43) AS v FROM v), g AS (SELECT seq_id, bool_or(strpos(substr(v, 19, 5), 'ACG') = 0) AS can FROM t GROUP BY seq_id) SELECT seq_id, CASE WHEN can THEN 'solved' ELSE 'no solution' END AS status, can AS all_pass FROM g")
def exhaustive_constraints(spark, sf_dir):
    """One base may change: a search by all variants finds a solution where there is one, and says where there is none."""
    rules = [AvoidChanges(place=(0, 20, 0)), AvoidChanges(place=(21, 64, 0)), AvoidPattern("ACG", strand=1, place=(18, 23, 1))]
    return solver.solve(suppliers(spark, sf_dir), rules).select("seq_id", "status", "all_pass")


@query(f"WITH {SUPPLIERS} SELECT seq_id, {sql.r6('-(greatest(0.0::DOUBLE, 0.9 - ' + sql.gc('q') + '))')} AS failing_before, 'solved' AS status, true AS better FROM seqs")
def random_search(spark, sf_dir):
    """Spaces too large for all variants: random steps raise the share of G and C to a limit; the state before is kept."""
    found = solver.solve(suppliers(spark, sf_dir), [EnforceGCContent(mini=0.9)])
    return found.select("seq_id", r6(F.col("failing_before")).alias("failing_before"), "status", (dna.gc_fraction(F.col("q")) >= 0.9).alias("better"))


@query(f"WITH {SUPPLIERS}, {sql.codons()}, y(c, s) AS (VALUES {_SYN}), n AS (SELECT seq_id, i, count(*) AS n FROM codons JOIN y USING (c) WHERE i < 20 GROUP BY seq_id, i) SELECT seq_id, (3 * min(i) FILTER (WHERE n > 1))::BIGINT AS first, (3 * max(i) FILTER (WHERE n > 1) + 3)::BIGINT AS last, count(*) FILTER (WHERE n = 1)::BIGINT AS determined FROM n GROUP BY seq_id")
def space_span(spark, sf_dir):
    """From the first to the last place of a coding region where there is a choice, and the codons without one."""
    rows = space.choices_table(suppliers(spark, sf_dir), [EnforceTranslation(place=(0, 60, 1))]).where("start < 60")
    open_ = F.size("variants") > 1
    return rows.groupBy("seq_id").agg(F.min(F.when(open_, F.col("start"))).cast("long").alias("first"), F.max(F.when(open_, F.col("end"))).cast("long").alias("last"), F.count_if(~open_).alias("determined"))
