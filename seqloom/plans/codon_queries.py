"""Queries on codons, proteins and codon usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import codons as co
from ..operators.specs import AvoidRareCodons, AvoidStopCodons, EnforceTranslation, HarmonizeRCA, MatchTargetCodonUsage, MaximizeCAI
from ..sources.sequences import digest_dna, digest_sequences, table
from . import sql
from .common import r6
from .registry import query

CODONS = f"{sql.seqs()}, {sql.codons()}"
USAGE = f"{CODONS}, {sql.USAGE}"


def usage(spark, sf_dir):
    """The shares of codons in all sequences; 64 rows come to the driver."""
    return co.usage_dict(co.usage_table(digest_sequences(spark, sf_dir)))


def two(spark, sf_dir):
    """q and another sequence `other` of each row."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq_id"), digest_dna(F.col("o_orderkey"), "ab").alias("q"), digest_dna(F.col("o_orderkey"), "cd").alias("other"))


@query(f"WITH {CODONS}, {sql.CODE} SELECT seq_id, string_agg(aa, '' ORDER BY i) AS protein, CASE WHEN left(any_value(q), 3) IN ('TTG', 'CTG', 'ATT', 'ATC', 'ATA', 'ATG', 'GTG') THEN 'M' ELSE left(string_agg(aa, '' ORDER BY i), 1) END AS first_bacterial FROM codons JOIN code USING (c) GROUP BY seq_id")
def translation_protein(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", dna.translate(F.col("q")).alias("protein"), F.substring(dna.translate(F.col("q"), "Bacterial"), 1, 1).alias("first_bacterial"))


@query(f"""WITH {CODONS}, {sql.CODE}, {sql.seqs('cd', 'oth')}, {sql.codons('oth', 'oc')}, a AS (SELECT seq_id, i, aa FROM codons JOIN code USING (c)), b AS (SELECT seq_id, i, aa FROM oc JOIN code USING (c))
SELECT a.seq_id, (0 - count(*) FILTER (WHERE a.aa <> b.aa))::DOUBLE AS score FROM a JOIN b ON a.seq_id = b.seq_id AND a.i = b.i GROUP BY a.seq_id""")
def translation_errors(spark, sf_dir):
    """Codons of one sequence that don't give the protein of another."""
    rows = two(spark, sf_dir).withColumn("protein", dna.translate(F.col("other")))
    return rows.select("seq_id", (EnforceTranslation(F.col("protein")).score(F.col("q")) + F.lit(0.0)).alias("score"))


@query(f"WITH {CODONS} SELECT seq_id, (0 - count(*) FILTER (WHERE c IN ('TAA', 'TAG', 'TGA')))::DOUBLE AS score FROM codons GROUP BY seq_id")
def stop_codons(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", (AvoidStopCodons().score(F.col("q")) + F.lit(0.0)).alias("score"))


@query(f"WITH {sql.seqs()}, m AS (SELECT seq_id, {sql.rc('q')} AS q FROM seqs), {sql.codons('m')} SELECT seq_id, (64 - 3 * i - 3)::BIGINT AS start, (64 - 3 * i)::BIGINT AS end FROM codons WHERE c IN ('TAA', 'TAG', 'TGA')")
def stop_codon_places_minus(spark, sf_dir):
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(AvoidStopCodons(place=(0, 64, -1)).locations(F.col("q"))).alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query(f"WITH {USAGE} SELECT aa, c AS codon, n::BIGINT AS n, {sql.r6('f')} AS share FROM usage")
def codon_usage_table(spark, sf_dir):
    return co.usage_table(digest_sequences(spark, sf_dir)).select("aa", "codon", "n", r6(F.col("share")).alias("share"))


@query(f"WITH {USAGE} SELECT seq_id, {sql.r6('sum(CASE WHEN f < 0.16 THEN f - 0.16 ELSE 0 END)')} AS score FROM codons JOIN usage USING (c) GROUP BY seq_id")
def rare_codon_score(spark, sf_dir):
    spec = AvoidRareCodons(tuple(usage(spark, sf_dir).items()), 0.16)
    return digest_sequences(spark, sf_dir).select("seq_id", r6(spec.score(F.col("q"))).alias("score"))


@query(f"""WITH {USAGE}, l AS (SELECT c, ln(CASE WHEN f = 0 THEN 0.001 ELSE f END) - ln(max(CASE WHEN f = 0 THEN 0.001 ELSE f END) OVER (PARTITION BY aa)) AS l FROM usage)
SELECT seq_id, {sql.r6('sum(l)')} AS score, {sql.r6('exp(avg(l))')} AS cai FROM codons JOIN l USING (c) GROUP BY seq_id""")
def cai_score(spark, sf_dir):
    spec = MaximizeCAI(tuple(usage(spark, sf_dir).items()))
    score = spec.score(F.col("q"))
    return digest_sequences(spark, sf_dir).select("seq_id", r6(score).alias("score"), r6(F.exp(score / F.size(dna.codons(F.col("q"))))).alias("cai"))


@query(f"""WITH {USAGE}, k AS (SELECT seq_id, c, count(*) AS k FROM codons GROUP BY seq_id, c), t AS (SELECT seq_id, aa, sum(k) AS t FROM k JOIN code USING (c) GROUP BY seq_id, aa),
x AS (SELECT t.seq_id, u.c, abs(coalesce(k.k, 0) - t.t * u.f) AS d FROM t JOIN usage AS u ON u.aa = t.aa LEFT JOIN k ON k.seq_id = t.seq_id AND k.c = u.c)
SELECT seq_id, {sql.r6('-sum(d)')} AS score FROM x GROUP BY seq_id""")
def codon_usage_distance(spark, sf_dir):
    spec = MatchTargetCodonUsage(tuple(usage(spark, sf_dir).items()))
    return digest_sequences(spark, sf_dir).select("seq_id", r6(spec.score(F.col("q"))).alias("score"))


@query(f"""WITH {USAGE}, {sql.seqs('cd', 'oth')}, {sql.codons('oth', 'oc')}, r AS (SELECT c, f / max(f) OVER (PARTITION BY aa) AS here, CASE WHEN length(replace(c, 'A', '')) = 3 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM usage),
o AS (SELECT r.c, coalesce(w / nullif(max(w) OVER (PARTITION BY aa), 0), 0) AS there FROM r JOIN code USING (c))
SELECT codons.seq_id, {sql.r6('-sum(abs(o.there - r.here))')} AS score FROM codons JOIN oc ON oc.seq_id = codons.seq_id AND oc.i = codons.i JOIN r ON r.c = codons.c JOIN o ON o.c = oc.c GROUP BY codons.seq_id""")
def rca_harmony_score(spark, sf_dir):
    """Against another sequence in a made-up host that halves codons with an A."""
    host = {c: 0.5 if "A" in c else 1.0 for c in dna.GENETIC_CODE}
    spec = HarmonizeRCA(tuple(usage(spark, sf_dir).items()), tuple(host.items()), F.col("other"))
    return two(spark, sf_dir).select("seq_id", r6(spec.score(F.col("q"))).alias("score"))


@query(f"""WITH {USAGE}, best AS (SELECT aa, arg_max(c, struct_pack(f := f, c := c)) AS b FROM usage GROUP BY aa) SELECT seq_id, string_agg(b, '' ORDER BY i) AS q FROM codons JOIN code USING (c) JOIN best USING (aa) GROUP BY seq_id""")
def best_codon_rewrite(spark, sf_dir):
    """Each codon replaced by its amino acid's most frequent one: the best sequence of that protein, in closed form."""
    return digest_sequences(spark, sf_dir).select("seq_id", co.best_codons(F.col("q"), usage(spark, sf_dir)).alias("q"))


@query(f"WITH {CODONS}, {sql.CODE}, f AS (SELECT aa, min(c) AS b FROM code GROUP BY aa) SELECT seq_id, string_agg(b, '' ORDER BY i) AS q FROM codons JOIN code USING (c) JOIN f USING (aa) GROUP BY seq_id")
def back_translation(spark, sf_dir):
    return digest_sequences(spark, sf_dir).select("seq_id", dna.translate(F.col("q")).alias("p")).select("seq_id", dna.back_translate(F.col("p")).alias("q"))
