"""Queries on evaluations as rows, reports, records and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import batch, codons, records, reports
from ..operators import intervals as iv
from ..operators.specs import AllowPrimer, AvoidHairpins, AvoidPattern, CodonOptimize, CustomSpec, EnforceGCContent, EnforceRegionsCompatibility, UniquifyAllKmers
from ..sources.sequences import digest_sequences, records as as_records
from . import sql
from .codon_queries import USAGE, usage
from .common import r6
from .registry import query
from .score_queries import PAIRS, RULE_SCORES, RULES, TM_SQL, pairs

_UNPIVOT = f"WITH {RULE_SCORES}, u AS (UNPIVOT (SELECT * FROM sc) ON {', '.join(RULES)} INTO NAME spec VALUE score)"


@query(f"""{_UNPIVOT} SELECT spec, count(*) FILTER (WHERE score >= 0)::BIGINT AS passing, count(*) FILTER (WHERE score < 0)::BIGINT AS failing, count(*) FILTER (WHERE score = 0)::BIGINT AS optimal,
count(*) FILTER (WHERE score <> 0)::BIGINT AS suboptimal FROM u GROUP BY spec""")
def filtered_evaluations(spark, sf_dir):
    """How many evaluations of each specification each filter lets through."""
    found = batch.evaluations(digest_sequences(spark, sf_dir), RULES)
    parts = [f(found).select("spec", F.lit(n).alias("part")) for n, f in (("passing", batch.passing), ("failing", batch.failing), ("optimal", batch.optimal), ("suboptimal", batch.suboptimal))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("spec").agg(*[F.count_if(F.col("part") == n).alias(n) for n in ("passing", "failing", "optimal", "suboptimal")])


@query(f"{_UNPIVOT} SELECT seq_id, spec, CASE WHEN spec IN ('no_bsmbi', 'gc_global') THEN 1.0::DOUBLE ELSE {sql.r6('score')} END AS score, (spec IN ('no_bsmbi', 'gc_global') OR score >= 0) AS passes FROM u WHERE spec <> 'gc_window'")
def autopassed_evaluations(spark, sf_dir):
    """Two rules count as enforced, one isn't evaluated."""
    rules = batch.subset(RULES, lambda s: not getattr(s, "window", None))
    return batch.autopassed(batch.evaluations(digest_sequences(spark, sf_dir), rules), ["no_bsmbi", "gc_global"]).select("seq_id", "spec", r6(F.col("score")).alias("score"), "passes")


_ACG = f"""{sql.seqs('a')}, {sql.kmers(3)}, l AS (SELECT seq_id, i FROM words WHERE w = 'ACG'), n AS (SELECT seq_id, count(*) AS n, string_agg(i || '-' || (i + 3) || '(+)', ', ' ORDER BY i) AS t FROM l GROUP BY seq_id)"""


def _acg(spark, sf_dir):
    return batch.evaluations(digest_sequences(spark, sf_dir, "a"), {"no_acg": AvoidPattern("ACG", strand=1)})


@query(f"WITH {_ACG} SELECT s.seq_id, CASE WHEN n IS NULL THEN 'no_acg passed' ELSE 'no_acg. Failed with score -' || n || ': breaches at ' || t END AS message FROM seqs AS s LEFT JOIN n ON s.seq_id = n.seq_id")
def evaluation_messages(spark, sf_dir):
    return batch.messages(_acg(spark, sf_dir)).select("seq_id", "message")


@query(f"WITH {_ACG} SELECT s.seq_id, (CASE WHEN n IS NULL THEN 'PASS' ELSE 'FAIL' END) || '  no_acg score ' || printf('%.2f', coalesce(-n, 0)::DOUBLE) AS summary FROM seqs AS s LEFT JOIN n ON s.seq_id = n.seq_id")
def text_summaries(spark, sf_dir):
    found = _acg(spark, sf_dir).withColumn("score", F.col("score") + F.lit(0.0))
    return batch.text_summary(found)


@query(f"""WITH {sql.seqs()}, {sql.kmers(2)}, l AS (SELECT seq_id, i FROM words WHERE w = 'CG' AND i <= 56) SELECT seq_id, i::BIGINT AS start, coalesce(lead(i) OVER (PARTITION BY seq_id ORDER BY i) < i + 8, false) AS next_overlaps FROM l""")
def next_breach_overlaps(spark, sf_dir):
    """Of breaches of eight bases, whether the next one begins before this one ends."""
    found = batch.evaluations(digest_sequences(spark, sf_dir), {"cg": AvoidPattern("CGNNNNNN", strand=1)})
    return batch.next_overlaps(found).select("seq_id", F.col("start").cast("long").alias("start"), "next_overlaps")


@query(f"WITH {_ACG} SELECT seq_id, i::BIGINT AS start, (i + 3)::BIGINT AS \"end\", '@no_acg' AS label, '#bf7f5f' AS color FROM l WHERE i >= 8 AND i + 3 <= 24")
def evaluation_features(spark, sf_dir):
    """Breaches as features, those within a place only."""
    rows = reports.evaluation_features(_acg(spark, sf_dir), keep=lambda x: (x["start"] >= 8) & (x["end"] <= 24))
    return rows.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "color")


_MERGED_CG = f"""{sql.seqs()}, {sql.kmers(8)}, l AS (SELECT seq_id, i AS a, i + 8 AS b FROM words WHERE left(w, 2) = 'CG'),
f AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY seq_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM f), m AS (SELECT seq_id, min(a) AS a, max(b) AS b FROM g GROUP BY seq_id, k)"""


@query(f"WITH {_MERGED_CG} SELECT seq_id, a::BIGINT AS start, b::BIGINT AS \"end\" FROM m")
def merged_evaluation_features(spark, sf_dir):
    found = batch.evaluations(digest_sequences(spark, sf_dir), {"cg": AvoidPattern("CGNNNNNN", strand=1)})
    return reports.evaluation_features(found, merge=True).select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"WITH {_MERGED_CG} SELECT seq_id, a::BIGINT AS start, b::BIGINT AS \"end\", 'CGNNNNNN' AS label, substr(q, a::INT + 1, (b - a)::INT) AS bases FROM m JOIN seqs USING (seq_id)")
def records_with_breaches(spark, sf_dir):
    """Records with a feature for each merged breach."""
    rows = batch.with_breaches(digest_sequences(spark, sf_dir), {"cg": AvoidPattern("CGNNNNNN", strand=1)}).select("seq_id", "q", F.explode("features").alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.qualifiers")["label"][0].alias("label"), dna.part(F.col("q"), F.col("x.start"), F.col("x.end")).alias("bases"))


@query(f"WITH {sql.seqs('a')} SELECT seq_id, 4::BIGINT AS start, 28::BIGINT AS \"end\", 1::BIGINT AS strand, 'whole' AS label FROM seqs UNION ALL SELECT seq_id, 3::BIGINT AS start, 9::BIGINT AS \"end\", -1::BIGINT AS strand, 'part' AS label FROM seqs")
def record_features(spark, sf_dir):
    """Features added to records: all but a margin, and a place."""
    rows = as_records(digest_sequences(spark, sf_dir, "a"))
    rows = records.annotated(records.annotated(rows, margin=4, label="whole"), 3, 9, strand=-1, label="part")
    rows = records.with_sequence(rows, dna.reverse_complement(F.col("q"))).select("seq_id", F.explode("features").alias("x"))
    return rows.select("seq_id", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("start", "end", "strand")], F.col("x.qualifiers")["label"][0].alias("label"))


@query(f"""WITH {PAIRS}, e AS (SELECT seq_id, i, a, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS g FROM d WHERE differs)
SELECT seq_id, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS end, '#' || string_agg(a, '' ORDER BY i) AS label FROM e GROUP BY seq_id, g""")
def annotated_differences(spark, sf_dir):
    """A feature for each run of bases that differ from the original, labelled with the original's bases."""
    rows = as_records(pairs(spark, sf_dir).withColumnRenamed("q", "original").withColumnRenamed("edited", "q"))
    rows = rows.join(pairs(spark, sf_dir).select("seq_id", F.col("q").alias("original")), "seq_id")
    rows = records.annotated_differences(rows, "original").select("seq_id", F.explode("features").alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.qualifiers")["label"][0].alias("label"))


@query(f"WITH {sql.seqs()}, {sql.kmers(6)} SELECT seq_id, i::BIGINT AS start, (i + 6)::BIGINT AS \"end\", 'BsmBI_site' AS label FROM words WHERE w = 'CGTCTC'")
def annotated_occurrences(spark, sf_dir):
    rows = records.annotated_occurrences(as_records(digest_sequences(spark, sf_dir)), "BsmBI_site").select("seq_id", F.explode("features").alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.qualifiers")["label"][0].alias("label"))


@query(f"""WITH {PAIRS}, {sql.codons('first')}, {sql.USAGE},
lg AS (SELECT c, ln(CASE WHEN f > 0 THEN f ELSE 0.001 END) - ln(max(CASE WHEN f > 0 THEN f ELSE 0.001 END) OVER (PARTITION BY aa)) AS v FROM usage),
edited AS (SELECT seq_id, string_agg(b, '' ORDER BY i) AS q FROM d GROUP BY seq_id), {sql.codons('edited', 'later')},
x AS (SELECT seq_id, sum(v) AS before FROM codons JOIN lg USING (c) GROUP BY seq_id), y AS (SELECT seq_id, sum(v) AS after FROM later JOIN lg USING (c) GROUP BY seq_id),
e AS (SELECT seq_id, count(*) FILTER (WHERE differs AND i < 63) AS edits FROM d GROUP BY seq_id)
SELECT seq_id, 'codons' AS spec, 0::BIGINT AS start, 63::BIGINT AS "end", {sql.r6('before')} AS before, {sql.r6('after')} AS after, edits::BIGINT AS edits, 2.0::DOUBLE AS boost FROM x JOIN y USING (seq_id) JOIN e USING (seq_id)""")
def objectives_before_after(spark, sf_dir):
    """A codon objective before and after, with the edits in its place and its boost."""
    spec = CodonOptimize(usage(spark, sf_dir), "use_best_codon", place=(0, 63, 1), boost=2.0)
    rows = reports.before_after(pairs(spark, sf_dir), {"codons": spec}, "q", "edited", with_boost=True)
    return rows.select("seq_id", "spec", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"), "edits", "boost")


@query(f"WITH {sql.CODE} SELECT aa, string_agg(c, ',' ORDER BY c) AS codons FROM code GROUP BY aa")
def back_translation_table(spark, sf_dir):
    return codons.back_translation_table(codons.genetic_code(spark)).select("aa", F.array_join("codons", ",").alias("codons"))


@query(f"WITH {sql.seqs('a')} SELECT seq_id, substr(md5(q), 1, 8) AS digest, CASE WHEN length(repeat(q, 20)) <= 500 THEN repeat(q, 20) ELSE left(repeat(q, 20), 247) || ' ... ' || right(repeat(q, 20), 247) END AS message FROM seqs")
def source_digests(spark, sf_dir):
    """What reports say of a source: the start of its digest, and a long text cut in the middle."""
    return digest_sequences(spark, sf_dir, "a").select("seq_id", reports.source_digest(F.col("q")).alias("digest"), reports.truncated(F.repeat(F.col("q"), 20)).alias("message"))


@query("SELECT o_orderkey AS seq_id, lpad(CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey // 10 AS VARCHAR) ELSE CAST(o_orderkey // 10 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) END, 9, ' ') AS shown FROM orders WHERE o_orderkey < 100000")
def score_texts(spark, sf_dir):
    """Scores with one decimal at most, as reports show them."""
    from ..sources.sequences import table

    return table(spark, sf_dir, "orders").where("o_orderkey < 100000").select(F.col("o_orderkey").alias("seq_id"), dna.score_text(F.col("o_orderkey") / 10.0).alias("shown"))


# all rules of a maker

def _places(name: str, words: str, size: int, plus: str, minus: str | None = None) -> str:
    parts = [f"SELECT '{name}' AS spec, seq_id, i AS a, i + {size} AS b, '(+)' AS t FROM {words} WHERE {plus}"]
    if minus:
        parts.append(f"SELECT '{name}' AS spec, seq_id, i AS a, i + {size} AS b, '(-)' AS t FROM {words} WHERE {minus}")
    return " UNION ALL ".join(parts)


def _report_sql(places: str, columns: list[str]) -> str:
    return f"""l AS ({places}),
f AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY spec, seq_id ORDER BY a, b, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY spec, seq_id ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS k FROM f),
m AS (SELECT spec, seq_id, min(a) AS a, max(b) AS b, arg_min(t, [a, b, CASE t WHEN '(-)' THEN -1 WHEN '' THEN 0 ELSE 1 END]) AS t FROM g GROUP BY spec, seq_id, k),
c AS (SELECT spec, seq_id, string_agg(a || '-' || b || t, ', ' ORDER BY a) AS txt FROM m GROUP BY spec, seq_id)
SELECT s.seq_id, {", ".join(f"coalesce(max(txt) FILTER (WHERE spec = '{n}'), '') AS {n}" for n in columns)} FROM seqs AS s LEFT JOIN c ON c.seq_id = s.seq_id GROUP BY s.seq_id"""


_WINDOWS = "SELECT 'gc_window' AS spec, seq_id, min(i) AS a, max(i) + {0} AS b, '' AS t FROM {1} WHERE {2} < {3} OR {2} > {4} GROUP BY seq_id"
FLAGSHIP_SQL = f"""WITH {sql.seqs()}, {sql.kmers(6, name='w6')}, {sql.kmers(5, name='w5')}, {sql.kmers(20, name='w20')}, {sql.kmers(9, name='w9')},
k9 AS (SELECT seq_id, i FROM w9 WHERE i + 9 < length(q) QUALIFY count(*) OVER (PARTITION BY seq_id, least(w, {sql.rc('w')})) > 1), """ + _report_sql(" UNION ALL ".join([
    _places("no_bsmbi", "w6", 6, "w = 'CGTCTC'", "w = 'GAGACG'"), _places("no_poly_a", "w5", 5, "w = 'AAAAA'", "w = 'TTTTT'"),
    _WINDOWS.format(20, "w20", sql.gc("w"), 0.25, 0.75), f"SELECT 'gc_global' AS spec, seq_id, 0 AS a, length(q) AS b, '' AS t FROM seqs WHERE {sql.gc('q')} < 0.4 OR {sql.gc('q')} > 0.6",
    "SELECT 'unique_9mers' AS spec, seq_id, i AS a, i + 9 AS b, '' AS t FROM k9",
]), list(RULES))


@query(FLAGSHIP_SQL)
def breach_report(spark, sf_dir):
    """The merged places of breaches as text: a row for each sequence, a column for each rule."""
    return batch.breaches(digest_sequences(spark, sf_dir), RULES)


_MAKER = batch.manufacturing_rules() | {"no_hairpin": AvoidHairpins(6, 40)}
_SITES = {"no_bsai_site": "GGTCTC", "no_bsmbi_site": "CGTCTC", "no_bbsi_site": "GAAGAC", "no_sapi_site": "GCTCTTC"}
_RUNS = {"no_9xa": "AAAAAAAAA", "no_9xt": "TTTTTTTTT", "no_6xg": "GGGGGG", "no_6xc": "CCCCCC"}


def _rc(w: str) -> str:
    return w.translate(str.maketrans("ACGT", "TGCA"))[::-1]


MAKER_SQL = f"""WITH {sql.seqs('abcd')}, {', '.join(sql.kmers(k, name=f'w{k}') for k in (6, 7, 9, 15, 18, 100))},
hp AS (SELECT DISTINCT a.seq_id, a.i FROM w6 AS a JOIN w6 AS b ON a.seq_id = b.seq_id AND b.w = {sql.rc('a.w')} AND b.i BETWEEN a.i + 6 AND a.i + 34 WHERE a.i + 6 < length(a.q)),
hg AS (SELECT seq_id, i, row_number() OVER (PARTITION BY seq_id ORDER BY i) AS k FROM hp), """.replace("WITH ", "WITH RECURSIVE ") + """
hs AS (SELECT seq_id, k, i, i AS first FROM hg WHERE k = 1 UNION ALL SELECT hg.seq_id, hg.k, hg.i, CASE WHEN hg.i - hs.first < 10 THEN hs.first ELSE hg.i END FROM hs JOIN hg ON hg.seq_id = hs.seq_id AND hg.k = hs.k + 1), """ + _report_sql(" UNION ALL ".join([
    *(_places(n, f"w{len(w)}", len(w), f"w = '{w}'", f"w = '{_rc(w)}'") for n, w in (_SITES | _RUNS).items()),
    _places("no_5x3mer", "w15", 15, "w = repeat(left(w, 3), 5)"), _places("no_9x2mer", "w18", 18, "w = repeat(left(w, 2), 9)"),
    "SELECT 'no_hairpin' AS spec, seq_id, first AS a, least(max(i) + 40, 128) AS b, '' AS t FROM hs GROUP BY seq_id, first",
    _WINDOWS.format(100, "w100", sql.gc("w"), 0.3, 0.7),
]), list(_MAKER))


@query(MAKER_SQL)
def manufacturing_report(spark, sf_dir):
    """All rules that makers commonly have; the hairpin rule has a shorter stem, as these sequences are short."""
    return batch.breaches(digest_sequences(spark, sf_dir, "abcd"), _MAKER)


@query(f"""WITH {sql.seqs()}, m AS (SELECT seq_id, i, least(w, {sql.rc('w')}) AS m FROM (SELECT seq_id, i, substr(q, i::INT + 1, 5) AS w FROM (SELECT seq_id, q, unnest(generate_series(0, 58)) AS i FROM seqs))),
r AS (SELECT seq_id, i FROM m QUALIFY count(*) OVER (PARTITION BY seq_id, m) > 1) SELECT s.seq_id, (0 - count(r.i) FILTER (WHERE r.i >= 10 AND r.i + 5 < 40))::DOUBLE AS score FROM seqs AS s LEFT JOIN r ON r.seq_id = s.seq_id GROUP BY s.seq_id""")
def unique_kmers_in_reference(spark, sf_dir):
    """Words of a place that the whole sequence has more than once."""
    return digest_sequences(spark, sf_dir).select("seq_id", (UniquifyAllKmers(5, place=(10, 40, 0)).score(F.col("q")) + F.lit(0.0)).alias("score"))


@query(f"WITH {USAGE}, lg AS (SELECT c, ln(CASE WHEN f > 0 THEN f ELSE 0.001 END) - ln(max(CASE WHEN f > 0 THEN f ELSE 0.001 END) OVER (PARTITION BY aa)) AS v FROM usage) SELECT seq_id, {sql.r6('sum(v)')} AS score, count(*) FILTER (WHERE v < 0)::BIGINT AS places FROM codons JOIN lg USING (c) GROUP BY seq_id")
def codon_optimize_score(spark, sf_dir):
    """The objective that a method's name stands for, and the codons that could be better."""
    spec = CodonOptimize(usage(spark, sf_dir), "use_best_codon")
    return digest_sequences(spark, sf_dir).select("seq_id", r6(spec.score(F.col("q"))).alias("score"), F.size(spec.locations(F.col("q"))).cast("long").alias("places"))


@query(f"WITH {_UNPIVOT[5:]} SELECT seq_id, bool_and(score >= 0) AS all_pass, count(*) FILTER (WHERE score < 0)::BIGINT AS breaches FROM u GROUP BY seq_id")
def normalised_input(spark, sf_dir):
    """Sequences given as records of other names and in lower case, evaluated as any."""
    given = digest_sequences(spark, sf_dir).select(F.col("seq_id").alias("record"), F.lower("q").alias("bases"))
    found = batch.evaluations(batch.sequences_from(spark, given, "record", "bases"), RULES)
    return found.groupBy("seq_id").agg(F.bool_and("passes").alias("all_pass"), F.count_if(~F.col("passes")).alias("breaches"))


@query(f"""WITH {PAIRS}, e AS (SELECT seq_id, i, a, b, i - row_number() OVER (PARTITION BY seq_id ORDER BY i) AS g FROM d WHERE differs),
s AS (SELECT seq_id, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS "end", string_agg(a, '' ORDER BY i) || '=>' || string_agg(b, '' ORDER BY i) AS label FROM e GROUP BY seq_id, g)
SELECT * FROM s UNION ALL SELECT seq_id, 4::BIGINT AS start, 40::BIGINT AS "end", '@AvoidPattern[4-40](ACG)' AS label FROM first UNION ALL SELECT seq_id, 0::BIGINT AS start, 64::BIGINT AS "end", '~EnforceGCContent(mini:0.5, maxi:0.5)' AS label FROM first""")
def problem_records(spark, sf_dir):
    """Problems as features of their records: constraints, objectives and edits."""
    import pandas as pd

    from ..operators.records import FEATURES
    from ..sources.labels import problem_features

    rules, aims = [AvoidPattern("ACG", place=(4, 40, 0))], [EnforceGCContent(target=0.5)]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, problem_features(rules, aims, a, b)) for k, a, b in zip(pdf["seq_id"], pdf["q"], pdf["edited"], strict=True)], columns=["seq_id", "features"])

    rows = pairs(spark, sf_dir).mapInPandas(run, f"seq_id long, features {FEATURES}").select("seq_id", F.explode("features").alias("x"))
    return rows.select("seq_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.qualifiers")["label"][0].alias("label"))


@query(f"WITH {sql.seqs()}, {sql.kmers(2)} SELECT seq_id, (0 - count(*) FILTER (WHERE w = 'CG'))::DOUBLE AS own, (0 - count(*) FILTER (WHERE w = 'TA' AND i BETWEEN 10 AND 48))::DOUBLE AS labelled FROM words GROUP BY seq_id")
def custom_specifications(spark, sf_dir):
    """A function of one's own as a specification, and one that a label names by an own registry."""
    from ..sources import labels

    own = CustomSpec(evaluate=lambda s: -s.count("CG"), name="no CG")
    registry = {"MySpecification": lambda word, **more: CustomSpec(evaluate=lambda s: -s.count(word), name="mine", **more)}
    (mine,) = labels.build(labels.Label("constraint", "MySpecification", ("TA",), ()), (10, 50, 0), registry=registry)
    q = F.col("q")
    return digest_sequences(spark, sf_dir).select("seq_id", (own.score(q) + F.lit(0.0)).alias("own"), (mine.score(q) + F.lit(0.0)).alias("labelled"))


@query(f"""WITH {sql.seqs()}, m AS (SELECT seq_id, i, least(w, {sql.rc('w')}) AS m FROM (SELECT seq_id, i, substr(q, i::INT + 1, 6) AS w FROM (SELECT seq_id, q, unnest(generate_series(0, 57)) AS i FROM seqs))),
r AS (SELECT seq_id, i FROM m QUALIFY count(*) OVER (PARTITION BY seq_id, m) > 1), n AS (SELECT seq_id, count(*) AS n FROM r WHERE i >= 10 AND i + 6 < 42 GROUP BY seq_id),
part AS (SELECT seq_id, substr(q, 11, 32) AS q FROM seqs), {TM_SQL.replace('FROM seqs', 'FROM part').replace('words', 'pairs')},
rep AS (SELECT seq_id, count(*) FILTER (WHERE substr(q, i::INT + 1, 6) = repeat(substr(q, i::INT + 1, 2), 3) AND i <= 26) AS a, count(*) FILTER (WHERE substr(q, i::INT + 1, 6) = repeat(substr(q, i::INT + 1, 3), 2) AND i <= 26) AS b FROM (SELECT seq_id, q, unnest(generate_series(0, 31)) AS i FROM part) GROUP BY seq_id)
SELECT part.seq_id, (0 - coalesce(n.n, 0))::DOUBLE AS homologies, round(10.0 - abs(tm - 60), 4) AS melting, (0 - rep.a)::DOUBLE AS twos, (0 - rep.b)::DOUBLE AS threes FROM part LEFT JOIN n ON n.seq_id = part.seq_id JOIN tms ON tms.seq_id = part.seq_id JOIN rep ON rep.seq_id = part.seq_id""")
def primer_scores(spark, sf_dir):
    """What makes a place fit for a primer: no homologies, the melting temperature, no repeats."""
    homologies, melting, twos, threes = AllowPrimer((10, 42, 0), max_homology=6, repeats=((2, 3), (3, 2)))
    q = F.col("q")
    return digest_sequences(spark, sf_dir).select("seq_id", (homologies.score(q) + F.lit(0.0)).alias("homologies"), F.round(melting.score(q), 4).alias("melting"), (twos.score(q) + F.lit(0.0)).alias("twos"), (threes.score(q) + F.lit(0.0)).alias("threes"))


@query("""WITH l AS (SELECT o_orderkey AS seq_id, o_orderkey % 60 AS a, o_orderkey % 60 + o_orderkey % 9 AS b FROM orders), o AS (SELECT *, greatest(a, 4) AS x, least(b, 49) AS y FROM l WHERE greatest(a, 4) < least(b, 49))
SELECT seq_id, (4 + 3 * ((x - 4) // 3))::BIGINT AS plus_start, (4 + 3 * ceil((y - 4) / 3.0))::BIGINT AS plus_end, (49 - 3 * ceil((49 - x) / 3.0))::BIGINT AS minus_start, (49 - 3 * ((49 - y) // 3))::BIGINT AS minus_end FROM o""")
def codon_localisation(spark, sf_dir):
    """The whole codons of a coding place that a change touches, on either strand."""
    i = F.col("seq_id")
    rows = digest_sequences(spark, sf_dir).select("seq_id", *[iv.whole_codons(iv.location(4, 49, s), i % 60, i % 60 + i % 9).alias(n) for n, s in (("plus", 1), ("minus", -1))])
    return rows.where("plus IS NOT NULL").select("seq_id", *[F.col(f"{n}.{e}").cast("long").alias(f"{n}_{e}") for n in ("plus", "minus") for e in ("start", "end")])


@query(f"""WITH {sql.seqs()}, r AS (SELECT seq_id, r, substr(q, 16 * r::INT + 1, 16) AS p FROM seqs, (SELECT unnest(generate_series(0, 3)) AS r))
SELECT a.seq_id, (16 * a.r)::BIGINT AS start, count(*)::BIGINT AS n FROM r AS a JOIN r AS b ON a.seq_id = b.seq_id AND a.r <> b.r AND hamming(a.p, b.p) < 11 GROUP BY a.seq_id, a.r""")
def region_incompatibilities(spark, sf_dir):
    """How many of the other regions each region doesn't fit."""
    regions = tuple((16 * k, 16 * k + 16, 0) for k in range(4))
    spec = EnforceRegionsCompatibility(regions=regions, column_condition=lambda a, b: dna.n_differences(a, b) >= 11)
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.explode(F.arrays_zip(spec.locations(F.col("q")).alias("x"), spec.incompatibilities(F.col("q")).alias("y"))).alias("z"))
    return rows.select("seq_id", F.col("z.x.start").cast("long").alias("start"), F.col("z.y.n").cast("long").alias("n"))
