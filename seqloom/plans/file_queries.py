"""Queries that write files and read them back, and queries on labels and other inputs of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import dna, udtf
from ..operators import homology, patterns, records
from ..operators.specs import AvoidBlastMatches, AvoidMatches, AvoidPattern, EnforceTranslation
from ..sources import files, labels
from ..sources.sequences import digest_sequences, records as as_records
from . import sql
from .common import r6
from .registry import query


def folder(spark, label: str) -> str:
    """A new folder that the executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def suppliers(spark, sf_dir, salts: str = "ab"):
    return digest_sequences(spark, sf_dir, salts, "supplier", "s_suppkey")


SUPPLIERS = sql.seqs("ab", "seqs", "supplier", "s_suppkey")


@query(f"WITH {SUPPLIERS} SELECT CAST(seq_id AS VARCHAR) AS name, q FROM seqs")
def fasta_round_trip(spark, sf_dir):
    at = folder(spark, "fasta")
    files.write_fasta(suppliers(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), "q"), at)
    return files.load_records(spark, at, "fasta").select("name", "q")


@query(f"WITH {SUPPLIERS}, {sql.kmers(3)} SELECT CAST(seq_id AS VARCHAR) AS name, q, i::BIGINT AS start, 'ACG' AS label FROM words WHERE w = 'ACG'")
def genbank_round_trip(spark, sf_dir):
    """Records with a feature for each place of a word, written as GenBank text and read back."""
    at = folder(spark, "genbank")
    rows = records.annotated_occurrences(as_records(suppliers(spark, sf_dir)), "ACG")
    files.write_genbank(rows.select(F.col("seq_id").cast("string").alias("name"), "q", F.lit(True).alias("circular"), "features"), at)
    read = files.load_records(spark, at, "genbank").where("circular").select("name", "q", F.explode("features").alias("x"))
    return read.select("name", "q", F.col("x.start").cast("long").alias("start"), F.col("x.qualifiers")["label"][0].alias("label"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def delimited_pairs(spark, sf_dir):
    at = folder(spark, "pairs")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string"), "n_name").write.csv(at, sep=";")
    return files.read_pairs(spark, at)


@query(f"WITH {SUPPLIERS}, {sql.kmers(3)} SELECT seq_id, (0 - count(*) FILTER (WHERE w = 'ACG' AND i BETWEEN 4 AND 57))::DOUBLE AS no_acg, {sql.r6('-(greatest(0.0::DOUBLE, 0.45 - any_value(' + sql.gc('q') + ')) + greatest(0.0::DOUBLE, any_value(' + sql.gc('q') + ') - 0.55))')} AS gc FROM words GROUP BY seq_id")
def label_scores(spark, sf_dir):
    """Specifications read from a record's features, and their scores."""
    made = [{"type": "misc_feature", "start": 4, "end": 60, "strand": 1, "qualifiers": {"label": ["@no(ACG)"]}}, {"type": "misc_feature", "start": 0, "end": 64, "strand": 0, "qualifiers": {"note": ["~gc(45-55%)"]}}, {"type": "CDS", "start": 0, "end": 9, "strand": 1, "qualifiers": {"label": ["@cds"]}}]
    (avoid,), (gc,) = labels.from_features(made)
    return suppliers(spark, sf_dir).select("seq_id", (avoid.score(F.col("q")) + F.lit(0.0)).alias("no_acg"), r6(gc.score(F.col("q"))).alias("gc"))


@query(f"WITH {SUPPLIERS}, {sql.kmers(4)} SELECT seq_id, i::BIGINT AS start, (i + 4)::BIGINT AS \"end\", 1::BIGINT AS strand FROM words WHERE w = 'CGTC' UNION ALL SELECT seq_id, i::BIGINT AS start, (i + 4)::BIGINT AS \"end\", -1::BIGINT AS strand FROM words WHERE w = 'GACG'")
def table_function_matches(spark, sf_dir):
    """Matches by the table function, in SQL."""
    udtf.register(spark)
    suppliers(spark, sf_dir).createOrReplaceTempView("seqloom_sequences")
    rows = spark.sql("SELECT seq_id, m.* FROM seqloom_sequences, LATERAL find_matches(q, 'CGTC', 0) AS m")
    return rows.select("seq_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "strand")])


_OWN = {"OwnI": "ACGWT", "OwnII": "GGRCC"}


@query(f"WITH {sql.seqs()}, {sql.kmers(5)} SELECT seq_id, count(*) FILTER (WHERE regexp_full_match(w, 'ACG[AT]T') OR regexp_full_match({sql.rc('w')}, 'ACG[AT]T'))::BIGINT AS owni, count(*) FILTER (WHERE regexp_full_match(w, 'GG[AG]CC') OR regexp_full_match({sql.rc('w')}, 'GG[AG]CC'))::BIGINT AS ownii FROM words GROUP BY seq_id")
def enzymes_from_a_table(spark, sf_dir):
    """Sites of enzymes that a table names."""
    patterns.add_enzymes(spark.createDataFrame(list(_OWN.items()), "name string, site string"))
    rules = {n.lower(): AvoidPattern(f"{n}_site") for n in _OWN}
    return digest_sequences(spark, sf_dir).select("seq_id", *[s.count(F.col("q")).alias(n) for n, s in rules.items()])


_MITO = ", ".join(f"('{c}', '{a}')" for c, a in dna.code_table("Vertebrate Mitochondrial").items())


@query(f"""WITH {sql.seqs()}, {sql.codons()}, code(c, aa) AS (VALUES {_MITO}), {sql.seqs('cd', 'oth')}, {sql.codons('oth', 'oc')}, a AS (SELECT seq_id, i, aa FROM codons JOIN code USING (c)), b AS (SELECT seq_id, i, aa FROM oc JOIN code USING (c))
SELECT a.seq_id, string_agg(a.aa, '' ORDER BY a.i) AS protein, (0 - count(*) FILTER (WHERE a.aa <> b.aa))::DOUBLE AS score, (0 - count(*) FILTER (WHERE a.aa = '*'))::DOUBLE AS stops FROM a JOIN b ON a.seq_id = b.seq_id AND a.i = b.i GROUP BY a.seq_id""")
def other_genetic_code(spark, sf_dir):
    """Proteins, translation and stop codons by another genetic code."""
    from ..operators.specs import AvoidStopCodons
    from .codon_queries import two

    code = "Vertebrate Mitochondrial"
    rows = two(spark, sf_dir).withColumn("wanted", dna.translate(F.col("other"), code=code))
    return rows.select("seq_id", dna.translate(F.col("q"), code=code).alias("protein"), (EnforceTranslation(F.col("wanted"), code=code).score(F.col("q")) + F.lit(0.0)).alias("score"), (AvoidStopCodons(code=code).score(F.col("q")) + F.lit(0.0)).alias("stops"))


@query(f"WITH {sql.seqs()}, {sql.CODE}, f AS (SELECT aa, min(c) AS c FROM code GROUP BY aa), {sql.codons()}, t AS (SELECT seq_id, string_agg(f.c, '' ORDER BY i) AS q FROM codons JOIN code USING (c) JOIN f ON f.aa = code.aa GROUP BY seq_id) SELECT seq_id, q AS back, true AS same_protein FROM t")
def back_translation(spark, sf_dir):
    """Each amino acid's first codon; and that codons drawn at random give the protein again."""
    rows = digest_sequences(spark, sf_dir).withColumn("protein", dna.translate(F.col("q")))
    return rows.select("seq_id", dna.back_translate(F.col("protein")).alias("back"), (dna.translate(dna.back_translate(F.col("protein"), seed=7)) == F.col("protein")).alias("same_protein"))


@query(f"WITH {sql.seqs()} SELECT seq_id, substr(q, 3 * i::INT + 1, 3) AS codon, i::BIGINT AS place FROM (SELECT seq_id, q, unnest(generate_series(0, 19)) AS i FROM seqs)")
def checked_codon_split(spark, sf_dir):
    rows = digest_sequences(spark, sf_dir).select("seq_id", F.posexplode(dna.checked_codons(F.substring("q", 1, 60))).alias("place", "codon"))
    return rows.select("seq_id", "codon", F.col("place").cast("long").alias("place"))


@query("SELECT count(*)::BIGINT AS n, true AS lengths, true AS letters, true AS again, true AS gc_near, true AS proteins FROM orders")
def random_sequences(spark, sf_dir):
    """Random sequences and proteins: of the right lengths and letters, the same again, and near the wanted share of G and C."""
    ids = digest_sequences(spark, sf_dir).select("seq_id")
    rows = ids.select(dna.random_dna(F.col("seq_id"), 50, seed=3, gc_share=0.7).alias("a"), dna.random_dna(F.col("seq_id"), 50, seed=3, gc_share=0.7).alias("b"), dna.random_protein(F.col("seq_id"), 12, seed=3).alias("p"))
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.length("a") == 50).alias("lengths"), F.bool_and(F.col("a").rlike("^[ACGT]*$")).alias("letters"), F.bool_and(F.col("a") == F.col("b")).alias("again"), F.abs(F.avg(dna.gc_fraction(F.col("a"))) - 0.7).between(0, 0.02).alias("gc_near"), F.bool_and(F.col("p").rlike("^M[ACDEFGHIKLNPQRSTVWY]{10}[*]$")).alias("proteins"))


_SUBJECTS = ("ACGTACGTTGCAAC", "GGGTTTCCCAAAGG")
_KNOWN = sorted({w for s in _SUBJECTS for t in (s, dna.revcomp(s)) for w in (t[i : i + 5] for i in range(len(t) - 4))})


@query(f"WITH {sql.seqs()}, {sql.kmers(5)} SELECT seq_id, (0 - count(*) FILTER (WHERE w IN ({', '.join(repr(w) for w in _KNOWN)})))::DOUBLE AS score, coalesce(min(i) FILTER (WHERE w IN ({', '.join(repr(w) for w in _KNOWN)})), -1)::BIGINT AS first FROM words GROUP BY seq_id")
def literal_matches(spark, sf_dir):
    """Words that some of a few sequences have, on either strand."""
    spec = AvoidMatches(5, _SUBJECTS)
    return digest_sequences(spark, sf_dir).select("seq_id", (spec.score(F.col("q")) + F.lit(0.0)).alias("score"), F.coalesce(F.get(spec.locations(F.col("q")), F.lit(0))["start"], F.lit(-1)).cast("long").alias("first"))


_ALIGNED = f"""{SUPPLIERS}, n0 AS (SELECT n_nationkey AS sid, translate(concat(md5(concat('ab', CAST(n_nationkey AS VARCHAR))), md5(concat('n', CAST(n_nationkey AS VARCHAR)))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS q FROM nation),
n AS (SELECT sid, 1 AS st, q FROM n0 UNION ALL SELECT sid, -1 AS st, {sql.rc('q')} AS q FROM n0),
{sql.kmers(6)}, sw AS (SELECT sid, st, j, substr(q, j::INT + 1, 6) AS w FROM (SELECT sid, st, q, unnest(generate_series(0, 58)) AS j FROM n)),
h AS (SELECT seq_id, sid, st, i, i - j AS dg FROM words JOIN sw USING (w)), r AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, sid, st, dg ORDER BY i) AS run FROM h),
sg AS (SELECT seq_id, max(i) - min(i) + 6 AS n FROM r GROUP BY seq_id, sid, st, dg, run)"""


def _nations(spark, sf_dir):
    from ..sources.sequences import HEX, HEX_BASES, table

    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq_id"), F.translate(F.concat(F.md5(F.concat(F.lit("ab"), key).cast("binary")), F.md5(F.concat(F.lit("n"), key).cast("binary"))), HEX, HEX_BASES).alias("q"))


@query(f"WITH {_ALIGNED}, t AS (SELECT seq_id, sum(n) AS n FROM sg GROUP BY seq_id) SELECT s.seq_id, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE -n::DOUBLE END AS score FROM seqs AS s LEFT JOIN t ON t.seq_id = s.seq_id")
def alignment_scores(spark, sf_dir):
    """Minus the bases in segments that are equal in a table of others, on either strand."""
    return homology.alignment_scores(suppliers(spark, sf_dir), _nations(spark, sf_dir), 6)


@query(f"WITH {_ALIGNED}, t AS (SELECT seq_id, sum(n) AS n FROM sg GROUP BY seq_id) SELECT s.seq_id, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE -n::DOUBLE END AS score FROM seqs AS s LEFT JOIN t ON t.seq_id = s.seq_id")
def alignment_specification(spark, sf_dir):
    """The same as a specification, of a few sequences that are parameters."""
    others = tuple(r["q"] for r in _nations(spark, sf_dir).orderBy("seq_id").collect())
    return suppliers(spark, sf_dir).select("seq_id", AvoidBlastMatches(others, 6).score(F.col("q")).alias("score"))


@query(f"WITH {_ALIGNED} SELECT DISTINCT seq_id, i::BIGINT AS at FROM h")
def indexed_matches(spark, sf_dir):
    """Exact matches against a bucketed table of words."""
    name = f"seqloom_words_{uuid.uuid4().hex}"
    homology.write_index(_nations(spark, sf_dir), name, 6, buckets=4, path=folder(spark, "index"))
    return homology.exact_matches_in(suppliers(spark, sf_dir), name, 6).select("seq_id", F.col("at").cast("long").alias("at"))




@query("SELECT 'N' || n_nationkey AS motif, p::BIGINT AS pos, b AS base, ((n_nationkey + 3 * p + strpos('ACGT', b)) % 7)::DOUBLE AS n FROM nation, (SELECT unnest(generate_series(0, 3)) AS p), (SELECT unnest(['A', 'C', 'G', 'T']) AS b)")
def motif_files(spark, sf_dir):
    """Position matrices written as text and read back."""
    at, key = folder(spark, "motifs"), F.col("n_nationkey")
    number = lambda b, p: ((key + 3 * p + "ACGT".index(b) + 1) % 7).cast("string")
    lines = [F.concat(F.lit(f"{b} [ "), F.concat_ws(" ", *[number(b, p) for p in range(4)]), F.lit(" ]")) for b in "ACGT"]
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws("\n", F.concat(F.lit(">N"), key.cast("string"), F.lit(" x")), *lines).alias("value")).write.text(at)
    return files.read_motifs(spark, at).select("motif", F.col("pos").cast("long").alias("pos"), "base", F.col("count").alias("n"))


_PRIMERS = ("ACGTTGCATG", "GGCCATTA", "TTGACCGT")


def _duplex_sql() -> str:
    from ..operators.specs import ALL_STACKS, DNA_MOLAR, SALT_MOLAR, TERMINAL

    stacks = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in ALL_STACKS.items())
    ends = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in TERMINAL.items())
    others = ", ".join(f"({k}, '{dna.revcomp(p)}')" for k, p in enumerate(_PRIMERS))
    return f"""WITH {sql.seqs('a', 'seqs', 'supplier', 's_suppkey')}, o(k, r) AS (VALUES {others}), st(w, h, s) AS (VALUES {stacks}), en(b, h, s) AS (VALUES {ends}),
c AS (SELECT seq_id, i, substr(q, i::INT + 1, 2) AS w FROM (SELECT seq_id, q, unnest(generate_series(0, 30)) AS i FROM seqs)), x AS (SELECT k, j, substr(r, j::INT + 1, 2) AS w FROM (SELECT k, r, unnest(generate_series(0, length(r) - 2)) AS j FROM o)),
m AS (SELECT seq_id, k, i, i - j AS d, c.w AS w FROM c JOIN x ON c.w = x.w), r AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, k, d ORDER BY i) AS run FROM m),
t AS (SELECT seq_id, k, sum(st.h) AS h, sum(st.s) AS s, count(*) AS n, arg_min(left(r.w, 1), i) AS a, arg_max(right(r.w, 1), i) AS b FROM r JOIN st ON st.w = r.w GROUP BY seq_id, k, d, run),
u AS (SELECT seq_id, k, greatest(0.0::DOUBLE, max(1000 * (t.h + e.h + f.h) / (t.s + e.s + f.s + 0.368 * n * ln({SALT_MOLAR}::DOUBLE) + 1.987 * ln({DNA_MOLAR}::DOUBLE / 4)) - 273.15)) AS t FROM t JOIN en AS e ON e.b = t.a JOIN en AS f ON f.b = t.b GROUP BY seq_id, k)
SELECT s.seq_id, {sql.r6(f'5.0 - coalesce(max(t), 0) - 0.001 * coalesce(sum(t), 0) / {len(_PRIMERS)}')} AS score FROM seqs AS s LEFT JOIN u ON u.seq_id = s.seq_id GROUP BY s.seq_id"""


@query(_duplex_sql())
def heterodimer_table_scores(spark, sf_dir):
    """How strongly candidates pair with a table of primers, by a join on pairs of bases."""
    others = spark.createDataFrame(list(enumerate(_PRIMERS)), "seq_id long, q string")
    return homology.heterodimer_scores(suppliers(spark, sf_dir, "a"), others).select("seq_id", r6(F.col("score")).alias("score"))


@query(_duplex_sql())
def heterodimer_specification(spark, sf_dir):
    """The same as a specification, of primers that are parameters."""
    from ..operators.specs import AvoidHeterodimerization

    return suppliers(spark, sf_dir, "a").select("seq_id", r6(AvoidHeterodimerization(_PRIMERS, 5.0).score(F.col("q"))).alias("score"))
