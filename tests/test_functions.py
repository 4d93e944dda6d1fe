import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna, parsing
from seqloom.operators import intervals as iv
from seqloom.operators.patterns import Pssm, iupac_regex, iupac_variants, pattern


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pattern_texts():
    assert pattern("6xT").expression == "TTTTTT"
    assert pattern("BsmBI_site").expression == "CGTCTC" and pattern("EcoRI_site").palindromic
    assert pattern("5x2mer").expression == r"([ATGC]{2})\1{4}"
    assert iupac_regex("ATW") == "AT[ATW]" and iupac_variants("AR") == ["AA", "AG"]


def test_gc_texts():
    assert parsing.gc_parameters("35%") == {"mini": None, "maxi": None, "target": 0.35, "window": None}
    assert parsing.gc_parameters("35%/20bp") == {"mini": None, "maxi": None, "target": 0.35, "window": 20}
    assert parsing.gc_parameters("5-55%") == {"mini": 0.05, "maxi": 0.55, "target": None, "window": None}
    assert parsing.gc_parameters("5-55%/400bp") == {"mini": 0.05, "maxi": 0.55, "target": None, "window": 400}
    with pytest.raises(ValueError):
        parsing.gc_parameters("high")
    assert parsing.temperature_range("50-70C") == (50, 70) and parsing.percentage("40%") == 40
    assert parsing.location("-3-3(+)") == (-3, 3, 1) and parsing.location("5-10") == (5, 10, 1) and parsing.location("5-10(-)") == (5, 10, -1)
    assert [parsing.number(x) for x in ("3", "3.5", "abc")] == [3, 3.5, "abc"]
    assert parsing.rounded({"a": 1.234, "b": [2.345]}, 1) == {"a": 1.2, "b": [2.3]}


def test_translation(spark):
    q = F.lit("GTGATTGTGTGA")
    assert one(spark, dna.translate(q), dna.translate(q, "Bacterial")) == ("VIV*", "MIV*")
    p = F.lit("MAWWL*")
    got = one(spark, dna.translate(dna.back_translate(p)), dna.translate(dna.back_translate(p, seed=3)))
    assert got[0] == got[1] == "MAWWL*"


def test_scalars(spark):
    got = one(spark, dna.reverse_complement(F.lit("ATGCN")), dna.part(F.lit("AACCGGTT"), 1, 4, -1), dna.gc_fraction(F.lit("GGAA")), dna.gc_fraction(F.lit("")), dna.kmers(F.lit("ACGT"), 3), dna.kmers(F.lit("AC"), 3), dna.codons(F.lit("ACGTT")), dna.letters(F.lit("")))
    assert tuple(got) == ("NGCAT", "GGT", 0.5, None, ["ACG", "CGT"], [], ["ACG"], [])
    text = one(spark, dna.location_text(F.lit(5), F.lit(10), F.lit(1)), dna.location_text(F.lit(5), F.lit(10), F.lit(0)), dna.parse_location(F.lit("5-10(-)")), dna.parse_location(F.lit("x")))
    assert tuple(text) == ("5-10(+)", "5-10", (5, 10, -1), None)
    assert one(spark, dna.score_text(F.lit(-3.0)))[0] == "       -3" and one(spark, dna.score_text(F.lit(-0.123456)))[0].strip() == "-0.12"
    made = one(spark, dna.random_dna(F.lit(1), 50), dna.random_dna(F.lit(1), 50), dna.random_protein(F.lit(1), 20))
    assert made[0] == made[1] and len(made[0]) == 50 and set(made[0]) <= set("ACGT") and made[2][0] == "M" and made[2][-1] == "*" and "M" not in made[2][1:]


def test_lengths_that_differ(spark):
    with pytest.raises(Exception, match="different lengths"):
        one(spark, dna.n_differences(F.lit("AC"), F.lit("A")))
    with pytest.raises(Exception, match="multiple of 3"):
        one(spark, dna.checked_codons(F.lit("ACGT")))


def test_intervals(spark):
    loc = iv.location
    got = one(spark, iv.subdivided(loc(0, 10), 3), iv.subdivided(loc(4, 4), 3), iv.overlap(loc(0, 5, 1), loc(5, 9)), iv.windows_overlap(loc(0, 5), loc(5, 9)), iv.overlap(loc(0, 5, 1), loc(3, 9)))
    assert tuple(got) == ([(0, 3, 0), (3, 6, 0), (6, 9, 0), (9, 10, 0)], [], None, (5, 5, 0), (3, 5, 1))
    got = one(spark, iv.merged(F.array(loc(6, 9), loc(0, 5, 1), loc(4, 6), loc(6, 7))), iv.merged(iv.no_locations()), iv.indices(loc(2, 5, -1)), iv.indices(loc(2, 2)))
    assert tuple(got) == ([(0, 6, 1), (6, 9, 0)], [], [4, 3, 2], [])
    flags = F.array(*[F.lit(i in (1, 4, 5, 6, 9, 10)) for i in range(12)])
    got = one(spark, iv.segments(flags), iv.grouped(F.array(*map(F.lit, (1, 2, 9, 10, 14))), 5), iv.grouped(F.array(*map(F.lit, (1, 2, 9, 10, 14))), 50, 10))
    assert tuple(got) == ([(1, 2, 0), (4, 7, 0), (9, 11, 0)], [[1, 2], [9, 10, 14]], [[1, 2, 9, 10], [14]])
    got = one(spark, iv.recentred(F.array(loc(97, 103, 1), loc(10, 20), loc(150, 155)), F.lit(100)), iv.codon_location(loc(0, 9, -1), F.lit(0)), iv.codon_location(loc(0, 9, 1), F.lit(2)))
    assert tuple(got) == ([(-3, 3, 1), (50, 55, 0)], (6, 9, -1), (6, 9, 1))
    rows = [r[0] for r in spark.createDataFrame([((3, 5, 0),), ((3, 4, 1),), ((1, 9, -1),)], "x struct<start:int,end:int,strand:int>").orderBy("x").collect()]
    assert rows == [(1, 9, -1), (3, 4, 1), (3, 5, 0)]


def test_motifs():
    counts = [{"A": 0, "C": 1, "G": 0, "T": 4}, {"A": 1, "C": 0, "G": 4, "T": 0}]
    p = Pssm.from_counts(counts, "jaspar", relative_threshold=0.9)
    assert [x[:2] for x in p.find("AATGAA", 1)] == [(2, 4)] and p.find("TG", 1) == [(0, 2, 1)]
    assert Pssm.from_sequences(["TG", "TG"], threshold=3.9).find("CATG", 1) == [(2, 4, 1)]
