"""Both forms of each specification agree, and known values hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import batch, codons
from seqloom.operators import specs as S
from seqloom.operators.patterns import Pssm

RNG = random.Random(11)
SEQUENCES = ["".join(RNG.choice("ACGT") for _ in range(60)) for _ in range(25)] + ["A" * 60, "AC" * 30, "ATG" * 20, "ACGTTGCA" * 7 + "ACGT"]
USAGE = tuple((c, 1 / len(dna.synonyms(a)) + 0.01 * (i % 3)) for i, (c, a) in enumerate(dna.GENETIC_CODE.items()))
TARGET = "".join(random.Random(12).choice("ACGT") for _ in range(60))
MOTIF = Pssm.from_sequences(["TGCA", "TGCG", "AGCA"], "jaspar", relative_threshold=0.7)
SPECS = [
    S.AvoidPattern("ACG"), S.AvoidPattern("GAATTC"), S.AvoidPattern("2x2mer"), S.AvoidPattern("3xA", strand=1), S.AvoidPattern("CGW", place=(5, 50, -1)), S.AvoidPattern("GC[AT]{1,3}C"), S.AvoidPattern(MOTIF),
    S.EnforcePatternOccurence("ACG", occurences=2), S.EnforceGCContent(0.4, 0.6), S.EnforceGCContent(0.3, 0.7, window=12), S.EnforceGCContent(target=0.5, window=10, place=(6, 48, 0)), S.EnforceGCContent(0.3, 0.7, window=9, place=(3, 57, -1)),
    S.EnforceTerminalGCContent(10, 0.4, 0.6), S.UniquifyAllKmers(4), S.UniquifyAllKmers(5, both_strands=False, last=True), S.UniquifyAllKmers(4, place=(10, 50, 0)), S.AvoidHairpins(4, 20), S.AvoidHairpins(4, 20, place=(0, 40, 0)),
    S.AvoidChanges(5, target=TARGET), S.AvoidChanges(max_edits_percent=20, target=TARGET[10:40], place=(10, 40, 0)), S.AvoidChanges(1, target=TARGET, indices=(1, 5, 30)),
    S.EnforceChanges(target=TARGET, minimum=30), S.EnforceChanges(target=TARGET, amount=20), S.EnforceChanges(target=TARGET), S.EnforceSequence("NNRYSWKMBDHV", place=(4, 16, 0)), S.EnforceSequence("ARYS", place=(4, 8, -1)),
    S.EnforceChoice(("ACG", "TTN"), place=(3, 6, 0)), S.EnforceTranslation("ACDEFGHIKLMNPQRSTVWY"), S.EnforceTranslation("ACDEFGHIKL", place=(30, 60, -1)), S.EnforceTranslation("MCDEFGHIKLMNPQRSTVWY", "Bacterial"), S.AvoidStopCodons(), S.AvoidStopCodons(place=(0, 60, -1)),
    S.AvoidRareCodons(USAGE, 0.2), S.MaximizeCAI(USAGE), S.MatchTargetCodonUsage(USAGE), S.HarmonizeRCA(USAGE, tuple((c, 1.0) for c, _ in USAGE), TARGET), S.EnforceMeltingTemperature(50, 70), S.EnforceMeltingTemperature(40, 50, place=(0, 20, 0)),
    S.SequenceLengthBounds(10, 60), S.SequenceLengthBounds(61), S.AvoidMatches(6, ("ACGTTGCAAC",)), S.AvoidMatches(6, ("ACGTTGCAAC",), 1), S.AvoidHeterodimerization(("ACGTTGCA",), 5), S.AvoidHeterodimerization(),
    S.EnforceRegionsCompatibility(regions=((0, 10, 0), (10, 20, 0), (20, 30, 0)), condition=lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) >= 7, column_condition=lambda a, b: dna.n_differences(a, b) >= 7),
    S.CustomSpec(evaluate=lambda s: -s.count("GG")),
]
WITHOUT_PLACES = (S.AvoidMatches, S.AvoidHeterodimerization, S.EnforceRegionsCompatibility, S.CustomSpec)


@pytest.mark.parametrize("at", range(0, len(SPECS), 12))
def test_both_forms(spark, at):
    part = SPECS[at : at + 12]
    rows = spark.createDataFrame([(s,) for s in SEQUENCES], "q string").repartition(8)
    columns = [c for k, s in enumerate(part) for c in (s.score(F.col("q")).alias(f"s{k}"), s.locations(F.col("q")).alias(f"l{k}"))]
    for r in rows.select("q", *columns).collect():
        for k, s in enumerate(part):
            score, places = s.measure(r["q"])
            assert math.isclose(r[f"s{k}"], score, abs_tol=1e-9), (s, r["q"])
            if not isinstance(s, WITHOUT_PLACES):
                got = r[f"l{k}"] if r[f"l{k}"] is None else sorted((x[0], x[1]) for x in r[f"l{k}"])
                assert got == (None if places is None else sorted((a, b) for a, b, _ in places)), (s, r["q"])


def test_known_values(spark):
    hairpin = S.AvoidHairpins(3, 8).measure("ATTCAATGGGGGGGGGGGGGGGGGGGGGGGGGTAGCCTA")
    assert hairpin[0] < 0 and [x[0] for x in hairpin[1]] == [0, 32] and hairpin[1][1][1] == 39
    assert [S.SequenceLengthBounds(500, 800).measure("A" * n)[0] >= 0 for n in (750, 400, 1200)] == [True, False, False]
    assert S.EnforceChanges(target="A" * 200).wanted(200) == 200 and S.EnforceChanges(target="A" * 200, minimum_percent=5).wanted(200) == 10
    assert S.EnforcePatternOccurence("ACGTA", occurences=5).measure("T" * 50)[0] == -5
    assert S.EnforcePatternOccurence("CCGG", occurences=2).measure("CCGGT" * 5)[0] == -3
    assert S.AvoidMatches(6, ("ACCGTA", "GGATCA")).measure("TTTACCGTATTTGGATCATT")[0] == -2
    pattern = S.AvoidPattern("CGTCTCA", place=(4, 1624, -1)).localized(9, 10)
    assert pattern.place == (4, 16, -1)
    assert S.CodonOptimize(dict(USAGE), "match_codon_usage").kind == "MatchTargetCodonUsage" and len(S.AllowPrimer((0, 20, 1))) == 5
    with pytest.raises(ValueError):
        S.CodonOptimize({}, "other")


def test_batch(spark):
    rows = spark.createDataFrame([(1, "ACGACGTTTT"), (2, "GGGGGGGGGG"), (3, "")], "seq_id long, q string")
    specs = {"acg": S.AvoidPattern("ACG", strand=1, boost=2.0), "length": S.SequenceLengthBounds(5), "gc": S.EnforceGCContent(0, 0.5)}
    made = batch.evaluations(rows, specs)
    s = {r["seq_id"]: r for r in batch.summary(made).collect()}
    assert (s[1]["all_pass"], s[1]["failing_sum"], s[1]["total"]) == (False, -2.0, -4.0) and (s[2]["all_pass"], s[2]["total"]) == (False, -0.5)
    assert batch.passing(made).count() + batch.failing(made).where("score IS NOT NULL").count() == 9 and batch.optimal(made).count() >= 4
    b = {r["seq_id"]: r for r in batch.breaches(rows, specs).collect()}
    assert b[1]["acg"] == "0-3(+), 3-6(+)" and b[2]["acg"] == "" and b[3]["length"] == ""
    auto = {(r["seq_id"], r["spec"]): r["score"] for r in batch.autopassed(made, ["acg"]).collect()}
    assert auto[1, "acg"] == 1.0 and auto[2, "length"] == 0.0
    assert "FAIL  acg score -2.00" in batch.text_summary(made, failed_only=True).where("seq_id = 1").first()["summary"]
    assert batch.evaluations(rows.limit(0), specs).count() == 0


def test_usage(spark):
    rows = spark.createDataFrame([("ATGAAAAAG",), ("AAAAA",)], "q string")
    usage = codons.usage_dict(codons.usage_table(rows))
    assert len(usage) == 64 and usage["ATG"] == 1.0 and abs(usage["AAA"] - 2 / 3) < 1e-12 and usage["CCC"] == 0.0
    assert rows.select(codons.best_codons(F.col("q"), usage)).first()[0] == "ATGAAAAAA"
    table = {r["aa"]: r["codons"] for r in codons.back_translation_table(codons.genetic_code(spark)).collect()}
    assert table["*"] == ["TAA", "TAG", "TGA"] and codons.rare_codons(codons.usage_table(rows), 0.5).count() > 50
