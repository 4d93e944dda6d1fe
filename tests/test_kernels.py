"""Arrow kernels against the plain measure of each specification, and local forms against whole ones."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna, kernels
from seqloom.operators import homology
from seqloom.operators import intervals as iv
from seqloom.operators import specs as S
from seqloom.operators.patterns import add_enzymes, pattern


def shares(n):
    return tuple(sorted({c: (i % n) / n for i, c in enumerate(dna.GENETIC_CODE)}.items()))


def text(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


SUBJECTS = ("ACGTTGCA", "GGNTTACC")
SCANNED = [S.EnforceGCContent(0.3, 0.6, window=10), S.EnforceGCContent(0.3, 0.6, window=10, place=(5, 40, -1)), S.UniquifyAllKmers(4), S.UniquifyAllKmers(3, both_strands=False, last=True), S.UniquifyAllKmers(4, place=(3, 30, 0)), S.UniquifyAllKmers(4, place=(3, 30, 0), reference=(10, 50, 0)), S.AvoidHairpins(4, 15), S.AvoidMatches(5, SUBJECTS)]


def test_scans(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 300)
    rng = random.Random(3)
    rows = [text(rng, rng.randint(0, 90), "ACGT" if rng.random() < 0.8 else "ACGTN") for _ in range(60)] + [None, "", "A" * 50, "AT" * 40, text(rng, 30) * 2]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, q string").repartition(3)
    for spec in SCANNED:
        got = {r["i"]: r for r in df.select("i", spec.score(F.col("q")).alias("s"), spec.locations(F.col("q")).alias("p")).collect()}
        for i, s in enumerate(rows):
            if s is None:
                assert got[i]["s"] is None, spec
                continue
            if spec.place and len(s) < 55:
                continue
            score, places = spec.measure(s)
            assert got[i]["s"] == pytest.approx(score), (spec, s)
            assert sorted((p["start"], p["end"]) for p in got[i]["p"]) == sorted(p[:2] for p in places), (spec, s)


LOCAL = [
    S.AvoidPattern("ACG"), S.EnforceGCContent(0.4, 0.6, window=8), S.EnforceGCContent(target=0.5), S.EnforceGCContent(target=0.5, place=(5, 50, 0)), S.UniquifyAllKmers(4), S.UniquifyAllKmers(4, place=(10, 40, 0)),
    S.UniquifyAllKmers(4, place=(10, 40, 0), reference=(0, 30, 0)), S.UniquifyAllKmers(4, place=(10, 40, 0), reference="here"), S.AvoidHairpins(3, 12), S.AvoidHairpins(3, 12, place=(6, 51, -1)), S.AvoidMatches(4, ("ACGTAC",)),
    S.MaximizeCAI(shares(7)), S.MaximizeCAI(shares(7), place=(3, 48, -1)), S.MatchTargetCodonUsage(shares(5), place=(3, 48, 1)), S.MatchTargetCodonUsage(shares(3), place=(3, 48, -1)), S.EnforceTranslation(place=(3, 48, 1)),
    S.EnforceTranslation(place=(3, 48, -1)), S.AvoidStopCodons(place=(0, 60, 1)), S.AvoidChanges(max_edits=3), S.AvoidChanges(max_edits=3, place=(4, 30, 0)), S.HarmonizeRCA(shares(5), shares(3), place=(6, 54, -1)), S.AvoidRareCodons(shares(5), 0.5),
]


@pytest.mark.parametrize("spec", LOCAL, ids=lambda s: s.label())
def test_local_forms_differ_as_the_whole(spec):
    rng = random.Random(8)
    for _ in range(40):
        s = text(rng, 60)
        bound = spec.bound(s if isinstance(spec, S.EnforceTranslation) else text(rng, 60))
        a = rng.randint(0, 55)
        b = rng.randint(a + 1, min(60, a + 9))
        part = bound.localized(a, b, s)
        at = lambda x, part=part: part.measure(x)[0] if part else 0.0
        for _ in range(4):
            other = s[:a] + text(rng, b - a) + s[b:]
            assert bound.measure(other)[0] - bound.measure(s)[0] == pytest.approx(at(other) - at(s))


def test_scans_are_linear():
    rng, took = random.Random(1), {}
    scans = {"gc": lambda r: kernels.grouped_places(r, kernels.window_breaches(r, 20, 0.45, 0.55)[0], 20, 50), "hairpins": lambda r: kernels.hairpins(r, 20, 200), "words": lambda r: kernels.repeated(r, 9, True, False)}
    for n in (400_000, 800_000):
        rows = next(kernels.slices(pa.array([text(rng, n)])))
        for name, scan in scans.items():
            runs = []
            for _ in range(3):
                start = time.perf_counter()
                scan(rows)
                runs.append(time.perf_counter() - start)
            took[name, n] = min(runs)
    assert all(took[name, 800_000] <= 3.5 * took[name, 400_000] for name in scans), took


def test_folds_of_long_arrays(spark):
    """Results that are longer than a piece of what a fold gathers."""
    rng = np.random.default_rng(2)
    at = sorted(set(rng.integers(0, 30_000, 3000).tolist()))
    df = spark.createDataFrame([(at, [(int(x), int(x) + 5, 0) for x in at])], f"p array<int>, l {iv.LOCATIONS}")
    r = df.select(iv.merged(F.col("l")).alias("m"), iv.grouped(F.col("p"), 9, 40).alias("g"), iv.grouped_segments(F.col("l"), 9).alias("s")).first()
    merged, groups, segments = [], [], []
    for x in at:
        if merged and x < merged[-1][1]:
            merged[-1][1] = x + 5
        else:
            merged.append([x, x + 5])
        if groups and x - groups[-1][-1] < 9 and x - groups[-1][0] < 40:
            groups[-1].append(x)
        else:
            groups.append([x])
        if segments and x - segments[-1][1] + 5 < 9:
            segments[-1][1] = x + 5
        else:
            segments.append([x, x + 5])
    assert len(merged) > iv.CHUNK and [[x["start"], x["end"]] for x in r["m"]] == merged
    assert [list(g) for g in r["g"]] == groups and [[x["start"], x["end"]] for x in r["s"]] == segments


def test_unknown_enzymes_are_errors(spark):
    with pytest.raises(ValueError, match="no enzyme"):
        pattern("NoSuchI_site")
    with pytest.raises(ValueError, match="no enzyme"):
        S.AvoidPattern("NoSuchI_site").measure("ACGT")
    assert pattern("BspEI_site").find("TCCGGATCCGGA") == [(0, 6, 1), (6, 12, 1)]
    add_enzymes(spark.createDataFrame([("TestI", "ACGW")], "name string, site string"))
    assert pattern("TestI_site").size == 4
    with pytest.raises(ValueError, match="no word"):
        add_enzymes({"BadI": "12"})


def test_genetic_codes():
    mito = S.EnforceTranslation(place=(0, 9, 1), code="Vertebrate Mitochondrial").bound("ATAAGATGA")
    assert mito.protein == "M*W" and mito.measure("ATGAGGTGG")[0] == 0 and mito.measure("ATTAGGTGG")[0] == -1
    assert S.AvoidStopCodons(code="Ciliate Nuclear").measure("TAATAGTGA")[0] == -1
    own = tuple((dna.GENETIC_CODE | {"AAA": "*"}).items())
    assert S.AvoidStopCodons(code=own).measure("AAATAA")[0] == -2
    with pytest.raises(ValueError, match="no such genetic code"):
        dna.code_table("Martian")


def test_hot_words_are_dealt(spark, monkeypatch):
    """The same result, whether a word's pairs are one task's or many tasks' work."""
    monkeypatch.setattr(homology, "MOST", 3)
    a = spark.createDataFrame([(1, "A" * 40), (2, "ACGTACGTAC"), (3, "GGGTTT")], "seq_id int, q string")
    b = spark.createDataFrame([(7, "A" * 30), (8, "TTACGTACGG")], "seq_id int, q string")
    dealt = sorted(map(tuple, homology.identity_segments(a, b, 4).collect())), sorted(map(tuple, homology.near_matches(a, b, 6, 1).collect()))
    monkeypatch.setattr(homology, "MOST", 10_000)
    plain = sorted(map(tuple, homology.identity_segments(a, b, 4).collect())), sorted(map(tuple, homology.near_matches(a, b, 6, 1).collect()))
    assert dealt == plain and len(plain[0]) > 30


def test_alignments():
    spec = S.AvoidBlastMatches(("AAACCCGGGTTTACGACG",), 8)
    assert spec.measure("T" * 30)[0] == 1
    score, places = spec.measure("TT" + "CCCGGGTTTACG" + "AAAAA")
    assert score == -22 and places == [(2, 11, 0), (2, 15, 0)]  # the other strand, and this one
    with pytest.raises(ValueError):
        S.AvoidBlastMatches(("ACGT",), 2, perc_identity=80).measure("ACGT")


def test_labels_of_specifications():
    assert S.EnforceGCContent(0.3, 0.7, window=50).breach_label() == "GC < 30% or GC > 70%/50bp"
    assert S.AvoidPattern("9xA").short_label() == "No 9xA" and S.UniquifyAllKmers(9).breach_label() == "9-mers that repeat"
    assert S.AvoidPattern("9xA").as_passive().passive and not S.AvoidPattern("9xA").passive


def test_hooks_of_the_search():
    from seqloom.operators.solver import Problem

    def fill(spec, problem):
        problem.sequence = "G" * len(problem.sequence)
        return True

    p = Problem("ACGTACGT", [S.CustomSpec(evaluate=lambda s: -s.count("A"), name="no A", resolver=fill)])
    p.resolve()
    assert p.sequence == "GGGGGGGG"
    p = Problem("ACGTACGT", [], [S.CustomSpec(evaluate=lambda s: s.count("G"), name="G", optimizer=fill), S.MaximizeCAI(shares(3), passive=True, place=(0, 6, 1))])
    p.optimize()
    assert p.sequence == "GGGGGGGG"


def _equal_runs(a, b, least):
    """Of a and b: the places that least bases or more are equal from, and not the base before."""
    for i in range(len(a)):
        for j in range(len(b)):
            if not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    yield i, j, n


def test_segments_in_blocks(spark, monkeypatch):
    """As compared base by base, with one block of subjects or many, odd letters, empty and short rows, ids of any type. Neither
    places nor pairs are shuffled: the plan has no window, join or rows for places."""
    rng = random.Random(8)
    q = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    a = [*((f"s{i}", q(rng.randrange(60))) for i in range(60)), ("n", q(40, "ACGTN")), ("run", "A" * 50), ("none", None), ("", "")]
    b = [*((i, q(rng.randrange(40), "ACGTN" if i % 5 == 0 else "ACGT")) for i in range(30)), (50, "A" * 30), (51, None), (52, "x" * 9 + "ACGTACGT")]
    b += [(53, a[0][1]), (54, a[1][1] + "G")]
    left, right = spark.createDataFrame(a, "seq_id string, q string"), spark.createDataFrame(b, "seq_id int, q string")
    names = ("seq_id", "subject_id", "start", "subject_start", "length")
    for word, least, block in ((3, 4, 1 << 22), (5, 0, 60), (2, 7, 1 << 22), (12, 13, 1 << 22), (5, 6, 8)):
        monkeypatch.setattr(homology, "BLOCK", block)
        want = sorted((x, y, *r) for x, p in a for y, s in b if p and s for r in _equal_runs(p, s, max(word, least)))
        found = homology.identity_segments(left, right, word, least)
        assert want and sorted(map(tuple, found.select(*names).collect())) == want
    monkeypatch.setattr(homology, "BLOCK", 1 << 22)
    plan = homology.identity_segments(left, right, 5, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "regexp_extract_all" not in plan
    assert homology.identity_segments(left, right.limit(0), 5, 6).count() == homology.identity_segments(left.limit(0), right, 5, 6).count() == 0


def test_near_matches_by_words(spark, monkeypatch):
    """As compared word by word, by lists of near words and by parts of words; places meet one row at most."""
    rng = random.Random(9)
    q = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    a = [*((i, q(rng.randrange(50))) for i in range(30)), (40, q(60, "ACGTN")), (41, "ACGNNACGTA"), (42, None), (43, "")]
    b = [*((i, q(rng.randrange(9, 20))) for i in range(4)), (50, q(20, "ACGTN")), (51, "TACGNNACGTAC"), (52, "GRAC"), (53, None)]
    left, right = spark.createDataFrame(a, "seq_id int, q string"), spark.createDataFrame(b, "seq_id int, q string")
    for k, mismatches in ((6, 0), (6, 1), (7, 2), (4, 1)):
        words = {s[j : j + k] for _, s in b if s for j in range(len(s) - k + 1)}
        words |= {dna.revcomp(w) for w in words}
        least = lambda w: min(sum(x != y for x, y in zip(w, s, strict=True)) for s in words)  # noqa: B023, E731
        want = sorted((i, j, n) for i, s in a if s for j in range(len(s) - k + 1) if (n := least(s[j : j + k])) <= mismatches)
        for near in (1000, 0):
            monkeypatch.setattr(homology, "NEAR", near)
            assert want and sorted(map(tuple, homology.near_matches(left, right, k, mismatches).collect())) == want
    monkeypatch.setattr(homology, "NEAR", 1000)
    plain = left.where("seq_id < 40")
    found = homology.near_matches(plain, right, 6, 1)._jdf.queryExecution()
    assert found.optimizedPlan().toString().count("Join") == 1 and "BroadcastHashJoin" not in found.sparkPlan().toString()
