import pytest
from pyspark.sql import functions as F

from seqloom import streaming
from seqloom.operators import homology, records, reports
from seqloom.operators import specs as S
from seqloom.operators.patterns import Pssm
from seqloom.sources import files, labels
from seqloom.sources.sequences import records as as_records

GENBANK = """LOCUS       plasmid 24 bp    DNA     circular UNK 01-JAN-1980
DEFINITION  .
FEATURES             Location/Qualifiers
     source          1..24
                     /organism="none"
     misc_feature    complement(4..12)
                     /label="@cds & ~gc(40-60%/50bp)"
                     /note="a ""quoted""
                     word"
ORIGIN
        1 atgcatgcat gcatgcatgc atgc
//
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nac\n>two\nGG\n\n")
    rows = {r["name"]: r for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows["one"]["q"] == "ACGTAC" and rows["one"]["description"] == "first" and rows["two"]["q"] == "GG" and len(rows) == 2
    files.write_fasta(spark.createDataFrame([("x", "ACGT" * 40), ("y", "A")], "name string, q string"), str(tmp_path / "out"))
    assert {r["name"]: r["q"] for r in files.load_records(spark, str(tmp_path / "out"), "fasta").collect()} == {"x": "ACGT" * 40, "y": "A"}


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK)
    r = files.load_records(spark, str(tmp_path / "a.gb")).first()
    assert (r["name"], r["q"], r["circular"]) == ("plasmid", "ATGC" * 6, True)
    f = r["features"][1]
    assert (f["start"], f["end"], f["strand"]) == (3, 12, -1) and f["qualifiers"]["note"] == ['a "quoted" word']
    files.write_genbank(files.read_genbank(spark, str(tmp_path / "a.gb")), str(tmp_path / "out"))
    again = files.read_genbank(spark, str(tmp_path / "out")).first()
    assert again["q"] == r["q"] and again["features"] == r["features"]
    constraints, objectives = labels.from_features([x.asDict() for x in r["features"]])
    assert constraints == [S.EnforceTranslation(place=(3, 12, -1))] and objectives[0].window == 50
    with pytest.raises(ValueError):
        files.load_records(spark, "x.unknown")


def test_motifs(spark, tmp_path):
    (tmp_path / "m.txt").write_text(">M1 one\nA [ 0 1 ]\nC [ 1 0 ]\nG [ 0 4 ]\nT [ 4 0 ]\n>M2 two\n0 5\n5 0\n0 0\n0 0\n")
    rows = files.read_motifs(spark, str(tmp_path / "m.txt")).collect()
    assert {(r["motif"], r["pos"], r["base"]): r["count"] for r in rows}["M1", 1, "G"] == 4 and len(rows) == 16
    assert files.parse_motifs("MEME version 4\n\nMOTIF x\nletter-probability matrix: alength= 4 w= 2 nsites= 10\n0.1 0.2 0.3 0.4\n1 0 0 0\n")[3] == ("x", 0, "T", 4.0)
    assert files.parse_motifs("ID y\nP0 A C G T\n01 1 2 3 4 N\n02 4 3 2 1 N\n//\n")[4] == ("y", 1, "A", 4.0)
    jaspar = [{"A": 0, "C": 0, "G": 0, "T": 9}, {"A": 0, "C": 0, "G": 9, "T": 0}]
    assert len(Pssm.from_counts(jaspar, "jaspar", relative_threshold=0.9).find("GGTGAA", 1)) == 1


def test_labels():
    p = labels.parse("@cds & ~gc(40-60%/50bp, boost=2) & @no(9xA|BsmBI_site)")
    assert [(x.role, x.name) for x in p] == [("constraint", "cds"), ("objective", "gc"), ("constraint", "no")] and p[2].arguments == (("9xA", "BsmBI_site"),)
    build = lambda text, place=(0, 9, 1), **k: labels.build(labels.parse(text)[0], place, **k)
    assert build("~gc(40-60%/50bp, boost=2)") == [S.EnforceGCContent(0.4, 0.6, None, 50, place=(0, 9, 1), boost=2)]
    assert build("@gc(mini:35%)") == [S.EnforceGCContent(0.35, place=(0, 9, 1))]
    assert build("@no(BsmBI_site, strand=both)") == [S.AvoidPattern("BsmBI_site", 0, place=(0, 9, 1))]
    assert build("@insert(BsmBI_site, occurences=2)")[0].occurences == 2
    assert build("@choice(ATG|GTG)")[0].choices == ("ATG", "GTG") and build("@tm(50-70C)")[0].maxi == 70
    assert build("@keep(max_edits:5)")[0].max_edits == 5 and build("~change")[0].amount_percent == 100 and build("@change(40%)")[0].minimum_percent == 40
    assert build("@all_unique_kmers(20, here)")[0].k == 20 and build("@sequence(ATNC)")[0].sequence == "ATNC"
    assert build("~optimize(e_coli, method=match_codon_usage)", usage={"e_coli": {"ATG": 1.0}})[0].kind == "MatchTargetCodonUsage"
    assert len(build("@primer(tmin=50, tmax=60)")) == 5
    with pytest.raises(TypeError):
        build("@unknown")
    with pytest.raises(ValueError):
        build("@sequence(ATT|ATC)")
    assert labels.find_label({"label": ["x"], "note": ["@cds"]}) == "@cds" and labels.find_label({}) is None
    assert labels.to_feature(S.AvoidPattern("ACG", place=(1, 5, 1)))["qualifiers"]["label"] == ["@AvoidPattern[1-5(+)](ACG)"]


def test_records(spark):
    rows = as_records(spark.createDataFrame([(1, "atccaaaaatcctttttatcc")], "seq_id long, q string"))
    assert len(records.annotated_occurrences(rows, "ATCC").first()["features"]) == 3
    ref = rows.withColumn("ref", F.lit("ATCGAAATTTCCTTTTTATCC"))
    got = records.annotated_differences(ref, "ref").first()["features"]
    assert [(f["start"], f["end"], f["qualifiers"]["label"]) for f in got] == [(3, 4, ["#G"]), (7, 9, ["#TT"])]
    assert records.annotated(rows, margin=2, label="x").first()["features"][0][1:3] == (2, 19)
    assert records.with_sequence(rows, F.lit("ACGT")).first()["q"] == "ACGT"


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "AAAAAAAAAA", "AACCAAAAGA")], "seq_id long, before string, after string")
    specs = {"gc": S.EnforceGCContent(0.4, 0.6), "part": S.AvoidPattern("AAA", place=(0, 5, 1), boost=2.0)}
    got = {r["spec"]: r for r in reports.before_after(rows, specs, with_boost=True).collect()}
    assert (got["gc"]["edits"], got["gc"]["edits_percent"], got["part"]["before"], got["part"]["after"], got["part"]["boost"]) == (3, 30.0, -3.0, 0.0, 2.0)
    assert [r["label"] for r in reports.edit_features(rows).orderBy("start").collect()] == ["AA=>CC", "A=>G"]
    reports.write_report(rows, specs, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/scores"), header=True).count() == 2
    assert len(spark.range(1).select(reports.truncated(F.lit("x" * 900))).first()[0]) <= 500


def test_homology(spark):
    a = spark.createDataFrame([(1, "TTTACCGTATTTGGATCATT"), (2, "CCCCCCCC")], "seq_id long, q string")
    b = spark.createDataFrame([(7, "ACCGTA"), (8, "GGATCA")], "seq_id long, q string")
    assert sorted(r["at"] for r in homology.exact_matches(a, b, 6).collect()) == [3, 12]
    assert {r["seq_id"]: r["score"] for r in homology.match_score(homology.exact_matches(a, b, 6), a).collect()} == {1: -2.0, 2: 0.0}
    for k in (0, 1, 2):
        want = S.AvoidMatches(6, ("ACCGTA", "GGATCA"), k).measure("TTTACCGTATTTGGATCATT")[0]
        got = homology.match_score(homology.near_matches(a, b, 6, k), a, 1 / (1 + F.col("mismatches")))
        assert abs({r["seq_id"]: r["score"] for r in got.collect()}[1] - want) < 1e-9
    s = homology.identity_segments(a, b, 4, 6).collect()
    assert {(r["subject_id"], r["start"], r["length"]) for r in s} == {(7, 3, 6), (8, 12, 6)}


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(i, "ACG" if i % 3 == 0 else "TTT", f"2024-01-01 00:0{i}:00") for i in range(6)], "seq_id long, q string, t string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = "seq_id long, q string, t timestamp"
    stream = streaming.read_sequences(spark, str(tmp_path / "in"), schema, 1)
    specs = {"acg": S.AvoidPattern("ACG", strand=1)}
    streaming.write(streaming.evaluate(stream, specs), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["seq_id"] for r in spark.read.parquet(str(tmp_path / "out")).where("all_pass").collect()) == [1, 2, 4, 5]
    rate = streaming.windowed_pass_rate(streaming.read_sequences(spark, str(tmp_path / "in"), schema), specs, "t", "3 minutes", "1 minute")
    q = rate.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["passed"]) for r in spark.table("rate").collect()) == [(3, 2), (3, 2)]


def test_command_line(spark, tmp_path):
    from seqloom.__main__ import main

    q = "ATGGAATTCGCATAA" + "CGTCTCAAGG" * 2
    text = files.genbank_text("rec", q, False, [{"type": "misc_feature", "start": 0, "end": 15, "strand": 1, "qualifiers": {"label": ["@cds"]}}, {"type": "misc_feature", "start": 0, "end": 35, "strand": 0, "qualifiers": {"label": ["@no(EcoRI_site) & @no(BsmBI_site)"]}}])
    (tmp_path / "a.gb").write_text(text)
    main([str(tmp_path / "a.gb"), str(tmp_path / "out"), "--mute", "--edits"])
    r = spark.read.json(str(tmp_path / "out/results")).first()
    assert r["status"] == "solved" and "GAATTC" not in r["q"] and "CGTCTC" not in r["q"] and "GAGACG" not in r["q"]
    assert spark.read.csv(str(tmp_path / "out/edits"), header=True).count() >= 3
    assert files.read_genbank(spark, str(tmp_path / "out/records")).first()["q"] == r["q"]


def test_table_function(spark):
    from seqloom.functions import udtf

    udtf.register(spark)
    rows = spark.sql("SELECT t.* FROM VALUES ('AACGTCTCAA'), (null) AS s(q), LATERAL find_matches(s.q, 'BsmBI_site', 0) AS t").collect()
    assert [tuple(r) for r in rows] == [(2, 8, 1)]


def test_circular_evaluations(spark):
    from seqloom.operators import batch

    rows = spark.createDataFrame([(1, "TTCAAAAAAAAAAGAA"), (2, "AAAAAAAA")], "seq_id long, q string")
    got = {(r["seq_id"], r["spec"]): r for r in batch.circular_evaluations(rows, {"site": S.AvoidPattern("EcoRI_site"), "part": S.AvoidPattern("TTC", 1, place=(0, 5, 1))}).collect()}
    assert got[1, "site"]["score"] == -1 and [tuple(x) for x in got[1, "site"]["locations"]] == [(-3, 3, 1), (13, 19, 1)]
    assert got[2, "site"]["passes"] and got[1, "part"]["score"] == -1


def test_solve_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACGTACGTTTTTGG"), (2, "ACG")], "seq_id long, q string")
    found = reports.optimize_with_report(rows, {"no": S.AvoidPattern("ACG"), "length": S.SequenceLengthBounds(5)}, {"gc": S.EnforceGCContent(target=0.5)}, str(tmp_path / "r"))
    assert {r["seq_id"]: r["status"] for r in found.collect()} == {1: "solved", 2: "no solution"}
    assert spark.read.csv(str(tmp_path / "r/failures"), header=True).count() == 1 and spark.read.csv(str(tmp_path / "r/scores"), header=True).count() == 3


def test_snapgene(spark, tmp_path):
    packet = lambda kind, body: bytes([kind]) + len(body).to_bytes(4, "big") + body
    xml = b'<Features><Feature name="gene" directionality="2" type="CDS"><Segment range="2-4"/><Segment range="6-7"/><Q name="note"><V text="@no(ACG)"/></Q></Feature></Features>'
    (tmp_path / "p.dna").write_bytes(packet(9, b"SnapGene" + b"\0" * 6) + packet(0, b"\x01acgtacgt") + packet(10, xml) + packet(99, b"other"))
    r = files.load_records(spark, str(tmp_path / "p.dna")).first()
    assert (r["name"], r["q"], r["circular"]) == ("p", "ACGTACGT", True)
    f = r["features"][0]
    assert (f["type"], f["start"], f["end"], f["strand"], f["qualifiers"]["note"]) == ("CDS", 1, 7, -1, ["@no(ACG)"])
    with pytest.raises(ValueError):
        files.parse_snapgene(b"\x09\x00\x00\x00\x04none", "x")


def test_fasta_with_a_mark_inside(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x a->b and >c\r\nACGT\r\n>y\nGG\n")
    rows = {r["name"]: r for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert set(rows) == {"x", "y"} and rows["x"]["description"] == "a->b and >c" and rows["x"]["q"] == "ACGT"


# Annotations as people write them.
ANNOTATIONS = [
    "@no(CG)", "~no(CG)", "@no(ATH, strand=both)", "@no(ATG.*TAA)", "@no(4x2mer)", "@no(BsmBI_site, strand=both)", "@keep", "~keep", "~change", "@insert(BsmBI_site)", "@insert(CG, occurences=3)",
    "@gc(45-55%)", "~gc(60%/100bp)", "@cds", "~CodonOptimize(e_coli)", "~use_best_codon(e_coli)", "~match_codon_usage", "~harmonize_rca(e_coli -> h_sapiens)", "@primer(tmin=50, tmax=70)", "@all_unique_kmers(k=15)",
    "@all_unique_kmers(k=15, here)", "@choice(ATG|TTA|CGT)", "@tm(50-70C)", "~tm(55C)", "@tm(50-70C) & @all_unique_kmers(k=15)", "@no_match(e_coli, 20)", "@no_match(e_coli, 20, mismatches=2)", "@sequence(KGTCTCNATGC)",
    "@cds & @no(CG) & @gc(45-55%)", "~gc(60%, boost=20)",
]


@pytest.mark.parametrize("text", ANNOTATIONS)
def test_annotations_are_specifications(text):
    usage = {n: {c: 0.1 + i % 5 / 10 for i, c in enumerate(sorted(S.GENETIC_CODE))} for n in ("e_coli", "h_sapiens", "")}
    made = [x for label in labels.parse(text) for x in labels.build(label, (3, 24, 1), usage=usage, subjects={"e_coli": ["ACGT" * 10]})]
    q = "CAATGCACACATCGATTCATCACTCATAAA"
    for x in made:
        if isinstance(x, (S.EnforceSequence, S.EnforceChoice)):
            continue
        score, places = x.bound(q).measure(q)
        assert isinstance(score, float) and x.place == (3, 24, 1) and isinstance(x.label(), str) and isinstance(x.short_label(), str)
    if "here" in text:
        assert made[0].within
    if "55C" in text:
        assert made[0].target == 55
    if "->" in text:
        assert dict(made[0].original_usage) == usage["e_coli"]


def test_command_line_with_usage(spark, tmp_path):
    from seqloom.__main__ import main

    feature = lambda a, b, label, strand=1: {"type": "misc_feature", "start": a, "end": b, "strand": strand, "qualifiers": {"label": [label]}}
    text = files.genbank_text("rec", "ATGAAAGCACCCTAA", False, [feature(0, 15, "@cds"), feature(0, 15, "~optimize(own)"), feature(0, 15, "@no(ClaimI_site)")])
    (tmp_path / "a.gb").write_text(text + "\n" + text)
    rows = ["species,codon,share"] + [f"own,{c},{0.9 if c in ('AAG', 'GCT', 'CCG') else 0.05}" for c in S.GENETIC_CODE]
    (tmp_path / "usage.csv").write_text("\n".join(rows))
    (tmp_path / "enzymes.csv").write_text("name,site\nClaimI,AAGGCC\n")
    main([str(tmp_path / "a.gb"), str(tmp_path / "out"), "--mute", "--usage", str(tmp_path / "usage.csv"), "--enzymes", str(tmp_path / "enzymes.csv")])
    solved = spark.read.parquet(str(tmp_path / "out/solved")).collect()
    assert [r["q"] for r in solved] == ["ATGAAGGCTCCGTAA"] * 2 and all(r["status"] == "solved" for r in solved)
    shown = files.read_genbank(spark, str(tmp_path / "out/records")).first()["features"]
    assert any("=>" in f["qualifiers"]["label"][0] for f in shown) and len(shown) > 3


def test_report_archive(spark):
    import io
    import zipfile

    rows = spark.createDataFrame([(1, "ACGT", "ACCT"), (2, "GGGG", "GGGG")], "seq_id long, before string, after string")
    with zipfile.ZipFile(io.BytesIO(reports.report_archive(rows, {"gc": S.EnforceGCContent(target=0.5)}))) as z:
        assert set(z.namelist()) == {"scores.csv", "edits.csv", "sequences.csv"} and "G=>C" in z.read("edits.csv").decode()
    with pytest.raises(ValueError):
        reports.report_archive(rows, {}, most=1)
