"""Each stage against a plain form of it, on what the stage before it kept."""

import os
import re

import cases
import public_tokenizers
from pyspark.sql import functions as F
from test_minhash import brute
from test_mixing import targets
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import quality_rules
from seqloom.llm.common import materialized, table

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, rows(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialized(stage(spark, docs, SF), "test")
        if name != names[-1]:
            assert docs.columns == columns
            now = rows(docs)
        if name == "quality_rules":
            stats = {i: quality_rules.text_stats(t) for i, t, _ in before}
            assert now == [r for r in before if stats[r[0]][0] >= 20 and 100 * stats[r[0]][4] <= 30 * stats[r[0]][0]]
        elif name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
            assert set(now) <= set(before)
            kept = {r[0] for r in now}
            right = [(r[0] in kept) == bool(labels[r[0]]) for r in before if r[0] in labels]
            assert sum(right) >= 0.9 * len(right)
        elif name == "near_dedup":
            found = brute(before, 5, 80)
            assert now == [r for r in before if found[r[0]][1] == r[0]]
        elif name == "mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sums, largest, taken = {}, {}, {}
            for _, t, s in before:
                sums[s], largest[s] = sums.get(s, 0) + size(t), max(largest.get(s, 0), size(t))
            for _, t, s in now:
                taken[s] = taken.get(s, 0) + size(t)
            assert set(now) <= set(before) and all(now.count(r) <= 3 for r in set(now))
            assert all(abs(taken.get(s, 0) - want) <= largest[s] / 2 + 1 for s, want in targets(sums).items())
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in before)
            assert sorted((r["doc_id"], r["n_tokens"]) for r in docs.collect()) == want
        before = now
    assert os.path.exists(corpus_pipeline.__file__)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and columns with the stages' own names go through every stage."""
    good = [" ".join(f"w{(i * 7 + k * (i % 5 + 1)) % 900}" for k in range(60 + i)) + "." for i in range(40)]
    whole = " ".join(f"u{i}" for i in range(30_000))
    rows = [*cases.TEXTS, *((100 + i, t, "a" if i % 3 else None) for i, t in enumerate(good)), (100, good[0], None), (200, good[5], "b"), (201, good[6] + " end", "b"), (300, whole, "c"), (301, whole + " end", "c")]
    docs = cases.docs(spark, rows).withColumn("_row", F.lit("own")).withColumn("_key", F.lit("own")).withColumn("_host", F.lit("own"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, int(i != 3), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = materialized(stage(spark, docs, str(tmp_path)), "odd")
        if name == "bpe":
            assert docs.count() == len(before)
            break
        now = docs.collect()
        assert docs.columns[-3:] == ["_row", "_key", "_host"] and all((r["_row"], r["_key"], r["_host"], r["_text"]) == ("own", "own", "own", "clash") for r in now)
        ids = sorted(r["doc_id"] for r in now)
        if name == "quality_rules":
            assert ids == sorted([*range(100, 140), 100, 200, 201, 300, 301])
        if name == "near_dedup":
            assert len(ids) == len(set(ids)) and not {200, 201, 301} & set(ids)
        before = now
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(before)
    left = set(os.listdir(shared)) - there
    assert len(left) == 1 and left.pop().startswith("seqloom-stage-bpe")


def test_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
