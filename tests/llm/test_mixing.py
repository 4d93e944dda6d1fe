import random
import re

import cases

from pyspark.sql import functions as F

from seqloom.llm import mixing
from seqloom.llm.common import with_groups


def targets(sizes, weights=(5, 2, 1), limit=3.0):
    """By resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, open_, rest = dict.fromkeys(order, 0.0), [s for s in order], float(sum(sizes.values()))
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(open_):
            if got[s] >= limit * sizes[s]:
                rest += got[s] - limit * sizes[s]
                got[s] = limit * sizes[s]
                open_.remove(s)
    return got


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums, taken, largest = {}, {}, {}
    for _, t, s in docs:
        sums[s] = sums.get(s, 0) + size(t)
        largest[s] = max(largest.get(s, 0), size(t))
    want = targets(sums)
    assert len(rows) == len(docs)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, size(t)) for i, t, _ in docs)
    by_id = {i: s for i, _, s in docs if i is not None}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            s = by_id[r["doc_id"]]
            assert r["source_size"] == sums[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
            taken[s] = taken.get(s, 0) + r["taken"]
    return taken, want, largest


def test_odd_cases(spark):
    check(mixing.mix(cases.docs(spark)).collect(), cases.TEXTS)
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_near_the_target_and_again(spark):
    rng = random.Random(3)
    docs = [(i, "w " * int(rng.paretovariate(1.3) * 20), "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 7)}") for i in range(3000)]
    rows = mixing.mix(cases.docs(spark, docs)).collect()
    taken, want, largest = check(rows, docs)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    again = mixing.mix(cases.docs(spark, docs).repartition(5)).collect()
    assert sorted(rows) == sorted(again)


def test_rows(spark):
    docs = cases.docs(spark)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["doc_id"] not in (None, 1)}
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert all(got.get(k, 0) == n for k, n in copies.items())


def test_unequal_odds(spark):
    """Longer documents are likelier to be taken, and no weight is lost: expected words are the target."""
    rng = random.Random(5)
    docs = [(i, "w " * rng.choice([2, 30, 500]), "a" if i % 3 else "b") for i in range(3000)]
    rows = mixing.mix(cases.docs(spark, docs)).collect()
    share = lambda n: sum(r["copies"] for r in rows if r["size"] == n and docs[r["doc_id"]][2] == "b") / sum(1 for r in rows if r["size"] == n and docs[r["doc_id"]][2] == "b")
    assert share(2) < share(30) < share(500)


def test_ranges_are_even(spark):
    """Of a source's documents with a rank, no range holds more than a few, whether the rest of the rate is near 0 or 1,
    and none of a source at the cap has a rank."""
    one = lambda rate, n: [(float(rate), n)]
    for classes in (one(0.0001, 1), one(0.999, 1), [(0.001, 1), (0.999, 2)], [(0.0001, 1), (0.5, 5), (0.9999, 9)]):
        entries = [F.struct(F.lit(c).alias("_class"), F.struct(F.lit(1).alias("n"), F.lit(0).alias("whole"), F.lit(p / (1 - p)).alias("odds")).alias("v")) for p, c in classes]
        rows = spark.range(200_000).select(F.col("id").cast("string").alias("_draw"), F.element_at(F.array(*[F.lit(1 << (c - 1)) for _, c in classes]), (F.col("id") % len(classes) + 1).cast("int")).alias("size"))
        rows = rows.withColumn("_classes", F.map_from_entries(F.array(*entries)))
        most = mixing.ranked(rows, 1, 1000).groupBy("_bucket").count().agg(F.max("count")).first()[0]
        assert most < 200_000 * 0.0025
    capped = [(i, "w w w", "a") for i in range(50)] + [(100 + i, "w " * 500, "b") for i in range(50)]
    rows = mixing.mix(cases.docs(spark, capped)).collect()
    assert all(r["copies"] == 3 for r in rows if r["doc_id"] < 50)


def test_clashing_names(spark):
    names = ["_row", "_key", "_draw", "_copies", "_rate", "_rank", "_bucket", "_classes", "_salt", "_last", "_cut", "col", "target"]
    docs = cases.docs(spark).select("doc_id", "text", "source", *[F.lit(f"own {n}").alias(n) for n in names])
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names)


def test_salted_join(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), "id")
    groups = spark.range(3).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = with_groups(rows, groups, "k", F.col("id")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["id"], r["v"]) for r in out) == [(i, i % 3 * 10) for i in range(1000)]


def test_many_sources(spark):
    """The same mix where the table of sources is too large to go to the rows."""
    rng = random.Random(8)
    docs = cases.docs(spark, [(i if i % 50 else None, "w " * rng.randint(0, 40), "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 60)}") for i in range(600)])
    key = lambda r: str(tuple(r))
    want, rows = sorted(mixing.mix(docs).collect(), key=key), sorted(mixing.mixed_rows(docs).collect(), key=key)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(mixing.mix(docs).collect(), key=key) == want and sorted(mixing.mixed_rows(docs).collect(), key=key) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(r["copies"] for r in want) == len(rows)
