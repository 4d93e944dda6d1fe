import random
import unicodedata
import zlib

import cases
import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import quality_classifier as q
from seqloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = q.score(docs, q.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], want[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in want]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = q.kept_rows(docs, q.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_expression_is_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3)).round(2)
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4)).astype(float)
    model = q.fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 60
    want = 1 / (1 + np.exp(-(model.bias + sum(w * q.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True)))))
    got = [r[0] for r in spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").select(model.score(F.struct("a", "b", "c"))).collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.97


def test_odd_cases(spark):
    docs = cases.docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, None, 0), (None, 1, 0), (9, 5, 1)], "doc_id long, quality int, toxic int")
    rows = q.score(docs, q.fit(docs, labels)).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in q.score(docs, q.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert q.score(cases.empty(spark), q.fit(cases.empty(spark), labels)).count() == 0


def test_sample_is_bounded(spark):
    """Whatever the number of rows with equal ids, one text an id and max_rows at most leave."""
    from seqloom.llm.sampling import labelled

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    docs = cases.docs(spark, [(i, f"text {k}", "a") for i in ids for k in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    rows = labelled(docs, labels, "quality", 2).collect()
    assert len(rows) == 2
    assert sorted(rows) == sorted(labelled(docs.repartition(7), labels, "quality", 2).collect())


def test_kept_rows_of_odd_cases(spark):
    """Rows stay as they are, whatever their columns are called; empty texts and nulls have a score as all others."""
    from pyspark.sql import functions as F

    model = q.RuleModel(["log_words"], [((0, True, 0.0),)], [5.0], -1.0)
    docs = cases.docs(spark).withColumn("held_out", F.lit("own"))
    out = q.kept_rows(docs, model)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 3, 4, 5]
    assert q.kept_rows(cases.empty(spark), model).count() == 0


def plain(text):
    """The statistics, one by one."""
    words = [w.decode() for w in text.encode().split()]
    n, chars = max(1, len(words)), max(1, len(text))
    count = lambda test: sum(map(test, text))
    return {
        "log_words": np.log1p(len(words)), "chars_per_word": len(text) / n, "upper_share": count(lambda c: unicodedata.category(c) == "Lu") / chars, "digit_share": count(lambda c: "0" <= c <= "9") / chars,
        "symbols_per_word": count(lambda c: c in "#*$%&|<>") / n, "shouts_per_word": count(lambda c: c in "!?") / n, "stops_per_word": count(lambda c: c in ".,;:") / n, "lines_per_word": text.count("\n") / n,
        "long_per_word": sum(len(w) >= 25 for w in words) / n, "distinct_words": len(set(words)) / n,
    }


def test_statistics_against_a_plain_form(spark):
    rng = random.Random(6)
    pieces = ["a", "B", "word", "É", "ß", "日本", "🙂", "x" * 30, "12", "#", "<|>", "!", "?", ".", ",", ";:", "\n", "\t", " ", "  ", "\x0b", "\xa0", "\u2003"]
    texts = ["", " ", "\n\n", *("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)), cases.LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", q.described(F.col("t")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["i"]])
        assert set(want) == set(r["s"].asDict())
        for name, x in want.items():
            assert abs(r["s"][name] - x) < 1e-9, (name, texts[r["i"]][:80])


def test_as_many_rules_as_a_fit_can_make(spark):
    """30 trees of depth 3 have 420 rules at most; labels that texts don't explain keep most of them."""
    rng = random.Random(1)
    names = list(q.statistics(F.col("text")))
    rules = [tuple((rng.randrange(len(names)), rng.random() < 0.5, rng.random()) for _ in range(3)) for _ in range(420)]
    docs = cases.docs(spark)
    model = q.RuleModel(names, rules, [rng.random() - 0.5 for _ in rules], 0.1)
    rows = docs.select(q.described(F.coalesce("text", F.lit(""))).alias("s")).select("s.*", model.score(F.col("s")).alias("score")).collect()
    x = np.array([[r[n] for n in names] for r in rows])
    want = 1 / (1 + np.exp(-(model.bias + sum(w * q.holds(r, x) for r, w in zip(rules, model.weights, strict=True)))))
    assert np.allclose([r["score"] for r in rows], want)
    assert q.kept_rows(docs, model).count() == (want >= 0.5).sum()
