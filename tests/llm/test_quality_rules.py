import random

import cases

from seqloom.llm import quality_rules as q


def brute(text):
    words = (text or "").encode().split()
    n, on = len(words), set()
    for i in range(n - 7):
        for j in range(n - 7):
            if i != j and words[i : i + 8] == words[j : j + 8]:
                on |= set(range(i, i + 8))
    return len(on)


def test_repeated_words():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice(["a", "b"]).encode() for _ in range(rng.randint(0, 40))]
        assert q.repeated_words(words) == brute(" ".join(w.decode() for w in words))


def test_statistics():
    assert q.text_stats("a b#\n\na b#\n a b# \n<é>|") == (7, 13, 6, 1, 0)
    assert q.text_stats(None) == q.text_stats("") == q.text_stats(" \n") == (0, 0, 0, 0, 0)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "few words"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad, "fine") for i in range(2)] + [(200 + i, bad if i < 38 else good, "poor") for i in range(40)] + [(300, good, None), (301, bad, "one")]
    out = {r["doc_id"]: r for r in q.host_verdicts(cases.docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, text, host in rows:
        assert out[i]["base_failed"] == (text == bad)
        assert out[i]["kept"] == (text == good and host != "poor")
    kept = q.kept_rows(cases.docs(spark, rows))
    assert kept.columns == cases.docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in out.items() if r["kept"])


def test_odd_cases(spark):
    out = q.host_verdicts(cases.docs(spark)).collect()
    assert len(out) == len(cases.TEXTS)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["doc_id"] in (3, 4, 5))
    assert q.host_verdicts(cases.empty(spark)).count() == 0 and q.kept_rows(cases.empty(spark)).count() == 0


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(40))
    names = ["_host", "_failed", "_row", "n", "fails", "n_words"]
    docs = cases.docs(spark, [(1, text, "a"), (2, "short", "a"), (3, text + " x", "b"), (None, None, None)]).select("doc_id", "text", "source", *[F.lit(f"own {n}").alias(n) for n in names])
    out = q.kept_rows(docs)
    rows = out.collect()
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in rows) == [1, 3]
    assert all(r[n] == f"own {n}" for r in rows for n in names)
    assert q.kept_rows(cases.empty(spark)).count() == 0
