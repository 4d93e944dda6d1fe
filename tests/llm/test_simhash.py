import hashlib
import random

import cases
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import simhash


def edited(docs):
    def tie(text):
        h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
        return h - (1 << 64) * (h >> 63), text or ""

    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    out = []
    for k, (i, t, _) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        out.append((i, t, t[: len(t) - m] + nxt[:m], nxt))
    return out


def prints(spark, texts):
    """By counting votes one by one."""
    terms = {t: [] for t in texts}
    for t in texts:
        words = [w.decode() for w in t.encode().split()]
        terms[t] = [tuple(words[i : i + 3]) for i in range(len(words))]
    distinct = sorted({x for v in terms.values() for x in v})
    hashes = {}
    if distinct:
        padded = [(*x, *[None] * (3 - len(x))) for x in distinct]
        h = F.xxhash64("a", "b", "c")
        for r in spark.createDataFrame(padded, "a string, b string, c string").select("*", h.alias("h"), F.xxhash64(F.lit(0x5EED), h).alias("g")).collect():
            hashes[tuple(x for x in (r["a"], r["b"], r["c"]) if x is not None)] = [x % (1 << 64) for x in (r["h"], r["g"])]
    out = {}
    for t, items in terms.items():
        halves = []
        for half in (0, 1):
            bits = 0
            for b in range(64):
                votes = sum((1 if hashes[x][half] >> b & 1 else -1) * sum(map(len, x)) for x in items)
                bits |= (votes > 0) << b
            halves.append(f"{bits:016x}")
        out[t] = "".join(halves)
    return out


def check(spark, docs):
    got = simhash.edited_fingerprints(cases.docs(spark, docs)).collect()
    want = edited(docs)
    f = prints(spark, {x for _, t, e, n in want for x in (t, e, n)})
    near = lambda a, b: 1 - (int(f[a], 16) ^ int(f[b], 16)).bit_count() / 128
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[t], f[e], near(t, e), near(t, n)) for i, t, e, n in want], key=key)


def test_odd_cases(spark):
    check(spark, [(i, t if t is None or len(t) < 1000 else t[:4000], s) for i, t, s in cases.TEXTS])
    check(spark, [(1, "only one", "a")])
    assert simhash.edited_fingerprints(cases.empty(spark)).count() == 0


def test_many_ranges(spark):
    rng = random.Random(5)
    check(spark, [(rng.choice([rng.randint(-50, 50), i * 1000]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))), "s") for i in range(150)])


def test_hot_ids(spark):
    """An id, or none, that a third of all rows have is cut over several ranges; each row still has its next one."""
    rng = random.Random(15)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
    for hot in ([7], [None], [7, None], [-5], [999]):
        docs = [(rng.choice(hot) if rng.random() < 0.5 else rng.randint(0, 500), text(), "s") for _ in range(300)]
        check(spark, docs)
        dealt = simhash.with_next(cases.docs(spark, docs).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "_id", "_text")
        most = dealt.groupBy("_bucket").count().agg(F.max("count")).first()[0]
        assert most < 75


def test_neighbours(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = {x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 5))) for x in base for _ in range(8)}
    rows = spark.createDataFrame([(f"{v:032x}",) for v in values] + [(None,), (f"{base[0]:032x}",)], "fingerprint string")
    all_ = values | {base[0]}
    for radius in (1, 3, 4):
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in all_ for b in all_ if a < b and (a ^ b).bit_count() <= radius}
        assert {tuple(r) for r in simhash.neighbours(rows, radius=radius).collect()} == want


def test_hot_blocks(spark):
    """Blocks that very many fingerprints share are cut again; no pair is lost."""
    rng = random.Random(9)
    base = rng.getrandbits(128)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 9))) for _ in range(300)})
    rows = spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string")
    for levels in (1, 3):
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
        assert {tuple(r) for r in simhash.neighbours(rows, radius=3, most=20, levels=levels).collect()} == want
    tables = simhash.block_tables(rows.select(F.col("fingerprint").alias("f")), 3, 20, 3)
    assert tables.groupBy("key").count().agg(F.max("count")).first()[0] < len(values)


def test_near_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(5, base, "a"), (3, base, "b"), (4, base + " x", "a"), (7, base.replace("w200", "q"), "a"), (8, "other words", "a"), (9, None, "a"), (10, "", "a"), (None, base, "a")]
    rows = simhash.near_documents(cases.docs(spark, docs), radius=40).collect()
    f = prints(spark, {t or "" for _, t, _ in docs})
    assert len(rows) == len(docs)
    for r in rows:
        text = next(t or "" for i, t, _ in docs if i == r["doc_id"])
        apart = [(int(f[text], 16) ^ int(x, 16)).bit_count() for x in set(f.values()) if x != f[text]]
        near = [d for d in apart if d <= 40]
        assert (r["fingerprint"], r["n_near"], r["nearest"]) == (f[text], len(near), min(near, default=None))
        assert r["class_id"] == min(i for i, t, _ in docs if i is not None and f[t or ""] == f[text])
    assert simhash.near_documents(cases.empty(spark)).count() == 0
