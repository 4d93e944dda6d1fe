import random

import cases
import numpy as np

from seqloom.llm import components, minhash


def words(text):
    return (text or "").encode().lower().split()


def brute(docs, width, percent):
    """id to (set size, component)."""
    sets = {}
    for i, t, _ in docs:
        w = words(t)
        sets.setdefault(i, set(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else set())
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups, most, star=0):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    if star:
        base = [rng.choice(vocabulary) for _ in range(150)]
        out.append(" ".join(base))
        for _ in range(star):  # each copy near to the base, but often not to the others
            copy = list(base)
            for k in rng.sample(range(150), 4):
                copy[k] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return [(i, t, "s") for i, t in enumerate(out)]


def check(spark, docs, width, percent, **options):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(cases.docs(spark, docs), width=width, percent=percent, **options).collect()}
    want = brute(docs, width, percent)
    for i, (n, component) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component), i


def test_small_groups(spark):
    check(spark, corpus(1, 40, 5), 3, 85)


def test_clusters_above_the_block(spark):
    """Several blockings, and where those leave parts, a join on rare shingles."""
    check(spark, corpus(2, 6, 12, star=60), 3, 85, block=8)


def test_odd_cases(spark):
    out = minhash.near_duplicates(cases.docs(spark), width=3, percent=85).collect()
    assert len(out) == len(cases.TEXTS)
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[1]["kept"]
    assert got[7]["component_id"] == 6 and got[10]["component_id"] == 9
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (3, 4, 5))
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0
    kept = minhash.kept_rows(cases.docs(spark), width=3, percent=85)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9] and kept.columns == cases.docs(spark).columns


def test_link_sets():
    rng = np.random.default_rng(3)
    for m in (5, 40):
        base = rng.integers(0, 1 << 60, 60, np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 60, 3, np.uint64)])) for _ in range(m)]
        ids = [(i, s) for i, s in enumerate(sets)]
        up = list(range(m))
        for i, a in ids:
            for j, b in ids:
                both = len(np.intersect1d(a, b))
                if 100 * both >= 85 * (len(a) + len(b) - both) and up[i] != up[j]:
                    x, y = sorted((up[i], up[j]))
                    up = [x if u == y else u for u in up]
        assert minhash.link_sets(sets, 85) == up


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 100), (7, 7), (200, 150)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {99: 99, 100: 99, 150: 150, 200: 150}


def region(seed, n, linked, words=120, replaced=0.03, added=0.0):
    """n texts with one form, each with words of its own in place of some of it or behind it, likely candidates but mostly
    not linked; of each of the last `linked` ones also a near copy."""
    rng = random.Random(seed)
    form = [f"f{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(form)
        for i in rng.sample(range(words), int(words * replaced * rng.uniform(0.6, 1.4))):
            text[i] = f"o{k}x{i}"
        text += [f"a{k}x{i}" for i in range(int(words * added * rng.uniform(0.8, 1.2)))]
        out.append(" ".join(text))
        if k >= n - linked:
            text[rng.randrange(words)] = f"c{k}"
            out.append(" ".join(text))
    return out


def linked_pairs(texts, width, percent):
    """All linked pairs, by a product of the matrix of texts and shingles."""
    sets = [set(zip(*(t.split()[k:] for k in range(width)), strict=False)) for t in texts]
    at = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s]] = 1
    both, n = (m @ m.T).round().astype(int), m.sum(axis=1).astype(int)
    x, y = np.nonzero(100 * both >= percent * (n[:, None] + n[None, :] - both))
    return [(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a < b]


def test_links_in_a_dense_region(spark):
    """Among texts that are all alike and mostly not linked, links are found, nearly all, and nothing else is linked."""
    texts = region(7, 1500, 400)
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(cases.docs(spark, docs), width=3, percent=85).collect()}
    true = linked_pairs(texts, 3, 85)
    assert len(true) > 350
    assert sum(got[a] == got[b] for a, b in true) >= 0.99 * len(true)
    up = list(range(len(texts)))
    for a, b in sorted(true):
        x, y = sorted((up[a], up[b]))
        up = [x if u == y else u for u in up] if x != y else up
    assert all(up[i] == up[c] for i, c in got.items())


def test_work_grows_with_a_region(spark, monkeypatch):
    """Twice as many texts with one form and words of their own: what is dealt grows by 2.2 times at most, and no more
    pairs meet than are linked."""

    def work(n):
        made = {}

        def counted(df, label, keep=minhash.materialized):
            out = keep(df, label)
            made[label] = made.get(label, 0) + out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(minhash, "materialized", counted)
            docs = cases.docs(spark, [(i, t, "s") for i, t in enumerate(region(11, n, n // 5, replaced=0.0, added=0.18))])
            minhash.near_duplicates(docs, width=3, percent=85, block=32).count()
        return made

    small, large = work(300), work(600)
    for label in ("members", "resolved", "sets", "differing"):
        assert large[label] <= 2.2 * small[label], (label, small, large)


def test_depth_of_regions():
    rng = np.random.default_rng(1)
    rows = np.sort(rng.integers(0, 3, (500, 6)).astype(">u4").view(np.uint8).reshape(500, -1).view("S24").ravel())
    key, tree = np.frombuffer(rows.tobytes(), np.uint8).reshape(500, 24), np.zeros(500, int)
    depth = minhash.depths(tree, key, 3, 8)
    words = key.view(">u4")
    for i in range(500):
        shared = 0
        while i >= 8 and shared < 6 and (words[i, : shared + 1] == words[i - 8, : shared + 1]).all():
            shared += 1
        assert depth[i] == min(6, max(3, shared + 1 if i >= 8 else 3))


def test_repeated_ids_lose_no_text(spark):
    docs = cases.docs(spark, [(1, "a b c d e f g h", "s"), (1, "a b c d e f g h", "t"), (1, "p q r s t u v w", "s"), (2, "A b c d e f g h", "s"), (None, "z", "s"), (None, "z", "s")])
    for _ in range(2):
        out = sorted(((r["doc_id"] or 0), r["text"], r["source"]) for r in minhash.kept_rows(docs, width=3, percent=85).collect())
        assert [x[:2] for x in out] == [(0, "z"), (0, "z"), (1, "a b c d e f g h"), (1, "p q r s t u v w")]
