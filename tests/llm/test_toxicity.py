import cases
import numpy as np

from seqloom.llm import toxicity as t
from seqloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    net = t.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["", "idiot", "the", "é", "abcdefg"]
    index = rng.integers(0, 5, (3, t.WINDOW))
    length, y = np.array([t.WINDOW, 7, 0]), np.array([1.0, 0.0, 1.0])

    def loss():
        out = net.forward(net.project(net.embed(words)[0]), index, length)
        p = t.sigmoid(out)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    x, _ = net.embed(words)
    out, cache = net.forward(net.project(x), index, length, keep=True)
    grads, d_table = net.backward(index, cache, (t.sigmoid(out) - y) / 3, len(words))
    grads["wx"], grads["b"] = np.einsum("nd,nkh->kdh", x, d_table), d_table.sum(axis=0)[:, None]
    for name, grad in grads.items():
        flat = net.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(4, flat.size), replace=False):
            keep, e = flat[k], 1e-4
            flat[k] = keep + e
            up = loss()
            flat[k] = keep - e
            down = loss()
            flat[k] = keep
            assert abs((up - down) / (2 * e) - grad.reshape(-1)[k]) < 1e-4 + 0.02 * abs(grad.reshape(-1)[k]), name


def test_windows_cover_the_text():
    for n in (0, 1, t.STRIDE, t.WINDOW, t.WINDOW + 1, 500):
        on = {i for s in t.window_starts(n) for i in range(s, min(n, s + t.WINDOW))}
        assert on == set(range(n)) and len(t.window_starts(n)) >= 1


def plain_score(net, text):
    """One text's score by loops over windows, directions and words."""
    words = t.words_of(text)
    embedded = [net.embed([w])[0][0] for w in words]
    best = None
    for start in t.window_starts(len(words)):
        part = embedded[start : start + t.WINDOW]
        states = np.zeros((max(1, len(part)), 2 * t.HIDDEN))
        for k in (0, 1):
            h = np.zeros(t.HIDDEN)
            for i in range(len(part)) if k == 0 else reversed(range(len(part))):
                g, u = part[i] @ net.p["wx"][k] + net.p["b"][k, 0], h @ net.p["wh"][k]
                z, r = np.split(t.sigmoid(g[: 2 * t.HIDDEN] + u[: 2 * t.HIDDEN]), 2)
                h = (1 - z) * h + z * np.tanh(g[2 * t.HIDDEN :] + r * u[2 * t.HIDDEN :])
                states[i, k * t.HIDDEN : (k + 1) * t.HIDDEN] = h
        e = np.tanh(states @ net.p["wa"]) @ net.p["va"]
        w = np.exp(e - e.max())
        out = float(w / w.sum() @ states @ net.p["wo"] + net.p["bo"][0])
        best = out if best is None else max(best, out)
    return 1 / (1 + np.exp(-best))


def test_score_is_the_highest_window_of_all():
    rng = np.random.default_rng(4)
    net = t.Network(2)
    net.p = {k: v * 3 for k, v in net.p.items()}
    words = ["idiot", "the", "é", "Fool!", "1234", "abcdefghijk", "ß.", "--"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, t.STRIDE, t.WINDOW, t.WINDOW + 1, 200, 333)] + [None, "  ", "idiot"]
    got = t.Model(net).scores(texts)
    assert np.allclose(got, [plain_score(net, x) for x in texts], atol=1e-5)
    assert np.allclose([t.Model(net).scores([x])[0] for x in texts], got, atol=1e-6)


def held(docs, labels, **options):
    rows = t.score(docs, t.fit(docs, labels, **options)).collect()
    want = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    return rows, [(r["score"], want[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in want]


def area(pairs):
    high, low = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in high for b in low])


def test_held_out(spark):
    """By ranking, recall and false alarms, on rows that the model hasn't seen; and what the network learns without the
    counts that its embeddings begin with."""
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    rows, pairs = held(docs, labels)
    plain = held(docs, labels, counts_first=False)[1]
    recall = np.mean([s >= 0.7 for s, y in pairs if y])
    print("area", area(pairs), "recall", recall, "false", np.mean([s >= 0.7 for s, y in pairs if not y]), "without counts", area(plain), np.mean([s >= 0.7 for s, y in plain if y]), len(pairs))
    assert area(pairs) > 0.9 and recall > 0.7
    assert np.mean([s >= 0.7 for s, y in pairs if not y]) < 0.02
    assert area(plain) > 0.6
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows) and len(rows) == docs.count()


def test_odd_cases(spark):
    docs = cases.docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, 1, 0), (9, 1, None), (10, 1, 0)], "doc_id long, quality int, toxic int")
    rows = t.score(docs, t.fit(docs, labels)).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in t.score(docs, t.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert t.score(cases.empty(spark), t.fit(cases.empty(spark), labels)).count() == 0
