import random

import cases
import numpy as np

from seqloom.llm import licenses


def brute(text, index):
    """Names with a window, at any start, that contains enough of the template; and each shingle that lies in one."""
    keys = licenses.shingles(licenses.words_of(text), index.width)
    out = {}
    for name, wanted, w in zip(index.names, index.sets, index.windows, strict=True):
        on = set()
        for i in range(len(keys)):
            part = keys[i : i + w]
            if len(np.intersect1d(part, wanted)) >= index.share * len(wanted):
                on |= {i + j for j in np.flatnonzero(np.isin(part, wanted)).tolist()}
        if on:
            out[name] = (min(on), max(on) + index.width)
    return out


def test_against_all_windows():
    rng, index = random.Random(8), licenses.Index(licenses.TEMPLATES)
    words = ["the", "license", "under", "version", "of", "and", "x", "rights", "all"]
    texts = [None, "", "Released under the MIT License.", "MIT License", "RELEASED under, the MIT\nlicense"]
    for _ in range(300):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        template = licenses.TEMPLATES[rng.choice(index.names)].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2]) * max(1, len(template) // 30)):  # some words changed or put in
            k = rng.randrange(len(template) + 1)
            template[k : k + rng.randint(0, 1)] = [rng.choice(words)]
        at = rng.randint(0, len(parts))
        texts.append(" ".join(parts[:at] + template + parts[at:]))
    got, n = index.matches(texts), 0
    for text, found in zip(texts, got, strict=True):
        want = brute(text, index)
        assert {m[0] for m in found} == set(want), text
        for name, (first, end) in want.items():
            mine = [m for m in found if m[0] == name]
            assert min(m[1] for m in mine) >= first and max(m[2] for m in mine) <= end and all(m[3] >= index.share for m in mine)
            n += 1
    assert n > 200


def test_table(spark):
    rows = [*cases.TEXTS, (50, "x\nReleased under the MIT License.\ny " * 2, "a"), (51, cases.LONG + " " + licenses.TEMPLATES["isc"], "a"), (52, "All rights reserved.", "a")]
    out = {r["doc_id"]: r["matches"] for r in licenses.scan(cases.docs(spark, rows)).collect()}
    assert [m["license"] for m in out[50]] == ["mit-line", "mit-line"] and [m["license"] for m in out[51]] == ["isc"]
    assert all(not m for i, m in out.items() if i not in (50, 51)) and len(out) == len({i for i, _, _ in rows})
    assert licenses.scan(cases.docs(spark)).count() == len(cases.TEXTS) and licenses.scan(cases.empty(spark)).count() == 0


def test_templates_from_a_table(spark):
    rows = spark.createDataFrame([("own", "one two three four five six", 1), ("own", "z z z", 2), ("empty", " ", 3), (None, "x", 4), ("none", None, 5)], "name string, text string, n int")
    assert licenses.templates_from(rows) == {"own": "one two three four five six"}
    out = licenses.scan(cases.docs(spark), templates=licenses.templates_from(rows)).collect()
    assert sorted(r["doc_id"] for r in out if r["matches"]) == [1, 1, 2]
    assert all(not r["matches"] for r in licenses.scan(cases.docs(spark), templates={}).collect())


def test_whole_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert name in {m[0] for m in index.matches(["before " * 50 + text.upper().replace(" ", "\n") + " after" * 50])[0]}
    assert not index.matches(["All rights reserved."])[0]
