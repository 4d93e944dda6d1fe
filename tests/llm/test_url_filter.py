import random

from seqloom.llm import url_filter as u


def brute(host, path, rules):
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "http://www.example.com/en/x?y#z", "https://example.com/en/", "http://a.b.example.com/en/1", "http://x.net/es/", "http://net/fr/", "http://netx/fr/", "ftp://x.com?/en/", "http://x.net#/es/", "http://É.COM/", "http://x.net/es", "a://b://c.net/es/"]


def test_against_all_rules(spark):
    rows = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(URLS)] + [(None, "http://x.com/", "clash")] * 2, "page_id long, url string, host string")
    got = u.judge_urls(spark, rows, "page_id", "url", u.RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        want = u.split_url(URLS[r["page_id"]] if r["page_id"] is not None else "http://x.com/")
        assert (r["host"], r["path"]) == want and (r["rule"], r["verdict"]) == brute(*want, u.RULES)
    assert u.judge_urls(spark, rows.limit(0), "page_id", "url", u.RULES).count() == 0
    assert {r["verdict"] for r in u.judge_urls(spark, rows, "page_id", "url", []).collect()} == {"allow"}


def test_random_rules_and_equal_keys(tmp_path):
    rng = random.Random(2)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    rules = [(name(), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [(name(), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))) for _ in range(500)]
    for key in (u.xxhash.xxh64_intdigest, lambda s: len(s) % 3):
        array = u.DigestArray(*u.write_digests(rules, str(tmp_path), key=key), key=key)
        for (host, path), got in zip(urls, array.judge(urls), strict=True):
            fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert (got[0] is None) == (not fits)
            if fits:
                assert len(got[0]) == max(fits)[0] and (got[0], got[1]) in {(r, v) for _, r, v in fits}
