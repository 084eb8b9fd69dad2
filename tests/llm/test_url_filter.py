from pyspark.sql import functions as F

from valora.llm import url_filter as U

CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme org/", "", "", None), ("https://A.B.org", "a.b.org", "", None),
    ("https://A.org/x?q=://b", "a.org", "/x", "org/"), ("http://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"), ("http://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/"), ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/"),
    ("http://com/de/9", "com", "/de/9", "com/de/"), ("http://telecom/de/9", "telecom", "/de/9", None), ("x://y.net/a", "y.net", "/a", None),
    ("http://ÀB.net/" + "p" * 200_000, "Àb.net", "/" + "p" * 200_000, None), ("http://q.org/a\nb", "q.org", "/a\nb", "org/")]


def brute(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_parts_rules_and_verdicts(spark):
    out = U.judge(pages(spark, [c[0] for c in CASES] * 2))
    assert out.columns == ["page_id", "url", "host", "_host", "path", "rule", "verdict", "block_score"]
    got = out.collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        url, host, path, rule = CASES[r["page_id"] % len(CASES)]
        assert (r["_host"], r["path"], r["rule"]) == (host, path, rule), url
        want = brute(host, path)
        assert want[0] == rule and r["verdict"] == (want[1] or ("block" if r["block_score"] >= 0.5 else "allow"))


def test_learns_from_labelled_urls(spark):
    urls = [f"http://h{i}.com/{k}/{i}" for i in range(60) for k in ("fr", "de")]
    urls += [f"http://new{i}.net/{k}/{i}" for i in range(20) for k in ("fr", "de")]
    got = U.judge(pages(spark, urls)).where("rule is null").collect()
    right = sum((r["verdict"] == "block") == ("/de/" in r["url"]) for r in got)
    assert right >= 36


def test_without_labels_and_empty_table(spark):
    assert [r["verdict"] for r in U.judge(pages(spark, ["http://x.net/a"])).collect()] == ["allow"]
    assert [r["verdict"] for r in U.judge(pages(spark, ["http://x.net/a", "http://x.com/de/"])).collect()] == ["block"] * 2
    assert U.judge(pages(spark, ["http://x.net/a"]).limit(0)).count() == 0


def test_a_hot_url_does_not_take_the_sample(spark, monkeypatch):
    monkeypatch.setattr(U, "FIT_ROWS", 60)
    urls = [f"http://h{i}.com/{k}/{i}" for i in range(60) for k in ("fr", "de")]
    hot = pages(spark, urls).orderBy(F.pmod(F.xxhash64("url"), F.lit(1 << 30))).first()["url"]
    urls += [hot] * 400 + [f"http://new{i}.net/{k}/{i}" for i in range(20) for k in ("fr", "de")]
    got = U.judge(pages(spark, urls)).where("rule is null").collect()
    assert sum((r["verdict"] == "block") == ("/de/" in r["url"]) for r in got) >= 36
