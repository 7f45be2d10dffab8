import random

from gavelworks.llm.url_filter import Rule, judge, reputations

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    return host, path[:end]


def brute(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules(spark):
    rng = random.Random(1)
    hosts = ["a.example.net", "Example.NET", "notexample.net", "x.net:80", "b.org", "org", "example.com", "w.example.com", "é.net", "", "net"]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/x/y", "/EN/", "/a?u=/en/", "#/en/", "?/fr/"]
    urls = [rng.choice(["http://", "HTTPS://", "x", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)]
    urls += [None, "", "://", "net/", "http://x.net\n/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    for r in judge(pages, outcomes, RULES).collect():
        host, path = split(urls[r.page_id])
        rule = brute(host, path)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((rule.text, rule.verdict) if rule else (None, "allow")), urls[r.page_id]


def test_bad_hosts_are_blocked_on_evidence(spark):
    pages, outcomes = [], []
    for host, n, bad in [("bad.com", 200, 190), ("new.bad.com", 2, 2), ("good.com", 1000, 4), ("few.com", 2, 2), ("unseen.com", 3, None)]:
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            if bad is not None:
                outcomes.append((len(pages) - 1, int(i < bad)))
    outcomes += [(0, None), (99_999, 1)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    rows = judge(pages, spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()
    verdicts = {r.host: r.verdict for r in rows}
    assert len(rows) == 1207
    assert verdicts == {"bad.com": "block", "new.bad.com": "block", "good.com": "allow", "few.com": "allow", "unseen.com": "allow"}


def test_shrinking(spark):
    frame = spark.createDataFrame(
        [("com", "a.com", "a.com", 100, 50), ("com", "b.com", "b.com", 1, 1), ("org", "c.org", "c.org", 0, 0)],
        "suffix string, domain string, host string, n long, bad long",
    )
    rate = {r.host: r.rate for r in reputations(frame).collect()}
    assert abs(rate["a.com"] - 0.5) < 0.05 and 0.5 < rate["b.com"] < 0.9 and 0.4 < rate["c.org"] < 0.6


def test_odd_frames(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/", "x"), (1, "http://a.net/", "x"), (None, None, None)], "page_id long, url string, host string"
    )
    outcomes = spark.createDataFrame([(1, 0), (1, 0), (1, None), (None, 1)], "page_id long, bad int")
    rows = judge(pages, outcomes, RULES).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in rows) == [("1", "a.net", "block")] * 2 + [("None", "", "allow")]
    assert judge(pages.limit(0), outcomes, RULES).collect() == []
