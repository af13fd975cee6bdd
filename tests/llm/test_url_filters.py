from tessera.llm import bloom_cascade


def brute(url, rules=bloom_cascade.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, *rule


URLS = [
    None, "", "x", "http://", "://", "http://COM/en/", "http://a.com/en/7", "https://Example.COM/en/77?x#y", "http://sub.example.com/en/7", "http://example.net/de/8/", "http://net/de/", "http://anet/de/",
    "http://x.org/es/#", "http://x.org?/es/", "http://example.com./en/7", "http://user@example.com:80/en/", "http://a..com/en/é", "a://b://com/en/", "http://com\n/en/", "http://x.com/en/" + "z" * 50_000,
]


def test_judge_matches_brute_force(spark):
    frame = spark.createDataFrame([(i % 30, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in bloom_cascade.judge(frame).collect())
    want = []
    for i, u in enumerate(URLS * 2):
        host, path, rule, verdict = brute(u)
        want.append((i % 30, host, path, rule or "", verdict))
    assert got == sorted(want)


def test_cascade_is_exact(spark):
    hosts = [(i, f"http://h{i}.example{i % 7}.com/p{i % 13}/") for i in range(3000)]
    rules = [("block", f"h{i}.example{i % 7}.com", "/p") for i in range(0, 3000, 17)] + [("block", f"example{i}.com", f"/p{i}/") for i in range(7)]
    frame = spark.createDataFrame(hosts, "page_id long, url string")
    cascade = bloom_cascade.build(spark, bloom_cascade.split_url(frame), rules)
    assert len(cascade.levels) >= 1
    got = {r.page_id: r.rule for r in bloom_cascade.judge(frame, rules).collect()}
    assert got == {i: brute(u, rules)[2] for i, u in hosts}


def test_empty(spark):
    assert bloom_cascade.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
