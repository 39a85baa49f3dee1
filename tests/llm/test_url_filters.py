import random

from docreason.llm import url_filters


def brute(captures, entries):
    spans = {}
    for k in {(a, p.lower()) for a, p, _, d in entries if None not in (a, p, d)}:
        by = {}
        for a, p, act, d in entries:
            if None not in (a, p, d) and (a, p.lower()) == k:
                by[d] = by.get(d, True) and act == "add"
        start = None
        for d in sorted(by):
            if by[d] and start is None:
                start = d
            elif not by[d] and start is not None:
                spans.setdefault(k, []).append((start, d))
                start = None
        if start is not None:
            spans.setdefault(k, []).append((start, None))
    out = []
    for i, url, t in captures:
        host = None
        if url and "://" in url:
            place = url.split("://", 1)[1].replace("?", "/").replace("#", "/").split("/")[0].split("@")[-1]
            end = place.find("]") + 1 if place.startswith("[") else (place + ":").index(":")
            host = place[:end].lower().rstrip(".") or None
        on = [(a, s) for (a, p), ss in spans.items() for s, e in ss
              if host and t is not None and (host == p or not host.startswith("[") and host.endswith("." + p)) and s <= t and (e is None or t < e)]
        out.append((i, host, t, ",".join(sorted({a for a, _ in on})), max((s for _, s in on), default=None), len(on), bool(on)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.example.com", "b.a.example.com", "EXAMPLE.com", "x.org", "example.org.", "localhost", "com", "a.localhost", "foo.zip", "[2001:DB8::1]"]
    captures = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '/p?q=http://x.org', '#f'])}",
                 rng.randrange(0, 900_000)) for i in range(300)]
    captures += [(400, None, 5), (401, "not a url", 5), (402, "http://x.org/", None), (None, "http://x.org/", 86_400), (403, "http://x.org/", 86_399),
                 (7, "http://x.org/", 86_400), (7, "http://x.org/", 86_400), (404, "http:///", 1), (405, "", 1),
                 (406, "http://x.org@none.net:80@evil.example.com/", 899_999), (407, "http://a@:80/", 5), (408, "http://[::1", 5), (409, "http://[::ffff:1.2.x.org]:8/", 899_999)]
    entries = [(rng.choice(["spam", "adult"]), rng.choice(["example.com", "a.example.com", "X.org", "org", "localhost", "com", "none.net", "zip", "[2001:db8::1]"]),
                rng.choice(["add", "add", "remove"]), rng.choice([rng.randrange(0, 900_000), 86_400, 100])) for _ in range(60)]
    entries += [("spam", None, "add", 1), (None, "x.org", "add", 1), ("spam", "x.org", "add", None)]
    caps = spark.createDataFrame([(*c, "k", 1) for c in captures], "page_id long, url string, fetched_at long, key string, day int")
    log = spark.createDataFrame([(*e, 1) for e in entries], "list string, pattern string, action string, dated long, before int")
    got = [tuple(r) for r in url_filters.evaluate(caps, log).collect()]
    assert sorted(got, key=repr) == sorted(brute(captures, entries), key=repr)
    assert not any(r["blocked"] for r in url_filters.evaluate(caps, log.limit(0)).collect())
    assert url_filters.evaluate(caps.limit(0), log).count() == 0


def test_intervals(spark):
    log = spark.createDataFrame([("s", "p", "add", 5), ("s", "p", "add", 7), ("s", "p", "remove", 9), ("s", "p", "remove", 11),
                                 ("s", "p", "add", 20), ("s", "p", "remove", 20), ("s", "p", "add", 30)],
                                "list string, pattern string, action string, dated long")
    assert sorted(tuple(r) for r in url_filters.intervals(log).collect()) == [("s", "p", 5, 9), ("s", "p", 30, None)]


def test_hosts(spark):
    cases = {"http://user@host:80@evil.com/": "evil.com", "HTTPS://A.Example.COM.:8443/x@y": "a.example.com", "http://[::1]:80/": "[::1]",
             "http://u:p@[FE80::A]/": "[fe80::a]", "ftp://x.org?q=@z": "x.org", "http://a@:80/": None, "http://[::1": None, "no url": None,
             "http://": None, "http://..": None, "//x.org/": None}
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert {r.url: r.host for r in df.select("url", url_filters.host_of(df.url).alias("host")).collect()} == cases


def test_a_last_label_matches_all_hosts_below_it(spark):
    caps = spark.createDataFrame([(1, "http://a.localhost/", 10), (2, "http://foo.zip/", 10), (3, "http://zip/", 10), (4, "http://foozip/", 10)],
                                 "page_id long, url string, fetched_at long")
    log = spark.createDataFrame([("s", "localhost", "add", 1), ("s", "zip", "add", 1)], "list string, pattern string, action string, dated long")
    assert {r.page_id: r.blocked for r in url_filters.evaluate(caps, log).collect()} == {1: True, 2: True, 3: True, 4: False}
