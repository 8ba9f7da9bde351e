import pytest

from fleetpulse.llm import urls


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in rules:
        name, slash, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + tail) and host:
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, path, best and best[1], best[2] if best else default


URLS = [
    "http://example.com/en/1", "HTTPS://WWW.Example.COM/en/x?y#z", "http://www.example.com/EN/", "http://a.www.example.com/en/", "http://badexample.com/en/",
    "http://shop.net/es/a", "http://shop.net/fr", "http://shop.net/fr/", "http://net/es/", "x://com/", "x://com", "http://a.b.c.org/en/", "no scheme", "", None,
    "://", "http:///path", "http://a.com?x=://b.net/es/", "redirect?u=http://b.net/es/1", "http://é.example.com/en/é", "http://user@example.com:80/en/",
    "http://example.com/en/\nline", "a\nb://example.com/en/", "http://.com/", "http://com./", "http://İ.net/es/", "http://example.com/en/" + "x" * 100_000,
]


@pytest.mark.parametrize("rules", [urls.RULES, (), (("block", "org"), ("allow", "c.org/e"), ("block", "com/"))])
def test_against_brute_force(spark, rules):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, host string")
    found = urls.judge(df, rules).orderBy("page_id").collect()
    assert [(r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in found] == [plain(u, rules) for u in URLS + URLS[:5]]
    assert urls.judge(df, rules).columns == [*df.columns, "_host", "_path", "_rule", "_verdict"]


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda key: len(key) % 3)
    rules = [("block" if n % 2 else "allow", f"h{n}.com/{'p' * (n % 4)}") for n in range(50)]
    index = urls.DigestIndex(rules).open()
    hosts, paths = [f"x.h{n}.com" for n in range(60)], ["/ppp"] * 60
    for (host, path), at in zip(zip(hosts, paths), index.longest(hosts, paths)):
        assert (index.text(at).decode() if at >= 0 else None) == plain(f"a://{host}{path}", rules)[2]


def test_repeated_rules_block_and_size_is_bounded(monkeypatch):
    index = urls.DigestIndex([("block", "A.com/"), ("allow", "a.com/")])
    assert index.n == 1 and index.blocks.all()
    monkeypatch.setattr(urls, "MAX_INDEX_BYTES", 10)
    with pytest.raises(ValueError, match="limit"):
        urls.DigestIndex([("block", "example.com/")])


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
