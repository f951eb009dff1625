import re

from tilespark.llm import urls
from tilespark.llm.queries import URL_RULES

URLS = [None, "", "no scheme.org/x", "http://", "http://Example.ORG/es/1", "https://a.b.example.org/en/1x?q#f", "ftp://example.org/en/2", "http://x.org", "http://x.org/", "x://é.com/de/#a",
        "http://notorg/", "http://xorg.com/fr/", "http://a.com?/fr/", "a://b://c.org/", "http://h.com/de/x/y.html?k=1&&z", "HTTP://org/", "http://İ.net/", "http://q.net/a\nb"]


def plain(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def table(spark, rows):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(rows)], "page_id long, url string, host string, verdict string")


def test_host_path_and_rule(spark):
    got = {r.page_id: r for r in urls.judge(table(spark, URLS), URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, best = plain(u)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (best[0] if best else None)
        assert got[i].verdict == (best[1] if best else got[i].verdict) and got[i].verdict in ("allow", "block")


def test_rules_are_mined_and_matched(spark):
    labelled = [(f"http://a{i % 9}.example.com/{'spam' if i % 3 == 0 else 'news'}/{i}.html", "block" if i % 3 == 0 else "allow") for i in range(300)]
    rules, names = urls.mine(spark.createDataFrame(labelled, "url string, verdict string"), 0.05, 0.9)
    named = lambda u: {names.get(t, t) for t in urls.url_tokens(u)}
    support = lambda items: [v for u, v in labelled if items <= named(u)]
    for items, verdict, confidence in rules:
        seen = support(items)
        assert len(seen) >= 15 and abs(seen.count(verdict) / len(seen) - confidence) < 1e-9 and confidence >= 0.9
    index = urls.RuleIndex(rules, names)
    for u in ["http://new.example.org/spam/7", "http://new.example.org/news/7", "http://other/"]:
        fits = [k for k, r in enumerate(rules) if r[0] <= named(u)]
        assert index.judge(urls.url_tokens(u))[0] == (rules[min(fits)][1] if fits else "allow")
    assert index.judge(urls.url_tokens("http://new.example.org/spam/7"))[0] == "block"


def test_no_labels_and_no_pages(spark):
    assert urls.judge(table(spark, ["http://x.net/a"] * 3), URL_RULES).where("verdict = 'allow'").count() == 3
    assert urls.judge(table(spark, []), URL_RULES).count() == 0


def test_long_queries_shared_by_many_pages_are_mined_as_one_token(spark):
    tail = "&".join(f"k{i}={i}" for i in range(40))
    rows = [(f"https://a.org/{i}?{tail}" if i % 2 else f"https://b.com/x{i}", "block" if i % 2 else "allow") for i in range(400)]
    rules, names = urls.mine(spark.createDataFrame(rows, "url string, verdict string"))
    assert len(rules) < 50 and len({names[f"key:k{i}"] for i in range(40)}) == 1
    index = urls.RuleIndex(rules, names)
    assert index.judge(urls.url_tokens("ftp://c.net/?k7=1"))[0] == "block" and index.judge(["host:com"])[0] == "allow"


def test_tokens_of_a_host_whose_lower_case_is_longer():
    assert "path:abc" in urls.url_tokens("http://İ.org/abc") and "path:abc" in urls.url_tokens("http://x.org/abc")
