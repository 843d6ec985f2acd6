import random

from thresher.llm import urls
from thresher.llm.urls import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("A.com", "", "block")]
URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://X.Example.ORG/en/1?x#y", "http://.org/a",
        "https://a.com", "a://a.com/fr/x", "http://b.a.com#f/de/", "http://xa.com/de/", "http://com/de/", "http://com/d",
        "http://u@example.org:8080/es/", "http://example.org/es/", "http://example.org/ES/", "x://example.org/en/19",
        "http://a//b://c/", "http://example.org?/es/", "http://" + "a." * 5000 + "org/" + "p" * 5000]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else "allow")


def test_against_every_rule(spark, monkeypatch):
    random.seed(2)
    pages = [(i if i % 5 else None, u, "h") for i, u in enumerate(URLS * 2)]
    pages += [(i, f"http://{random.choice(['a', 'b.c', 'x.example'])}.{random.choice(['org', 'com', 'net'])}"
                  f"/{random.choice(['es', 'en', 'fr', 'de'])}/{random.randint(0, 200)}", "h") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, rule_host string")
    rules = spark.createDataFrame(RULES + [("bad", None, "block")], "host string, path string, verdict string")
    expected = sorted(((p, *brute(u)) for p, u, _ in pages), key=str)
    for blocks in (urls.MIN_BLOCKS, 1):                     # one block: the filter lets nearly all through
        monkeypatch.setattr(urls, "MIN_BLOCKS", blocks)
        monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
        got = judge_urls(df, rules).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == expected
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(df, rules.limit(0)).collect()} == {"allow"}
