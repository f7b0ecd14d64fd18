from __future__ import annotations

import re

from issueforge.llm import urls

URLS = [
    "http://A.Example.ORG/en/12?x#y", "https://example.org/en/2", "x://org/", "x://org", "x://forg/", "http://b.com/de/1", "http://b.com/fr",
    "http://b.com/fr/", "no scheme", "", None, "://", "http://h.net?q/en", "http://h.net#f", "a://b://c/d", "http://example.org/es/",
    "http://x.example.org:80/es/1", "http://x.com/de/\n1", "http://é.org/ü", "http://k.net/" + "a/" * 20_000, "http://k.net//a///b",
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url else None
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def check(spark, rows):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, n int")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        host, path, best = brute(by_id[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
        assert 0 <= r["badness"] <= 1
    return {r["page_id"]: r for r in got}


def test_odd_urls(spark):
    check(spark, list(enumerate(URLS)) + [(None, None)])
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_given_pages(spark, sf_dir):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect()]
    got = check(spark, rows)
    assert all(r["template"].count("/") <= urls.DEPTH and not re.search(r"[0-9]{2}", r["template"]) for r in got.values())


def test_templates_generalise_merge_and_judge(spark):
    rows = [f"http://s.net/tag/{a}{b}/x" for a in "abcdefghij" for b in "klmnop"]  # many names: one wildcard
    rows += [f"http://s.net/blog/{i}" for i in range(40)] + [f"http://s.net/news/{i}" for i in range(40)]
    rows += [f"http://s.net/spam/{i}" for i in range(40)] + ["http://s.net/spam/new", "http://s.net/blog/new", "http://other.net/x"]
    rules = tuple(urls.Rule(v, f"s.net/{p}/{d}") for v, p in (("allow", "blog"), ("allow", "news"), ("block", "spam")) for d in "1234")
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r for r in urls.judge(pages, rules).collect()}
    assert got["http://s.net/tag/ak/x"]["template"] == "/tag/*/x"
    assert got["http://s.net/spam/7"]["template"] == "/spam/{n}" and got["http://s.net/blog/7"]["template"] != "/spam/{n}"
    assert got["http://s.net/spam/7"]["verdict"] == "block" and got["http://s.net/spam/7"]["rule"] is None
    assert got["http://s.net/blog/7"]["verdict"] == "allow" and got["http://s.net/news/0"]["verdict"] == "allow"
    assert got["http://s.net/spam/new"]["verdict"] == "block" and got["http://s.net/blog/new"]["verdict"] == "allow"


def test_alike_branches_merge(spark):
    rows = [(f"h.net", f"/{p}/{i}", int(p in "ab"), int(p in "cd")) for p in "abcd" for i in range(1)]
    labels = spark.createDataFrame([(h, p, g * 50, b * 50) for h, p, g, b in rows], "host string, path string, good long, bad long")
    pages = spark.createDataFrame([(n, f"http://h.net/{p}/5") for n, p in enumerate("abcd")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, (), labels).collect()}
    assert got == {0: "allow", 1: "allow", 2: "block", 3: "block"}
    same = labels.withColumn("good", labels.good + labels.bad).withColumn("bad", labels.bad * 0)
    assert {r["template"] for r in urls.judge(pages, (), same).collect()} == {"/{same}/{n}"}
