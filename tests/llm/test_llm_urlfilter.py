"""URL filter: rules against a plain reading, propagation against dense matrices."""

import random
import re

import numpy as np
import pytest

from newsloom.llm import urlfilter

ROWS = "page_id long, url string, html string, host string, path string, verdict string, a string"


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    name, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (name == h or name.endswith("." + h)) and path.startswith(p)]
    return name, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, (u, h) in enumerate(rows)], ROWS)


def test_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://Com/", "http://com", "http://a.COM?x/", "http://example.com/en/1", "http://www.example.com/en/",
            "http://xexample.com/en/1", "https://m.x.net/es/1#q", "http://net/fr/", "http://x.net/en", "http://x.org/es/", "a://b://c.com/en/", "http://É.com/x", "http://x.net/es"]
    html = ["", None, "<a href=broken", "x" * 200_000]
    rows = [(u, html[k % 4]) for k, u in enumerate(urls * 2)]
    found = urlfilter.judge(pages(spark, rows), urlfilter.rule_table(spark))
    assert found.columns == [*pages(spark, rows).columns, "_url"]
    got = {r["page_id"]: r["_url"] for r in found.collect()}
    assert len(got) == len(rows)
    for i, (url, _) in enumerate(rows):
        host, path, rule, verdict = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict is None and got[i]["verdict"] in ("allow", "block")


def test_propagation(spark):
    deal = random.Random(3)
    names = [f"h{k}.org" for k in range(30)]
    rows = [(f"http://{a}/{k}", "".join(f"<a HREF='//{b.upper()}:80/z'>x</a><img src=http://u@{b}/i>" for b in deal.choices(names, k=3))) for k, a in enumerate(names[:25] * 2)]
    rules = [("allow", "h0.org", "/"), ("block", "h1.org", "/"), ("block", "h2.org", "/"), ("block", "h3.org", "/3")]
    edges = {(a, b) for (u, h) in rows for a in [u.split("/")[2]] for b in {x.lower() for x in re.findall(r"h\d+\.org", h, re.I)} if a != b}
    at = {n: k for k, n in enumerate(names)}

    def ranks(links, seed, rounds=20):
        m = np.zeros((30, 30))
        for a, b in links:
            m[at[b], at[a]] = 1
        out = m.sum(0)
        m = np.where(out > 0, m / np.maximum(out, 1), np.eye(30))
        r = seed.copy()
        for _ in range(rounds):
            r = 0.15 * seed + 0.85 * m @ r
        return r
    allowed, blocked = np.zeros(30), np.zeros(30)
    allowed[0], blocked[[1, 2, 3]] = 1, [1, 1, 0.5]
    trust, distrust = ranks(edges, allowed), ranks({(b, a) for a, b in edges}, blocked)
    found = urlfilter.judge(pages(spark, rows), urlfilter.rule_table(spark, rules), threshold=0.02).collect()
    for r in found:
        u, k = r["_url"], at[r["_url"]["host"]]
        assert u["trust"] == pytest.approx(trust[k]) and u["distrust"] == pytest.approx(distrust[k])
        if u["rule"] is None:
            assert u["verdict"] == ("block" if distrust[k] - trust[k] > 0.02 else "allow")
    assert {r["_url"]["verdict"] for r in found if r["_url"]["rule"] is None} == {"allow", "block"}


def test_empty(spark):
    assert urlfilter.judge(pages(spark, []), urlfilter.rule_table(spark)).count() == 0
