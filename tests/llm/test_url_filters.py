"""URL filters: rules and redirect groups against plain Python and the query's SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pyarrow as pa
import pytest

from ledgerloom.llm import queries, url_filters
from ledgerloom.llm.components import components

PAGES = "page_id long, url string, html string, host string, node string, verdict string"


def split(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    query = re.match(r"(\?[^#]*)?", rest[len(host) + len(path) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, query


def rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)


def brute(pages, links, rules=url_filters.RULES):
    """pages: (id, url); links: pairs of urls."""
    name = lambda p: p[0] + (p[1] or "/") + p[2]
    place = {u: split(u) for u in [u for _, u in pages] + [u for x in links for u in x]}
    told = {u: rule(h, p or "/", rules) for u, (h, p, _) in place.items()}
    near = {}
    for a, b in links:
        if place[a][0] and place[b][0] and not any(told[x] and told[x][2] == "allow" for x in (a, b)):
            near.setdefault(name(place[a]), set()).add(name(place[b]))
            near.setdefault(name(place[b]), set()).add(name(place[a]))
    bad = {name(place[u]) for u, r in told.items() if r and r[2] == "block"}
    todo = list(bad)
    while todo:
        for x in near.get(todo.pop(), ()):
            if x not in bad:
                bad.add(x)
                todo.append(x)
    out = []
    for i, u in pages:
        h, p, q = place[u]
        r, known = rule(h, p, rules), told[u]
        out.append((i, h, p, r and r[0] + r[1], known[2] if known else "block" if h and name((h, p, q)) in bad else "allow"))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, df.collect()), key=repr)


URLS = ["http://a.example.com/x", "HTTPS://A.Example.COM/x#top", "http://a.example.com/x?q=1", "http://spam.net/in", "http://b.example.net/en/1", "http://b.example.net/de/1", "http://m.example.com/de/2", "http://m.example.com/en/2", "http://good.org/fr/3", "http://good.org/en/3", "http://example.net", "http://net/", "http://notexample.com/de/", "http://x.io/a/b?c=d&e=f", "http://x.io", "http://x.io/", "ftp://y.io/z", "no scheme", "http://", "http:///p", "://net/x", "http://h.com:80/de/", "http://.net/", "http://example.net./en/"]


def page(rng, url, target):
    kind = rng.randrange(6)
    ref = target.replace("&", "&amp;")
    return [
        f'<html><head><link rel="canonical" href="{ref}"></head>',
        f"<LINK href='{ref}' REL='nofollow Canonical' />",
        f'<meta http-equiv="refresh" content="0; url={ref}">',
        f"<META content=\"5;URL='{ref}'\" HTTP-EQUIV=Refresh>",
        f'<link rel=stylesheet href="/s.css"><link data-x="1" rel=canonical href={ref}>',
        f'<a href="{ref}">x</a> <link rel="canonicalised" href="http://spam.net/"><meta http-equiv="refresh" content="30"><link rel="canonical" href="#here"><link rel=canonical href="mailto:a@b">',
    ][kind], kind < 5


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    pages, links = [], []
    urls = URLS + [f"http://s{i}.io/p{i % 7}" for i in range(60)]
    for i in range(300):
        u, t = rng.choice(urls), rng.choice(urls)
        html, linked = page(rng, u, t) if "://" in t and rng.random() < 0.5 else (None if i % 3 else "<p>", False)
        pages.append((i, u, html))
        if linked:
            links.append((u, t))
    return pages, links


def test_matches_brute_force(spark, made):
    pages, links = made
    docs = spark.createDataFrame([(*p, "h", "n", "v") for p in pages], PAGES).repartition(5)
    expect = brute([p[:2] for p in pages], links)
    assert found(url_filters.filter_urls(docs)) == expect
    assert {x[4] for x in expect if x[3] is None} == {"allow", "block"}
    con = duckdb.connect()
    given = pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": pa.array([p[2] for p in pages], pa.string())})  # noqa: F841
    con.execute("create view pages as select * from given")
    assert sorted(con.execute(queries.ORACLES["op11_url_filters"]).fetchall(), key=repr) == expect


@pytest.mark.parametrize("broadcast_bytes", [0, 32 << 20])
def test_long_chains_hubs_and_given_redirects(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", broadcast_bytes)
    chain = [(f"http://c{i}.io/", f"http://c{i + 1}.io/") for i in range(40)] + [("http://c40.io/", "http://bad.test/x/y")]
    hub = [(f"http://w{i}.io/?p={i}", "http://hub.io/") for i in range(500)]
    cut = [("http://bad.test/x/1", "http://ok.test/x/z"), ("http://alias.io/", "http://ok.test/x/z")]
    rules = (("test", "/x/", "block"), ("ok.test", "/x/z", "allow"), ("w7.io", "/", "block"))
    links = chain + hub + cut
    pages = list(enumerate(dict.fromkeys(u for x in links for u in x))) + [(None, "http://c3.io"), (None, None), (5000, "http://free.io/")]
    docs = spark.createDataFrame(pages, "page_id long, url string")
    got = found(url_filters.filter_urls(docs, url_filters.rule_table(spark, rules), spark.createDataFrame(links, "source string, target string").repartition(4)))
    assert got == brute(pages, links, rules)
    verdicts = {p[1]: v[4] for p in pages for v in got if v[0] == p[0]}
    assert verdicts["http://c0.io/"] == verdicts["http://w499.io/?p=499"] == "block" and verdicts["http://alias.io/"] == "allow"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "<link rel=canonical href='http://spam.net/'>"), (None, "http://q.io/a", "<link rel=canonical href='//spam.net/x'>"), (3, "http://q.io/a#b", None), (4, "http://q.io/b", "<link rel=canonical href=a>"), (4, "http://q.io/b", "<link rel=canonical href=a>"), (5, "http://q.io/c", "<link rel=canonical href='/a'>" + "x" * 2_000_000), (6, "http://q.io/" + "y" * 500_000, "<link " * 200_000), (7, "http://q.io/d", "<meta http-equiv=refresh content='0;url=?e'>"), (8, "http://q.io/d?e", "<link rel=canonical href='http://spam.net'>")]
    docs = spark.createDataFrame([(*r, "h", "n", "v") for r in rows], PAGES).repartition(3)
    got = found(url_filters.filter_urls(docs))
    assert sorted((r[0], r[4]) for r in got if r[0] is not None) == [(1, "allow"), (2, "allow"), (3, "block"), (4, "block"), (4, "block"), (5, "block"), (6, "allow"), (7, "block"), (8, "block")]
    assert [r[4] for r in got if r[0] is None] == ["block"]
    assert found(url_filters.filter_urls(spark.createDataFrame([], PAGES))) == []


def test_components_of_text_nodes(spark):
    pairs = [("b", "a"), ("c", "b"), ("x", "y")] + [("m", f"k{i}") for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a string, b string")).collect()))
    assert got["c"] == got["a"] == "a" and got["y"] == "x" and got["m"] == got["k7"] == "k0"
