from __future__ import annotations

import random
import string
from collections import Counter
from itertools import combinations

from covaria.llm import urls
from covaria.llm.queries import QUERIES
from pyspark.sql import functions as F


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:end].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path[:stop]


def stated(host, path):
    best = None
    for verdict, rule in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return best or (None, None)


URLS = [None, "", "no address", "http://NET", "http://net/", "https://A.Example.NET/en/1", "https://example.net/en", "x://y.org/fr/",
        "http://org/fr/x?u=http://net/", "http://notnet/", "http://a.example.com/de/#f", "http://example.com?/de/", "a://b://net/",
        "http://İ.net/", "http://a\nb.net/x\ny?z", "://net/x", "http://net:80/", "http://u@net/"]


def judged(spark, rows, labels, **more):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    marks = spark.createDataFrame(labels, "page_id long, bad boolean")
    return urls.judged(pages, marks, **more)


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://net/"), (3, "http://net/")]
    got = judged(spark, rows, []).collect()
    assert len(got) == len(rows)
    for i, url in enumerate(URLS):
        host, path = split(url)
        rule, verdict = stated(host, path)
        assert (i, host, path, rule, verdict or "allow", False) in [tuple(r) for r in got], url
    assert judged(spark, [], []).collect() == []


def test_mined_rules_equal_brute_force(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        spam = draw.random() < 0.4
        host = draw.choice(["spam", "blog", "www"]) + draw.choice([".shop", ".edu"])
        url = f"http://{host}/{draw.choice(['buy', 'read'])}/{i}{draw.choice(['', '?ref=1', '?id=2'])}"
        bad = ("spam" in host and "buy" in url) if draw.random() < 0.9 else spam
        rows.append((i, url))
        if i < 250:
            labels.append((i, bad))
    labels.append((9999, True))
    got = {r["page_id"]: r["verdict"] for r in judged(spark, rows, labels, min_support=0.02, min_confidence=0.7).collect()}
    frame = spark.createDataFrame(rows, "page_id long, url string")
    url = F.col("url")
    items = {r[0]: frozenset(r[1]) for r in frame.select("page_id", urls.tokens(url, urls.host_of(url), urls.path_of(url))).collect()}
    bad = {i: b for i, b in labels if i in items}
    base = sum(bad.values()) / len(bad)
    every, wrong = Counter(), Counter()
    for i, mark in bad.items():
        for size in range(1, len(items[i]) + 1):
            for part in combinations(sorted(items[i]), size):
                every[part] += 1
                wrong[part] += mark
    found = [p for p in every if wrong[p] >= 0.02 * len(bad) and wrong[p] >= 0.7 * every[p] and wrong[p] / every[p] >= 1.5 * base]
    assert found
    assert got == {i: "block" if any(set(p) <= items[i] for p in found) else "allow" for i in items}


def test_query_on_all_pages(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op8_url_filter"](spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path = split(pages[r["page_id"]])
        rule, verdict = stated(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["mined"] else "allow"))
