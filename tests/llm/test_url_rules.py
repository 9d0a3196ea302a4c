"""URL rules against plain string comparison."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.llm import url_rules as U


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def taken_apart(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host, rest = rest[: ends[0]], rest[ends[0] :]
    stops = [i for i, c in enumerate(rest) if c in "?#"] + [len(rest)]
    return lower(host), rest[: stops[0]]


def brute(pages, rules, default="allow"):
    out = []
    for i, url in pages:
        host, path = taken_apart(url)
        fits = [
            (len(h) + len(p or ""), len(h), v, lower(h) + (p or ""))
            for v, h, p in rules
            if h is not None and v is not None and (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p or "")
        ]
        _, _, verdict, rule = max(fits) if fits else (0, 0, default, None)
        out.append((i, host, path, rule, verdict))
    return Counter(out)


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTPS://WWW.Example.COM/en/1?q=/x#f", "http://example.com/en/",
    "http://example.com/EN/", "http://example.com/en", "http://a.b.example.com//en//x", "http://notexample.com/en/1", "http://user@x.net:80/fr/1",
    "http://x.net/fr/1", "http://x.net/es/?a", "http://x.net#/es/", "http://x.net?/es/", "http://.com/", "http://com./", "http://a..com/p",
    "ftp://x://y.com/z", "http://É.com/é/日本/x", "http://x.org/" + "a/" * 4000 + "end", "http://" + "l." * 3000 + "net/es/deep",
]


def judged(spark, pages, rules):
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    return Counter(tuple(r) for r in U.judge(frame, table, ["page_id"]).collect())


def test_awkward_urls(spark):
    pages = [*enumerate(URLS), (None, "http://com/x"), (3, None), (3, None)]
    assert judged(spark, pages, U.RULES) == brute(pages, U.RULES)
    assert judged(spark, pages, []) == brute(pages, [])
    assert judged(spark, [], U.RULES) == Counter()


@pytest.mark.parametrize("many", [False, True])
def test_random_rules(spark, monkeypatch, many):
    if many:  # as if there were more rules and matches than may be sent
        monkeypatch.setattr(common, "SEND_BYTES", 0)
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "A.com", "net", "b.net", "c.b.net", "org", ""]
    parts = ["/", "/x", "/x/", "/xy", "/x/y", "/x/yz/", "", "/é", "x"]
    rules = [(rng.choice(["allow", "block", "other"]), rng.choice(hosts), rng.choice(parts)) for _ in range(60)]
    rules += [("block", None, "/"), (None, "com", "/"), ("block", "b.net", None), *rules[:5]]
    pages = [(i, f"http://{rng.choice(['', 'z.', 'q.z.'])}{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(parts)}") for i in range(400)]
    pages += [(i, "http://q.a.com/x/yz/1") for i in range(400)]
    assert judged(spark, pages, rules) == brute(pages, rules)


def test_other_columns_and_clashes(spark):
    pages = spark.createDataFrame([(1, "http://x.com/", "k", 2)], "page_id bigint, url string, prefix string, full int")
    rules = spark.createDataFrame(U.RULES, "verdict string, host string, path string").withColumn("rule", F.lit("r")).withColumn("labels", F.lit(1))
    row = U.judge(pages, rules, ["page_id", "prefix", "full"]).first()
    assert tuple(row) == (1, "k", 2, "x.com", "/", "com/", "allow")
    with pytest.raises(ValueError):
        U.judge(pages.withColumn("Host", F.lit("h")), rules, ["page_id", "Host"])
