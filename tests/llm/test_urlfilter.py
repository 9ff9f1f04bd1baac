import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import urlfilter as uf

RULES = "host string, path string, verdict string"
ODD = [None, "", "://", "no scheme", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net", "http://example.net?en/", "a://b://example.net/en/",
       "x://net/", "x://net/a", "x://a..net/", "x://.net/", "x://notexample.net/en/", "x://example.net:80/en/", "x://é.org/fr/é", "x://org/fr",
       "x://y.net/\n/en", "x\n://z.net/q", "x://" + "a." * 50_000 + "example.com/de/" + "p" * 100_000]


def plain(url, rules, default="allow"):
    """The same, rule by rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: x[:3], default=None)
    return host, path, best and best[2], best[3] if best else default


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, url_keys string")
    got = uf.judge(pages, spark.createDataFrame(rules, RULES), **more)
    assert got.columns == ["page_id", "url", "url_keys", "host", "path", "rule", "verdict"]
    return [tuple(r)[3:] for r in got.orderBy("page_id").collect()]


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    assert judged(spark, ODD, rules) == [plain(u, rules) for u in ODD]


@pytest.mark.parametrize("max_bytes", [uf.MAX_BYTES, 4000])
def test_long_lists_against_brute_force(spark, max_bytes):
    rng = random.Random(3)
    names = [f"h{i}" for i in range(40)]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(900))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(3000)] + ODD
    odd = [(None, "/", "block"), ("h1", None, "block"), ("", "/", "block"), ("h2", "/", None)]
    assert judged(spark, urls, rules + odd, max_bytes=max_bytes) == [plain(u, rules) for u in urls]


def test_no_rules_and_no_urls(spark):
    assert judged(spark, ["http://a/b"], []) == [("a", "/b", None, "allow")]
    assert judged(spark, [], [("net", "/", "block")]) == []


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id") + 1000).alias("key"))
    levels = uf.cascade(listed, universe.unionByName(universe))
    assert len(levels) > 2
    rows = universe.select("key", *uf._hashes(F.col("key"))).toPandas()
    found = uf.listed(levels, *[rows.iloc[:, i].to_numpy().view(np.uint64) for i in (1, 2)])
    assert [int(k[1:]) < 2000 for k in rows["key"]] == found.tolist()
    assert uf.cascade(listed.limit(0), universe) == []
    # Level by level fewer bits: each encodes what the one before mistakes.
    assert levels[-1].bits < levels[0].bits
