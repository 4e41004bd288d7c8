"""Exact top-k and URL rules against brute force and SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from llm_helpers import SF, needs_data
from pyspark.sql import functions as F

import panelyard.llm.exact_topk as topk
from panelyard.llm.exact_topk import exact_topk, segment_bounds
from panelyard.llm.registry import ORACLE, QUERIES
from panelyard.llm.url_filters import filter_urls
from panelyard.llm import catalog  # noqa: F401


@needs_data
@pytest.mark.parametrize("name", ["op4_url_filters", "op8_exact_topk", "op10_warc"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, result = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)


def brute_topk(rows, k):
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or i % 100:
            continue
        found = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(whole) if a != b and len(w) == len(v)]
        out += [(i, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"QUERY_BLOCK": 3, "CANDIDATE_BLOCK": 20, "STEP": 7}])
def test_topk_awkward_rows(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(topk, name, value)
    draw = random.Random(1)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(0, 900, 10)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[0][1]), (200, None), (300, [None] * 6), (400, [float("nan")] * 6),
             (500, [float("inf")] * 6), (700, []), (800, []), (901, [1.0, 2.0]), (1000, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'r' as row")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = exact_topk(df, F.col("vec_id") % 100 == 0, k=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_topk(rows, 4)
    assert exact_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold():
    x = np.random.default_rng(0).integers(-900, 900, (50, 37))
    exact, last = x @ x.T, None
    for s in (1, 4, 16, 37, 64):
        bound = segment_bounds(x, s) @ segment_bounds(x, s).T
        assert (bound + 1e-6 >= exact).all()
        last = bound
    assert np.abs(last - exact).max() < 1e-3


def brute_rule(host, path, rules):
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if h is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")
        for p in [p or ""]
    ]
    return max(fits)[2:] if fits else (None, "allow")


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:cut].translate(low), tail[:end]


@pytest.mark.parametrize("range_rows", [250_000, 40])
def test_urls_awkward_rows(spark, range_rows):
    """With tiny ranges the stack is carried from range to range."""
    draw = random.Random(3)
    label, step = ["a", "b", "com", "net", "é", "x-y"], ["en", "fr", "e", "deep", ""]
    rules = [(".".join(draw.choices(label, k=draw.randint(1, 3))), "/" + "/".join(draw.choices(step, k=draw.randint(0, 3))), draw.choice(["allow", "block"]))
             for _ in range(60)]
    rules = [r for i, r in enumerate(rules) if r[:2] not in [x[:2] for x in rules[:i]]] + [(None, "/", "block"), ("net", None, "block"), ("a", "/q", None)]
    urls = ["http://" + ".".join(draw.choices(label, k=draw.randint(1, 5))) + "/" + "/".join(draw.choices(step, k=draw.randint(0, 4)))
            + draw.choice(["", "?q=/en/", "#top"]) for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://A.COM", "http://a.com?x", "ftp://b.com:80/en", "a://b://c/d", "http://a.com/\nen", "http://com/" + "e" * 5000]
    pages = [(i, u) for i, u in enumerate(urls)] + [(1, urls[1])] * 50 + [(None, urls[2])] * 3
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as verdict")
    got = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), range_rows=range_rows)
    want = [(i, *split_url(u), *brute_rule(*split_url(u), rules)) for i, u in pages]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_urls_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in filter_urls(pages, rules.limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]


def test_urls_use_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = filter_urls(pages, spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_hosts_of_many_labels(spark):
    """Only suffixes that some rule's host can equal are looked up."""
    long_host = "a." * 100_000 + "b.example.com"
    rows = [(1, f"http://{long_host}/x"), (2, "http://example.com/y"), (3, "http://c.d.example.com/x/z"), (4, None)] + [(5, "http://e.org/")] * 3
    rules = [("com", "", "allow"), ("b.example.com", "/x", "block"), ("c.d.example.com", "/x", "block"), ("example.com", "/y", "block")]
    made = filter_urls(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    ).collect()
    assert sorted((r.page_id, r.verdict) for r in made) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow")] + [(5, "allow")] * 3
    assert next(r.host for r in made if r.page_id == 1) == long_host


def test_a_product_beyond_64_bits_raises(spark):
    rows = [(0, [3e15, 3e15]), (1, [3e15, 3e15])]
    with pytest.raises(Exception, match="64 bits"):
        exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


@needs_data
def test_bounds_leave_few_exact_products(spark):
    """Half of the pairs of the given vectors, and whole steps where vectors come in clusters."""
    path = SF.replace("sf0.001", "sf0.1")
    x = np.floor(1024 * np.array([r[0] for r in spark.read.parquet(f"{path}/embeddings.parquet").select("embedding").collect()])).astype(np.int64)
    _, counts = topk.block_topk(x[::100], np.arange(0, len(x), 100), x, np.arange(len(x)), np.arange(len(x)), 10)
    assert counts["exact"] < 0.6 * counts["pairs"]
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(16, 64)).repeat(4, axis=1)[:, :64] * 400
    x = np.floor(centres[draw.integers(0, 16, 8000)] + draw.normal(size=(8000, 64)) * 20).astype(np.int64)
    best, counts = topk.block_topk(x[::100], np.arange(0, 8000, 100), x, np.arange(8000), np.arange(8000), 10)
    assert counts["steps"] > 0.5 * counts["pairs"] and counts["exact"] < 0.3 * counts["pairs"]
    scores = x[::100] @ x.T
    scores[np.arange(80), np.arange(0, 8000, 100)] = -(10**12)
    assert [[-b[0] for b in own] for own in best] == (-np.sort(-scores, axis=1)[:, :10]).tolist()
