"""Chosen-path join against all pairs."""

import random
from collections import Counter

from llm_helpers import SF, awkward_docs, needs_data, words
import numpy as np
import pyarrow as pa
import pytest

import panelyard.llm.ngram_join as join
from panelyard.llm import components
from panelyard.llm.components import connected_components
from panelyard.llm.ngram_join import miss_probability, near_duplicates, one_per_class, op7_ngram_join


def brute(rows):
    """(class, links, copies) of each row by all pairs of rows that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    where, links, parent = {}, Counter(), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x]).items():
            if j != i and n / (len(s) + len(sets[j]) - n) >= 0.8:
                links[i] += 1
                parent[root(i)] = root(j)
    classes = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            classes[root(i)] = min(key, classes.get(root(i), key))
    return sorted(((key, classes.get(root(i)), links[i]) for i, (key, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


@needs_data
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op7_ngram_join(spark, SF)) == brute(rows)


def edited(base, n, draw):
    out = base.split()
    for _ in range(n):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("limits", [{}, {"LEAF": 4, "BLOCK": 16, "BLOCK_RECORDS": 8, "TASK_SHINGLES": 5000}])
def test_groups_of_near_copies_and_common_passages(spark, monkeypatch, limits):
    """With tiny limits large buckets and components go in pairs of blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(join, name, value)
    draw = random.Random(4)
    passage, rows = words(30, base="common"), []
    for g in range(4):
        base = " ".join(f"g{g}x{draw.randrange(10**6)}" for _ in range(200))
        rows += [edited(base, draw.randrange(0, 5), draw) for _ in range(30)] + [base] * 5
    rows += [passage + " " + " ".join(f"u{draw.randrange(10**9)}" for _ in range(120)) for _ in range(60)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df)) == brute(rows)


def test_awkward_rows(spark):
    docs = awkward_docs(spark).selectExpr("*", "1 as class_id", "2 as n_links", "3 as set_key")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs)) == brute(rows)
    kept = one_per_class(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 1, both rows of 2 and 9 are one class; texts without words and single ones stay.
    assert ids == sorted([1, 3, 4, 5, 6, 7, 8, 10, 11, None], key=repr)
    assert near_duplicates(docs.limit(0)).count() == 0 and one_per_class(docs.limit(0)).count() == 0


def test_rows_of_one_id_keep_one(spark):
    rows = [(5, words(50)), (5, words(50)), (5, words(50, 900)), (7, words(50)), (8, None), (8, None)]
    kept = one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == sorted([(5, words(50)), (5, words(50, 900))])
    assert [r.doc_id for r in kept if r.text is None] == [8, 8]


def test_components(spark):
    draw, edges = random.Random(2), [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)]
    edges = [(a * 7 % 1009, b * 7 % 1009) for a, b in edges]
    draw.shuffle(edges)
    odd = [(None, 5), (5, None), (3, 3), *edges[:5], *((b, a) for a, b in edges[:5])]
    labels = {r.node: r.label for r in connected_components(spark.createDataFrame(edges + odd, "a long, b long")).collect()}
    first = {a * 7 % 1009 for a in range(41)}
    assert {labels[x] for x in first} == {min(first)} and len(set(labels.values())) == 2
    assert connected_components(spark.createDataFrame(odd[:3], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_long_chains(spark, order):
    """One chain of 10^4 nodes, whichever way its ids run."""
    n = 10_000
    ids = list(range(n)) if order != "falling" else list(range(n, 0, -1))
    if order == "shuffled":
        random.Random(7).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:])), "a long, b long")
    labels = connected_components(edges).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in labels] == [(min(ids), n)]


def test_stars_connect_what_a_chunk_connected(monkeypatch):
    """Stars of every chunk: same components, no more edges than before, few chunks held."""
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(350)]
    edges = [(a, b) for a, b in edges if a != b] + [(7, 9), (9, 7)]
    place = {i: draw.randrange(-50, 50) for i in range(400)}   # many equal places
    rows = {"a": [a for a, _ in edges], "b": [b for _, b in edges], "da": [place[a] for a, _ in edges], "db": [place[b] for _, b in edges]}
    monkeypatch.setattr(components, "CHUNK", 40)
    batches = list(pa.table(rows).to_batches(max_chunksize=20))
    made = [tuple(r.values()) for batch in components.star_task(iter(batches)) for r in batch.to_pylist()]

    def parts(pairs):
        left, right = (np.array([p[i] for p in pairs]) for i in (0, 1))
        return components.roots(400, left, right).tolist()

    assert parts(made) == parts(edges) and len(made) <= len(edges)
    assert list(components.star_task(iter([]))) == []
    named = pa.RecordBatch.from_pydict({"a": ["x", "y"], "b": ["y", "z"], "da": [3, 1], "db": [1, 2]})
    assert sorted(tuple(r.values()) for batch in components.star_task(iter([named])) for r in batch.to_pylist()) == [("x", "y"), ("z", "y")]


def test_large_group_of_near_copies_is_not_split(spark, monkeypatch):
    """3000 near copies beside 3000 other texts: links of all pairs, and few path rows."""
    draw = random.Random(11)
    base = " ".join(f"b{i}" for i in range(300))
    texts = [edited(base, draw.randrange(1, 7), draw) for _ in range(3000)]
    texts += [" ".join(f"o{draw.randrange(10**9)}" for _ in range(40)) for _ in range(3000)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    column = {x: j for j, x in enumerate(sorted(x for x, n in Counter(x for s in sets for x in s).items() if n > 1))}
    held = np.zeros((len(sets), len(column)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [column[x] for x in s if x in column]] = 1
    common, sizes = held @ held.T, np.array([len(s) for s in sets])
    near = common / (sizes[:, None] + sizes[None, :] - common) >= 0.8 - 1e-9
    links = near.sum(axis=1) - near.diagonal()
    assert links[:3000].min() < 2900 < links[:3000].max()   # not simply all with all
    paths, split = [], join.searched_and_split

    def counted(rows, *rest):
        leaves, deep = split(rows, *rest)
        paths.append((sum(leaf.count() for leaf in leaves), 0 if deep is None else deep.count()))
        return leaves, deep

    monkeypatch.setattr(join, "searched_and_split", counted)
    made = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in made} == dict(enumerate(links.tolist()))
    assert {r.class_id for r in made if r.doc_id < 3000} == {0}
    rows, deep = (sum(p[i] for p in paths) for i in (0, 1))
    assert rows < 12 * 3000 and deep < 3000, paths


def test_recall_bound():
    assert miss_probability(1, 0.8) < miss_probability(2, 0.8) < miss_probability(4, 0.8) < 0.75


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_stated_recall_counts_cut_and_spread(depth):
    """Simulated pairs at the threshold: one number of equal tokens for all runs, cut included."""
    least = join.candidate_cut(0.8, 0.999)
    runs = 1
    while miss_probability(runs * [depth], 0.8, least) > 0.001:
        runs += 1
    equal = np.random.default_rng(1).binomial(join.TOKENS, 0.8, 2_000_000)
    found = np.ones(len(equal))
    for _ in range(depth):
        found = 1 - (1 - found / (0.8 * join.TOKENS)) ** equal
    assert np.mean(equal < least) < 0.0002
    assert np.mean(np.where(equal < least, 1.0, (1 - found) ** runs)) < 0.00107


def test_recall_out_of_reach_is_refused(spark):
    rows = spark.createDataFrame([(1, words(20)), (2, words(20))], "doc_id long, text string")
    with pytest.raises(ValueError):
        near_duplicates(rows, recall=1.0)
