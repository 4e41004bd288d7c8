"""Product codes against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

import panelyard.llm.vector_codes as codes
from panelyard.llm.vector_codes import coefficients, nearest, sequency_matrix, vector_codes

KIND = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) by Python loops, for vectors of one length."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in kept]
    if not whole:
        return []
    width = -(-len(whole[0][1]) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    order = sorted(range(len(whole)), key=lambda j: (whole[j][0] is None, whole[j][0] or 0, [float(x) for x in kept[j][1]]))
    books = [[cut[j][p] for j in order[:entries]] for p in range(parts)]

    def assign(j, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut[j][p], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for j in range(len(whole)):
                members.setdefault(assign(j, p)[1], []).append(cut[j][p])
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[assign(j, p) for p in range(parts)] for j in range(len(whole))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(whole, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[lab], digest) for (i, _, lab), f, e in zip(whole, found, errors)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n,d,spread", [(40, 8, 1.0), (300, 12, 0.02), (270, 64, 5.0), (260, 10, 1e15)])
def test_against_loops(spark, n, d, spread):
    draw = random.Random(n + d)
    rows = [(i, [draw.gauss(0, spread) / 3 for _ in range(d)] if i % 3 else [0.0] * (d - 1) + [draw.choice([-1.0, 1.0])], draw.choice([None, 1, 2])) for i in range(n)]
    if spread > 1e12:   # errors beyond 64 bits raise; levels that large do not
        rows = [(i, [1e15 + round(x / 1e15) for x in v], lab) for i, v, lab in rows]
    draw.shuffle(rows)
    made = vector_codes(spark.createDataFrame(rows, KIND).repartition(3))
    assert made.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(made) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0, 2.0], 1), (1, [0.5, -0.25, 1.0, 2.0], 1), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], None),
            (4, [None, 0.0, 0.0, 0.0], 2), (5, [0.0, inf, 0.0, 0.0], 2), (None, [1.0, 1.0, 1.0, 1.0], None), (6, [-0.0001, 0.0, 0.0, 0.0], None),
            (None, [0.0, 1.0, 1.0, 1.0], None)]
    clash = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as code", "2 as error", "3 as d", "'x' as codebooks_sha256")
    assert got(vector_codes(clash)) == plain(rows)
    assert vector_codes(clash.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, [], 1), (2, [1.0], 1), (3, [1.0, 2.0], 2), (4, [], None)], KIND)
    by_id = {r.vec_id: r for r in vector_codes(mixed).collect()}
    assert set(by_id) == {1, 2, 3, 4} and by_id[1].code == "00000000" and by_id[1].error == 0
    assert by_id[2].codebooks_sha256 != by_id[3].codebooks_sha256


def test_error_beyond_64_bits_raises(spark):
    rows = [(i, [0.0, 0.0, 0.0, float(10**16 * (i % 7))], 1) for i in range(300)]
    with pytest.raises(Exception, match="(?i)int|overflow|long"):
        vector_codes(spark.createDataFrame([(i, [x * (i + 1) for x in v], lab) for i, v, lab in rows], KIND)).collect()


def test_transform_keeps_distances_and_prunes():
    h = sequency_matrix(16)
    assert ((h[:, 1:] != h[:, :-1]).sum(axis=1) == np.arange(16)).all()
    draw = np.random.default_rng(3)
    x, y = draw.integers(-5000, 5000, (50, 16)), draw.integers(-5000, 5000, (256, 16))
    assert (((coefficients(x) - coefficients(y[:50])) ** 2).sum(axis=1) == 16 * ((x - y[:50]) ** 2).sum(axis=1)).all()
    smooth = np.cumsum(draw.integers(-50, 50, (2000, 16)), axis=1)
    index, distance, whole = nearest(smooth, smooth[:256])
    every = ((smooth[:, None, :] - smooth[None, :256, :]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert whole < 0.2 * every.size   # most entries fall on their first coefficients


def test_ties_go_to_the_lower_entry():
    index, distance, _ = nearest(np.array([[0, 0], [3, 3]]), np.array([[1, 0], [0, 1], [-1, 0], [3, 3], [3, 3]]))
    assert index.tolist() == [0, 3] and distance.tolist() == [1, 0]
