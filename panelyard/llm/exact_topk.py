"""Operator 8, exact top-k search by inner product, pruned by multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation (the norm of what is left
after the mean). For two vectors the inner product is at most the sum over segments of
length x mean x mean' + deviation x deviation' (Cauchy-Schwarz), which is the same as a lower
bound of their distance. Bounds go from few segments to many, each for the pairs that the one
before left open; a pair that could still be among the k best after the finest gets its exact
integer product, and no other pair does. Before that, a step of candidates (put in order by the
signs of their coarse means, so that like ones lie together) falls as a whole for every query whose
bound against the step's envelope, the ranges of its means and its largest deviations, is too low.

Queries and candidates are dealt to blocks; a candidate goes once to each block of queries.
Each pair of blocks is one group of bounded size that returns k rows per query; those are
ranked in a last step.

Defined results. A vector that is NULL or holds a NULL, NaN or infinite component takes no part,
neither as query nor as candidate. Components become floor(1024 x), as whole numbers; vectors
meet those of their own length only (empty ones have score 0). A query meets every row but its
own: rows that repeat its id are candidates. Repeated query rows give repeated results. Ties go
to the smaller id, a NULL id last. NULL ids are no queries. Fewer candidates than k give all. An
empty table gives an empty table. A product beyond 64 bits raises. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.common import parts_for, stored
from panelyard.llm.registry import query

SCALE = 1024
K = 10
SEGMENTS = (4, 16, 32)   # coarse to fine
PAIRS = 1 << 16          # pairs multiplied at once
SEEDS = 20               # times k: candidates of a query that are multiplied first
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
STEP = 128               # candidates bounded at once, with the thresholds of those before


def whole_numbers(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(vector: str) -> Column:
    """No NULL, NaN or infinite component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def segment_bounds(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the vectors: scaled means, then deviations."""
    d = x.shape[1]
    edges = np.linspace(0, d, min(segments, max(1, d)) + 1).astype(int)
    means, deviations = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = x[:, lo:hi].astype(np.float64)
        mean = part.mean(axis=1, keepdims=True) if hi > lo else np.zeros((len(x), 1))
        means.append(mean[:, 0] * np.sqrt(hi - lo))
        deviations.append(np.sqrt(((part - mean) ** 2).sum(axis=1)))
    return np.stack(means + deviations, axis=1)


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the rows a[i] and b[j]: in floating point where that is exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    out = np.zeros(len(i), dtype=np.int64)
    kind = np.float64 if most < 2**53 else object
    a, b = a.astype(kind), b.astype(kind)
    for lo in range(0, len(i), PAIRS):
        part = slice(lo, lo + PAIRS)
        if kind is object:
            exact = (a[i[part]] * b[j[part]]).sum(axis=1)
            if any(abs(v) >= 2**63 for v in exact):
                raise OverflowError("an inner product exceeds 64 bits")
        else:
            exact = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
        out[part] = exact.astype(np.int64)
    return out


def sign_order(coarse: np.ndarray) -> np.ndarray:
    """Candidates by the signs of their coarse means, then by the first mean."""
    means = coarse[:, :max(1, coarse.shape[1] // 2)]
    bits = (means > 0) @ (1 << np.arange(means.shape[1]))
    return np.lexsort((means[:, 0], bits))


def block_topk(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, k: int):
    """Each query's k best as sorted (-score, id's rank, candidate index), and what was compared: pairs
    in all, pairs whose step fell as a whole, and pairs with an exact product. ``c_id`` holds the ids'
    rank order for ties."""
    n, counts = len(q), {"pairs": len(q) * len(c), "steps": 0, "exact": 0}
    best = [[] for _ in range(n)]
    least = np.full(n, -np.inf)                # the k-th best score so far
    levels = [(segment_bounds(q, s), segment_bounds(c, s)) for s in SEGMENTS]
    slack = 1e-9 * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) + 1e-6
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    seen = q_row[:, None] == c_row[None, :]    # pairs that need no product, or no other one

    def take(i: np.ndarray, j: np.ndarray) -> None:
        """Products of pairs, ordered by query, into the queries' best."""
        counts["exact"] += len(i)
        score = pair_products(q, c, i, j)
        good = score >= least[i]
        i, j, score = i[good], j[good], score[good]
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            query, hit = i[a], np.arange(a, b)
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
            merged = best[query] + [(-int(score[h]), int(c_id[j[h]]), int(j[h])) for h in hit]
            merged.sort()
            best[query] = merged[:k]
            if len(best[query]) == k:
                least[query] = -best[query][-1][0]

    # The most promising candidates by the finest bounds first: after them the k-th best score of
    # most queries is near its last value.
    eq, ec = levels[-1]
    m = min(SEEDS * k, len(c) - 1)
    for lo in range(0, n, 128) if m > 0 else ():
        top = np.argpartition(-(eq[lo:lo + 128] @ ec.T), m, axis=1)[:, :m]
        i, j = np.repeat(np.arange(lo, lo + len(top)), m), top.ravel()
        new = ~seen[i, j]
        take(i[new], j[new])
        seen[i, j] = True
    order = sign_order(levels[0][1])
    for lo in range(0, len(c), STEP):
        own = order[lo:lo + STEP]
        # The envelope: per segment the better end of the means, and the largest deviation.
        rows = np.arange(n)
        for eq, ec in levels[:-1]:
            half, part = eq.shape[1] // 2, ec[own]
            high, low = part[:, :half].max(axis=0), part[:, :half].min(axis=0)
            mean = eq[rows, :half]
            bound = np.maximum(mean * high, mean * low).sum(axis=1) + eq[rows, half:] @ part[:, half:].max(axis=0)
            rows = rows[bound + slack[rows] * (1.0 + norm[own].max()) >= least[rows]]
        counts["steps"] += (n - len(rows)) * len(own)
        if not len(rows):
            continue
        i, j = None, None
        for eq, ec in levels:
            if i is None:
                open_ = eq[rows] @ ec[own].T + slack[rows][:, None] * (1.0 + norm[own])[None, :] >= least[rows][:, None]
                open_ &= ~seen[np.ix_(rows, own)]
                x, y = np.nonzero(open_)
                i, j = rows[x], own[y]
            elif len(i) * 4 > len(rows) * len(own):   # most pairs are open: all products at once
                bound = (eq[rows] @ ec[own].T)[x, y]
                alive = bound + slack[i] * (1.0 + norm[j]) >= least[i]
                x, y, i, j = x[alive], y[alive], i[alive], j[alive]
            else:
                alive = np.concatenate([
                    np.einsum("ij,ij->i", eq[i[p:p + PAIRS]], ec[j[p:p + PAIRS]]) + slack[i[p:p + PAIRS]] * (1.0 + norm[j[p:p + PAIRS]]) >= least[i[p:p + PAIRS]]
                    for p in range(0, len(i), PAIRS)
                ]) if len(i) else np.zeros(0, dtype=bool)
                x, y, i, j = x[alive], y[alive], i[alive], j[alive]
        take(i, j)
    return best, counts


def matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table's column x, all of one length."""
    lists = table.column("x").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(table.num_rows, -1)


def search_groups(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            q, c = matrix(queries), matrix(candidates)
            ids = candidates.column("id").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), dtype=np.int64)
            place[order] = np.arange(len(ids))
            q_row, q_id = queries.column("row").to_numpy(), queries.column("id").to_pylist()
            for i, found in enumerate(block_topk(q, q_row, c, candidates.column("row").to_numpy(), place, k)[0]):
                for score, _, j in found:
                    out["row"].append(q_row[i])
                    out["query_id"].append(q_id[i])
                    out["vec_id"].append(ids[j])
                    out["score"].append(-score)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def exact_topk(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable("v")).select("id", "asks", whole_numbers("v").alias("x"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("x")))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    query_blocks = parts_for(sizes["q"], QUERY_BLOCK)
    slices = parts_for(sizes["n"], CANDIDATE_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.filter("asks").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")).withColumn("slice", every(slices))
    offered = rows.withColumn("slice", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(slices)).cast("int")).withColumn("block", every(query_blocks))
    found = asked.groupBy("d", "block", "slice").cogroup(offered.groupBy("d", "block", "slice")).applyInArrow(
        search_groups(k), "row long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank
  FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of all vectors for every hundredth one."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
