"""Operator 12, vector code compression: product codes by whole numbers, searched in Hadamard order.

Components become floor(1024 x); a vector is cut into PARTS equal consecutive parts, each coded by
the nearest of at most ENTRIES codebook entries (squared Euclidean distance, ties to the lower
index). Parts and entries are filled up with zeros to a power of two, P, and go through the
integer Walsh-Hadamard transform H: |Hx - Hy|^2 = P |x - y|^2, so sums of squared differences of
coefficients, taken in sequency order (slow changes first, where most of a vector's energy lies),
only grow towards P times the distance. After each group of coefficients an entry whose sum
exceeds the whole sum of the entry that led so far is out. All of it is done in whole numbers.

Each training round is one pass over the rows: a task adds its own parts up by entry and emits
one sum vector and count per entry, Spark adds those. Only codebooks (ENTRIES x length numbers)
reach the driver and go out with the next round's function.

Defined results. Vectors NULL or holding a NULL, NaN or infinite component are left out. The
starting entries are the parts of the ENTRIES smallest ids, ascending; ids NULL come last, equal
ids go by their components. Fewer rows give fewer entries. Rows of each vector length have
codebooks of their own; a length that PARTS does not divide is filled up with zeros. A vector of
length 0 has the code of entry 0 and error 0. Repeated rows count each. NULL labels are one
label. An error beyond 64 bits raises. An empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import stored
from panelyard.llm.exact_topk import usable
from panelyard.llm.registry import query

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096             # parts compared with a codebook at once
CELLS = "d int, part int, entry int, position int, total decimal(38,0), n long"


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(1024 x) of each number: 64-bit where the values are small, else Python's own."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2.0**52:
        return scaled.astype(np.int64)
    return np.array([math.floor(v) * SCALE + math.floor((v - math.floor(v)) * SCALE) for v in flat.astype(np.float64).tolist()], dtype=object)


def sequency_matrix(size: int) -> np.ndarray:
    """Hadamard matrix of a power of two, rows by their number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def coefficients(parts: np.ndarray) -> np.ndarray:
    """Transform of the rows, filled up with zeros; columns in sequency order."""
    width = parts.shape[1]
    size = 1 << max(0, width - 1).bit_length()
    matrix = sequency_matrix(size)[:, :width].T
    return parts @ (matrix if parts.dtype != object else matrix.astype(object))


def safe_kind(parts: np.ndarray, entries: np.ndarray):
    """64-bit whole numbers where no sum of squares can leave them, else Python's own."""
    most = max((abs(int(a.max(initial=0))) for a in (parts, -parts, entries, -entries)), default=0)
    size = 1 << max(0, parts.shape[1] - 1).bit_length()
    return np.int64 if (2 * most * size) ** 2 * size < 2**63 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each part, and how many entries were
    compared to the last coefficient."""
    n, width = parts.shape
    if width == 0 or n == 0:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    kind = safe_kind(parts, entries)
    x, y = coefficients(parts.astype(kind)), coefficients(entries.astype(kind))
    size, k = x.shape[1], len(y)
    edges = [0] + [e for e in (4 << i for i in range(60)) if e < size] + [size]
    groups = list(zip(edges[:-1], edges[1:]))
    lo, hi = groups[0]
    sums = np.zeros((n, k), dtype=kind)
    for j in range(lo, hi):
        sums += (x[:, j, None] - y[None, :, j]) ** 2
    # The leader of the first group, to its last coefficient: nothing above it can win.
    lead = sums.argmin(axis=1)
    limit = ((x - y[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= limit[:, None])
    open_ = sums[row, entry]
    for lo, hi in groups[1:]:
        open_ = open_ + ((x[row, lo:hi] - y[entry, lo:hi]) ** 2).sum(axis=1)
        if hi < size:
            alive = open_ <= limit[row]
            row, entry, open_ = row[alive], entry[alive], open_[alive]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.minimum.reduceat(open_, starts)
    winner = np.minimum.reduceat(np.where(open_ == np.repeat(best, np.diff(np.r_[starts, len(row)])), entry, k), starts)
    return winner, best // size, len(row)


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width) of equal consecutive parts."""
    n, d = vectors.shape
    width = -(-d // parts)
    filled = np.zeros((n, width * parts), dtype=vectors.dtype)
    filled[:, :d] = vectors
    return filled.reshape(n, parts, width).transpose(1, 0, 2)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their whole numbers) for each vector length in a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = whole(column.flatten().to_numpy(zero_copy_only=False))
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for lo in range(0, len(rows), BLOCK):
            own = rows[lo:lo + BLOCK]
            yield d, own, flat[starts[own][:, None] + np.arange(d)[None, :]]


def sums_task(books: dict[int, list[np.ndarray]]):
    """Sums and counts of the parts nearest to each entry, one row per entry and position."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, vectors in by_length(batch.column("v")):
                for part, rows in enumerate(cut(vectors, len(books[d]))):
                    entries = books[d][part]
                    index, _, _ = nearest(rows, entries)
                    if (d, part) not in totals:
                        totals[d, part] = (np.zeros(entries.shape, dtype=object), np.zeros(len(entries), dtype=np.int64))
                    total, count = totals[d, part]
                    order = np.argsort(index, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(index[order]) != 0])
                    total[index[order][starts]] += np.add.reduceat(rows[order].astype(object if rows.dtype == object else np.int64), starts, axis=0)
                    count += np.bincount(index, minlength=len(entries))
        for (d, part), (total, count) in totals.items():
            used = np.flatnonzero(count)
            width = total.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used) * width, d), pa.int32()), pa.array(np.full(len(used) * width, part), pa.int32()),
                pa.array(np.repeat(used, width), pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array([decimal(v) for v in total[used].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(count[used], width), pa.int64()),
            ], ["d", "part", "entry", "position", "total", "n"])

    return task


def decimal(value: int):
    from decimal import Decimal

    return Decimal(int(value))


def codes_task(books: dict[int, list[np.ndarray]], digests: dict[int, str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code, error, digest = np.zeros((n, PARTS), dtype=np.uint8), np.zeros(n, dtype=object), np.empty(n, dtype=object)
            for d, own, vectors in by_length(batch.column("v")):
                for part, rows in enumerate(cut(vectors, len(books[d]))):
                    index, distance, _ = nearest(rows, books[d][part])
                    code[own, part] = index
                    error[own] += distance.astype(object)
                digest[own] = digests[d]
            text = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.tolist(), pa.int64()), pa.array(digest, pa.string())],
                ["id", "label", "code", "error", "codebooks_sha256"],
            )

    return task


def starting_books(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Codebooks of the smallest ids, for each vector length."""
    books = {}
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    for d in sorted(lengths):
        first = rows.filter(F.size("v") == d).orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()
        vectors = whole(np.array([x for r in first for x in r["v"]], dtype=np.float64)).reshape(len(first), d)
        books[d] = [np.ascontiguousarray(p) for p in cut(vectors, PARTS)]
    return books


def trained_books(rows: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks after ``rounds`` rounds; an entry that no part is nearest to stays."""
    books = starting_books(rows)
    for _ in range(rounds if books else 0):
        sums = rows.select("v").mapInArrow(sums_task(books), CELLS).groupBy("d", "part", "entry", "position")
        moved: dict[tuple[int, int], list] = {}
        for r in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved.setdefault((r["d"], r["part"]), []).append((r["entry"], r["position"], int(r["total"]) // r["n"]))
        for (d, part), cells in moved.items():
            book = books[d][part]
            small = all(abs(v) < 2**62 for _, _, v in cells) and book.dtype != object
            book = book.astype(np.int64 if small else object)
            for entry, position, value in cells:
                book[entry, position] = value
            books[d][part] = book
    return books


def book_digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for part in book for v in part.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = rows.filter(usable("v")).withColumn("v", F.col("v").cast("array<double>"))
    books = trained_books(rows)
    digests = {d: book_digest(book) for d, book in books.items()}
    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.mapInArrow(codes_task(books, digests), f"id long, label {kind}, code string, error long, codebooks_sha256 string"))
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")


def _round_sql(n: int) -> str:
    """One round: parts to their nearest entries, entries to the floored means."""
    return f"""
, a{n} AS (
  SELECT vec_id, p, min(s) AS s FROM (
    SELECT x.vec_id, x.p, [CAST(list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), b.k] AS s
    FROM parts x JOIN b{n} b ON b.p = x.p) GROUP BY vec_id, p
), m{n} AS (
  SELECT p, k, list(m ORDER BY i) AS x FROM (
    SELECT a.p, a.s[2] AS k, i, CAST(floor(CAST(sum(x.x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM a{n} a JOIN parts x ON x.vec_id = a.vec_id AND x.p = a.p, range(1, w + 1) t(i) GROUP BY a.p, a.s[2], i) GROUP BY p, k
), b{n + 1} AS (
  SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.k = b.k
)"""


SQL = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, len(embedding) // 4 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, w, p, e[p * w + 1 : p * w + w] AS x FROM v, range(4) t(p)
), b0 AS (
  SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < 256
)""" + "".join(_round_sql(n) for n in range(ROUNDS)) + """
, f AS (
  SELECT vec_id, p, min(s) AS s FROM (
    SELECT x.vec_id, x.p, [CAST(list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), b.k] AS s
    FROM parts x JOIN b4 b ON b.p = x.p) GROUP BY vec_id, p
), h AS (
  SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b4
), c AS (
  SELECT f.vec_id, any_value(v.label) AS label, string_agg(printf('%02x', f.s[2]), '' ORDER BY f.p) AS code, CAST(sum(f.s[1]) AS BIGINT) AS error
  FROM f JOIN v ON v.vec_id = f.vec_id GROUP BY f.vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""


@query(SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and errors of every vector."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
