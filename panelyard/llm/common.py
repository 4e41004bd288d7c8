"""What the operators share: scratch tables, column names, text buffers, feature sums."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.session import size_in_bytes

SLICE_BYTES = 4 * 1024**2        # of text turned into Python objects at once; one text at least
_OWN: dict[str, str] = {}        # the driver's own scratch folder, where the session names none
BATCH_ROWS = 1000
BATCH_BYTES = 8 * 1024**2
TOKENIZER_DIR = "/opt/tokenizers"   # default of every ``vocabulary`` parameter


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder inside the one the cluster shares (``spark.checkpoint.dir``). Only where
    that is unset and all runs on this machine, as in tests, a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "scratch" not in _OWN:
            _OWN["scratch"] = "file://" + tempfile.mkdtemp(prefix="panelyard-")
        base = _OWN["scratch"]
    return f"{base.rstrip('/')}/panelyard-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a reduced table to the shared folder and read it back: the lineage ends there, a
    lost executor costs nothing, and the planner knows the table's true size."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_remainder(key: str, n: int) -> Column:
    """crc32 of a column's text, modulo ``n``; NULL where the column is NULL."""
    return F.crc32(F.col(key).cast("string")) % n


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def spread(n: int, *columns: str) -> Column:
    """A number below ``n`` for each row. Rows equal in ``columns`` are told apart by their
    place in the (stored) table, so that no repeated row makes a part too large."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), *columns), F.lit(n))


def arrow_column(kernel: Callable[[], Callable[[list], list | tuple]], schema: str, *columns: str | Column) -> Column:
    """A struct column made batch by batch on the executors.

    ``kernel()`` is called once a task and returns a function from lists of values (one list
    per input column) to a list of columns, in the order of ``schema``'s fields.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def build(batches: Iterator) -> Iterator[pa.Array]:
        run = kernel()
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            pieces = []
            for lo, hi in text_slices(batch):
                made = run(*(column.slice(lo, hi - lo).to_pylist() for column in batch))
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, (_, t) in zip(made, fields)]
                pieces.append(pa.StructArray.from_arrays(arrays, names=[name for name, _ in fields]))
            yield pa.concat_arrays(pieces) if pieces else pa.array([], to_arrow_type(kind))
        pa.default_memory_pool().release_unused()

    if len(columns) == 1:
        def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return build(batches)
    else:
        def typed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            return build(batches)

    # Not deterministic to the optimizer only: filters above must not evaluate it once more.
    # Postponed annotations are text, and Spark reads them from the function itself.
    typed.__annotations__ = {
        "batches": Iterator[pa.Array] if len(columns) == 1 else Iterator[tuple[pa.Array, ...]],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(typed, kind).asNondeterministic()(*columns)


def worker_cache(owner: str, name: str, make: Callable):
    """A value kept by a Python worker from one task to its next, made when first asked for. A
    worker keeps the values of one owner at a time: another owner's first request drops them."""
    home = sys.modules.setdefault("_panelyard_worker_cache", types.ModuleType("_panelyard_worker_cache"))
    if getattr(home, "owner", None) != owner:
        home.owner, home.values = owner, {}
    if name not in home.values:
        home.values[name] = make()
    return home.values[name]


def text_batches(spark: SparkSession) -> SparkSession:
    """Bound what crosses to Python at once: texts are long, and both sides hold whole batches."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        try:
            now = spark.conf.get(key)
        except Exception:  # noqa: BLE001  (no such setting in this version)
            continue
        if not 0 < size_in_bytes(now) <= most:
            spark.conf.set(key, str(most))
    return spark


class Memo(dict):
    """Results by word, remembered up to a bound. Two generations: words used since the last
    turn survive the next one. ``many`` makes the results of several words at once."""

    LONGEST = 64   # longer words are not kept from one slice to the next

    def __init__(self, bound: int, many: Callable[[list], list]):
        super().__init__()
        self.bound, self.many, self.old, self.long = bound, many, {}, []

    def prepare(self, wanted: set) -> None:
        """Have all of ``wanted`` ready for plain lookups until the next call."""
        for word in self.long:
            self.pop(word, None)
        self.long = []
        if len(self) > self.bound // 2:
            self.old = dict(self)
            self.clear()
        missing = wanted.difference(self)
        again = missing.intersection(self.old)
        self.update(zip(again, map(self.old.__getitem__, again)))
        new = list(missing.difference(again))
        if new:
            self.update(zip(new, self.many(new)))
            self.long = [word for word in new if len(word) > self.LONGEST]


def text_slices(columns: Sequence[pa.Array], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of row runs whose texts add up to about ``most`` bytes; one row at least."""
    total = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return sliced(total, total.tolist(), most)


def sliced(values: Sequence, sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``values`` whose sizes add up to about ``most``; one value at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(values):
        yield start, len(values)


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the bounds of each text in it."""
    joined = "".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or "") for t in texts], out=bounds[1:])
    return codes, bounds


def vector_sum(rows: DataFrame, kernel: Callable[[], Callable[[list], np.ndarray]], column: str, size: int) -> np.ndarray:
    """Sum over all rows of vectors of a fixed ``size``.

    Each task adds its own rows first and emits the non-zero cells of one vector; Spark adds
    those by cell. What reaches the driver is ``size`` numbers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = kernel(), np.zeros(size)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in text_slices([texts]):
                total += run(texts.slice(lo, hi - lo).to_pylist())
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.float64())], ["cell", "value"])

    cells = rows.select(column).mapInArrow(task, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in cells.collect():
        out[row["cell"]] = row["value"]
    return out
