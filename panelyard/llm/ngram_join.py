"""Operator 7, n-gram Jaccard join: a chosen-path join on shingles of five words.

1. Every text becomes its set of shingle hashes, and that a key (texts of one key are copies,
   from here on one record with a number) and 64 minhash tokens. Records of similarity s agree
   in each token with probability s.
2. Chosen paths. At each level a record is copied to the buckets of those tokens that a hash
   of (path, token) picks with probability 1 / (threshold x 64), so that a pair at the threshold
   is expected to share one bucket more on each level. Buckets with one record end. Buckets
   above LEAF records are split again, until DEPTH; smaller ones are searched by brute force.
   A bucket in which most records agree in most tokens holds near copies, which a split would
   keep together: it is searched at once. One larger than BLOCK is searched in pairs of blocks.
3. Runs with other hashes repeat this until the probability to miss a pair at the threshold is
   below 1 - RECALL: the mean over the binomial number of its equal tokens, which all runs share,
   and with all pairs below the candidate cut missed. Every record counts the levels that its own
   buckets needed. A pair's buckets are among those of either record, so it is covered as soon as
   one of the two is; only records that are not yet go into further runs, all into the same.
4. What brute force finds similar by tokens makes candidate components; the cut on equal tokens
   lies so low that it takes at most CUT_SHARE of the allowed misses. In
   each, all pairs are compared on their whole shingle sets, large ones in pairs of blocks.
   So links that paths missed inside a component are found as well, and none is emitted as a
   row: only each record's number of links, and its place in the component of true links.

Defined results. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A text of one
to four words is one shingle. A text NULL or without words links with nothing and is its own
class. Similarity is of shingle sets, so equal sets are copies. ``class_id`` is the smallest
id of the class, NULL only where all its ids are. Rows with equal ids are rows all the same. An
empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import Memo, arrow_column, fresh, parts_for, stored, text_batches, worker_cache
from panelyard.llm.components import connected_components
from panelyard.llm.registry import query

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999           # of pairs at the threshold; pairs above it do better
TOKENS = 64              # minhash tokens of a record
CUT_SHARE = 0.1          # of the misses allowed, what the cut on equal tokens may take
LEAF = 64                # records of a bucket that is searched rather than split
DEPTH = 4                # levels of splitting
COMMON = 0.5             # mean share of a token's commonest value from which a bucket is near copies
SEEN, CELLS = 8, 8       # tokens looked at for that, and cells their values fall into
BLOCK = 16384            # records searched at once; larger buckets go in pairs of blocks
BLOCK_SHINGLES = 1_000_000   # shingles compared at once in a component
BLOCK_RECORDS = 1024
TASK_ROWS = 200_000      # bucket rows a task gets
TASK_SHINGLES = 1_000_000
WORD_MEMO = 300_000      # word hashes a worker remembers
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)   # 64-bit finaliser


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_memo() -> Memo:
    """Word -> 64-bit hash, kept by the worker."""
    return worker_cache("ngram_join", "word_hashes", lambda: Memo(WORD_MEMO, lambda words: [xxhash.xxh3_64_intdigest(w) for w in words]))


def shingle_sets(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, in one array with bounds."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    memo.prepare(set().union(*words))
    hashes = np.fromiter((h for w in words for h in map(memo.__getitem__, w)), dtype=np.uint64, count=int(sizes.sum()))
    # Short texts are one shingle: filled up with a value that stands for no word.
    short = (sizes > 0) & (sizes < WORDS)
    if short.any():
        bounds, filled = np.r_[0, np.cumsum(sizes)], []
        for i in range(len(texts)):
            filled.append(hashes[bounds[i]:bounds[i + 1]])
            if short[i]:
                filled.append(np.zeros(WORDS - sizes[i], dtype=np.uint64))
        hashes, sizes = np.concatenate(filled), np.where(short, WORDS, sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(hashes) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        key = mix(key + hashes[j:j + n] + np.uint64(j + 1))
    inside = owner[:n] == owner[WORDS - 1:]
    key, owner = key[inside], owner[:n][inside]
    bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))]
    sets, out = [], [0]
    for i in range(len(texts)):
        values = np.unique(key[bounds[i]:bounds[i + 1]])
        sets.append(values)
        out.append(out[-1] + len(values))
    return np.concatenate(sets), np.array(out)


def minhash(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """TOKENS minima of 32-bit hashes for each set; a row of zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, TOKENS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        starts = bounds[:-1][full]
        factors = mix(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for i in range(TOKENS):
            values = ((shingles * factors[2 * i] + factors[2 * i + 1]) >> np.uint64(32)).astype(np.uint32)
            out[full, i] = np.minimum.reduceat(values, starts)
    return out


def embed_kernel():
    memo = word_memo()

    def run(texts):
        shingles, bounds = shingle_sets(texts, memo)
        tokens = minhash(shingles, bounds)
        keys, sketches = [], []
        for i in range(len(texts)):
            own = shingles[bounds[i]:bounds[i + 1]]
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sketches.append(tokens[i].tobytes() if len(own) else None)
        return keys, np.diff(bounds), sketches

    return run


def shingle_kernel():
    memo = word_memo()

    def run(texts):
        shingles, bounds = shingle_sets(texts, memo)
        keys = [
            xxhash.xxh3_128_digest(shingles[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])
        ]
        return keys, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64)))

    return run


def as_matrix(sketches: list[bytes], kind, width: int = TOKENS) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=kind).reshape(-1, width)


def chosen_paths(threshold: float):
    """Kernel: (sketches, paths) -> the child paths of each row."""
    limit = np.uint64(int(2.0**64 / max(1.0, threshold * TOKENS)) - 1)

    def kernel():
        def run(sketches, paths):
            tokens = as_matrix(sketches, np.uint32).astype(np.uint64)
            place = mix(tokens + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))
            counts, children = np.zeros(len(paths), dtype=np.int64), []
            for i, own in enumerate(paths):
                own = np.array(own, dtype=np.int64).view(np.uint64)
                h = mix(place[i][None, :] + mix(own)[:, None])
                picked = h[h <= limit]
                counts[i] = len(picked)
                children.append(mix(picked + np.uint64(1)))
            flat = np.concatenate(children) if children else np.zeros(0, np.uint64)
            return (pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat.view(np.int64))),)

        return run

    return kernel


def equal_tokens(threshold: float) -> np.ndarray:
    """Probability of each number of equal tokens, 0 to TOKENS, of a pair at the threshold."""
    return np.array([comb(TOKENS, k) * threshold**k * (1.0 - threshold) ** (TOKENS - k) for k in range(TOKENS + 1)])


def candidate_cut(threshold: float, recall: float) -> int:
    """Equal tokens that make a candidate: as many as keep the pairs below within CUT_SHARE."""
    below = np.r_[0.0, np.cumsum(equal_tokens(threshold))]
    return int(np.searchsorted(below, CUT_SHARE * (1.0 - recall), side="right")) - 1


def miss_probability(depths: int | list[int], threshold: float, least: int = 0) -> float:
    """For a pair at the threshold: less than ``least`` equal tokens, or no common bucket in any
    run, where ``depths`` has the levels of each run. Runs choose among the same tokens, so they
    are independent only for a given number of equal ones."""
    equal = np.arange(TOKENS + 1)
    missed = np.ones(TOKENS + 1)
    for depth in np.atleast_1d(np.array(depths, dtype=np.int64)).tolist():
        found = np.ones(TOKENS + 1)
        for _ in range(depth):
            found = 1.0 - (1.0 - found / max(1.0, threshold * TOKENS)) ** equal
        missed *= 1.0 - found
    missed[:least] = 1.0
    return float(equal_tokens(threshold) @ missed)


def star_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index joined to each of ``n`` by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def search_buckets(path: np.ndarray, record: np.ndarray, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (record, smallest similar record) that connect what is similar in each bucket.
    Rows are sorted by path."""
    n = len(path)
    start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    of = np.repeat(np.arange(len(start)), size)
    left, right = [], []
    small = size <= LEAF
    for d in range(1, int(size[small].max(initial=0))):
        i = np.flatnonzero(small[of[:n - d]] & (of[:n - d] == of[d:]))
        for lo in range(0, len(i), 65536):
            part = i[lo:lo + 65536]
            same = (tokens[part] == tokens[part + d]).sum(axis=1) >= least
            left.append(part[same])
            right.append(part[same] + d)
    for g in np.flatnonzero(~small):
        # Grow one component after the other: whoever is reached needs no comparison with those
        # that are reached already.
        rest = np.arange(start[g], start[g] + size[g])
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                same = (tokens[rest] == tokens[x]).sum(axis=1) >= least
                reached, rest = rest[same], rest[~same]
                left.append(np.full(len(reached), x))
                right.append(reached)
                queue.extend(reached.tolist())
    if not left:
        return record[:0], record[:0]
    label = star_edges(n, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(n))
    return record[moved], record[label[moved]]


def bucket_task(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def search(parts):
            path, record = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            a, b = search_buckets(path, record, np.concatenate([p[2] for p in parts]), least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy(zero_copy_only=False)
            record = batch.column("record").to_numpy(zero_copy_only=False)
            tokens = as_matrix(batch.column("brief").to_pylist(), np.uint16)
            cut = int(np.searchsorted(path, path[-1], side="left"))   # the last bucket may go on
            if cut == 0 and held and held[-1][0][-1] == path[0]:
                held.append((path, record, tokens))
                continue
            held.append((path[:cut], record[:cut], tokens[:cut]))
            yield search(held)
            held = [(path[cut:], record[cut:], tokens[cut:])]
        if held:
            yield search(held)

    return task


def common_share() -> Column:
    """Over the rows of a bucket: the mean share of a token's commonest value, from the fullest
    cell of each token looked at, less what falls into a cell by chance."""
    shares = []
    for i in range(SEEN):
        cell = F.shiftright("mini", 3 * i).bitwiseAND(CELLS - 1)
        fullest = F.greatest(*[F.count_if(cell == c) for c in range(CELLS)]) / F.count(F.lit(1))
        shares.append((fullest * CELLS - 1) / (CELLS - 1))
    return sum(shares[1:], shares[0]) / SEEN


def searched_and_split(rows: DataFrame, choose, sketches: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Buckets to search (path, record, n) from the first level's (record, mini, path), and the
    records whose buckets were split with the levels they needed (None if no bucket was)."""
    leaves, deep, level = [], [], stored(rows)
    for depth in range(1, DEPTH + 1):
        shared = level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        level = stored(level.join(shared, "path"))
        if depth == DEPTH:
            leaves.append(level)
            break
        leaves.append(level.filter(F.col("n") <= LEAF))
        large = level.filter(F.col("n") > LEAF)
        if large.isEmpty():
            break
        mixed = stored(large.groupBy("path").agg(common_share().alias("common")).filter(F.col("common") < COMMON).select("path"))
        leaves.append(large.join(mixed, "path", "left_anti"))
        if mixed.isEmpty():
            break
        split = large.join(mixed, "path", "left_semi")
        deep.append(split.select("record", F.lit(depth + 1).alias("depth")))
        held = split.select("record", "mini", "path").join(sketches, "record")
        children = held.select("record", "mini", arrow_column(choose, "paths array<long>", "sketch", F.array("path")).alias("p"))
        level = stored(children.select("record", "mini", F.explode("p.paths").alias("path")))
    every = None
    for rows in deep:
        every = rows if every is None else every.union(rows)
    return [leaf.select("path", "record", "n") for leaf in leaves], every


def candidate_edges(records: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges between records with enough equal tokens that met in some bucket."""
    least = candidate_cut(threshold, recall)
    if equal_tokens(threshold)[:max(1, least)].sum() >= 1.0 - recall:
        raise ValueError(f"{TOKENS} tokens cannot find pairs at {threshold} with a recall of {recall}")
    choose, sketches = chosen_paths(threshold), records.select("record", "sketch")
    # Records not yet covered, with the levels each batch of runs took them, as one number of
    # DEPTH + 1 digits; the first runs are as many as buckets of one level need.
    open_, histories, batches, first, found = records.select("record", "mini", "sketch", F.lit(0).cast("long").alias("past")), [0], [], 1, []
    while histories:
        def depths(past: int) -> list[int]:
            taken = []
            for runs in reversed(batches):   # noqa: B023
                past, depth = divmod(past, DEPTH + 1)
                taken += runs * [depth]
            return taken

        more = 0
        for past in histories:
            before, own = depths(past), 0
            while miss_probability(before + own * [before[0] if before else 1], threshold, least) > 1.0 - recall:
                own += 1
            more = max(more, own)
        if not more:
            break
        batches.append(more)
        seeds = F.array(*[F.lit(r) for r in range(first, first + more)]).cast("array<long>")
        first += more
        rows = open_.select("record", "mini", arrow_column(choose, "paths array<long>", "sketch", seeds).alias("p"))
        leaves, deep = searched_and_split(rows.select("record", "mini", F.explode("p.paths").alias("path")), choose, sketches)
        found += leaves
        if deep is None:
            break
        deep = deep.groupBy("record").agg(F.max("depth").alias("depth"))
        past = F.col("past") * (DEPTH + 1) + F.col("depth")
        open_ = stored(open_.join(deep, "record").select("record", "mini", "sketch", past.alias("past")))
        histories = [r["past"] for r in open_.select("past").distinct().collect()]   # at most DEPTH for each batch
        covered = [p for p in histories if miss_probability(depths(p), threshold, least) <= 1.0 - recall]
        histories = [p for p in histories if p not in covered]
        open_ = open_.filter(~F.col("past").isin(covered)) if covered else open_
    rows = found[0]
    for more_rows in found[1:]:
        rows = rows.union(more_rows)
    # A bucket above BLOCK: its rows go to every pair of blocks that holds their own.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("record"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
    )
    pair = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select("record", F.when(F.col("blocks") > 1, pair).otherwise(F.col("path")).alias("path"))
    brief = records.select("record", "brief")
    n = max(parts_for(rows.count(), TASK_ROWS), 1)
    dealt = rows.join(brief, "record").repartition(n, "path").sortWithinPartitions("path")
    return dealt.select("path", "record", "brief").mapInArrow(bucket_task(least), "a long, b long").distinct()


def similar_pairs(shingles: list[np.ndarray], threshold: float, first: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix of pairs at the threshold or above; with ``first`` only pairs of a set
    with that flag and one without."""
    k = len(shingles)
    sizes = np.array([len(s) for s in shingles])
    flat, owner = np.concatenate(shingles), np.repeat(np.arange(k), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((k, k), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        width = 4096
        for lo in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((k, min(width, int(column[-1]) + 1 - lo)), dtype=np.float32)
            part[owner[a:b], column[a:b] - lo] = 1.0
            common += part @ part.T
    joint = sizes[:, None] + sizes[None, :] - common
    out = common.astype(np.float64) >= threshold * joint - 1e-9
    np.fill_diagonal(out, False)
    if first is not None:
        out &= first[:, None] != first[None, :]
    return out


def verify_task(threshold: float):
    def task(table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        record = table.column("record").to_numpy()
        copies = table.column("copies").to_numpy()
        own, other = table.column("own").to_numpy(), table.column("other").to_numpy()
        lists = table.column("shingles").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        order = np.argsort(component, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(component[order]) != 0, True])
        links, root = np.zeros(len(record), dtype=np.int64), record.copy()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = order[lo:hi]
            rows = rows[np.argsort(record[rows], kind="stable")]
            if len(rows) < 2:
                continue
            crossing = (own[rows] != other[rows]).any()
            first = own[rows] == own[rows].min() if crossing else None
            near = similar_pairs([values[offsets[i]:offsets[i + 1]] for i in rows], threshold, first)
            links[rows] = near @ copies[rows]
            a, b = np.nonzero(np.triu(near))
            root[rows] = record[rows][star_edges(len(rows), a, b)]
        return pa.table({"record": record, "root": root, "links": links})

    return task


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per document: key, ``class_id``, ``n_links`` (documents other than itself at the
    threshold or above), ``copies`` (rows of its shingle set, itself included), ``set_key`` and the
    set key of its class's first record. Where ids repeat, two classes may have one ``class_id``."""
    text_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    made = source.select("id", arrow_column(embed_kernel, "set_key binary, n long, sketch binary", "text").alias("e"))
    embedded = stored(made.select("id", "e.*"))
    records = embedded.filter("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("low_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    records = stored(records.withColumn("record", F.monotonically_increasing_id()).withColumn("b", brief_column("sketch")).select("*", "b.*").drop("b"))

    candidates = connected_components(candidate_edges(records, threshold, recall))
    members = stored(
        candidates.select(F.col("node").alias("record"), F.col("label").alias("component"))
        .join(records.select("record", "set_key", "low_id", "copies", "n"), "record")
    )
    sizes = members.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
    whole = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = parts_for(whole, TASK_SHINGLES)
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_RECORDS), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes.select("component", blocks.alias("blocks")), "component")

    # Shingles of the members only. Ids may repeat, so the set's key decides.
    wanted = members.select(F.col("low_id").alias("id")).distinct()
    texts = source.join(wanted.withColumnRenamed("id", "w"), source["id"].eqNullSafe(F.col("w")), "left_semi")
    sets = texts.select(arrow_column(shingle_kernel, "set_key binary, shingles array<long>", "text").alias("s")).select("s.*")
    sets = members.join(sets.filter("set_key is not null"), "set_key").dropDuplicates(["record"])
    own = F.pmod(F.xxhash64("record"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    group = F.when(F.col("blocks") > 1, F.concat_ws("/", "component", low, high)).otherwise(
        F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string")
    )
    # A pair of blocks knows its two numbers; within it rows differ in their own one.
    dealt = dealt.select("component", "record", "copies", "own", "other", "shingles", group.alias("bucket"))
    checked = stored(dealt.groupBy("bucket").applyInArrow(verify_task(threshold), "record long, root long, links long"))
    links = checked.groupBy("record").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.select(F.col("record").alias("a"), F.col("root").alias("b")))
    found = records.select("record", "set_key", "low_id", "copies").join(links, "record", "left").join(
        classes.select(F.col("node").alias("record"), "label"), "record", "left"
    ).withColumn("label", F.coalesce("label", "record"))
    first = F.min(F.struct(F.col("low_id").isNull(), "low_id", "set_key"))
    lowest = found.groupBy("label").agg(first.alias("first")).select(
        "label", F.col("first.low_id").alias("class_id"), F.col("first.set_key").alias("class_key")
    )
    found = stored(found.join(lowest, "label").select("set_key", "class_id", "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links")))

    out = embedded.select("id", "set_key").join(found, "set_key", "left")
    linked = F.col("set_key").isNotNull()
    return out.select(
        F.col("id").alias(key),
        F.when(linked, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "set_key", "class_key",
    )


def brief_column(sketch: str) -> Column:
    """``brief``: two bytes of each token, enough to compare and half as much to move. ``mini``:
    the cells of the first tokens."""

    def kernel():
        def run(sketches):
            tokens = as_matrix(sketches, np.uint32)
            cells = (mix(tokens[:, :SEEN].astype(np.uint64)) % np.uint64(CELLS)).astype(np.int64)
            mini = (cells << (3 * np.arange(SEEN))[None, :]).sum(axis=1)
            return [np.frombuffer(s, np.uint16)[::2].tobytes() for s in sketches], mini.astype(np.int32)

        return run

    return arrow_column(kernel, "brief binary, mini int", sketch)


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose class has one of a smaller id; of rows equal in id
    and shingles one stays. Texts without words all stay. Columns as they came."""
    found = stored(near_duplicates(docs, key, text, threshold))
    id_, clean = fresh(docs, "id_of_dropped"), docs.columns
    dropped = found.filter(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias(id_))
    repeated = stored(found.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias(id_)))
    # The dropped ids grow with the corpus, so they are never broadcast: one plan at every size.
    single = docs.join(dropped.hint("merge"), docs[key].eqNullSafe(F.col(id_)), "left_anti")
    if repeated.isEmpty():
        return single
    # Ids that repeat: here the shingle set tells the rows apart.
    single = single.join(repeated, single[key].eqNullSafe(F.col(id_)), "left_anti")
    made, set_ = fresh(docs, "set_of_row"), fresh(docs, "set_kept")
    many = docs.join(repeated, docs[key].eqNullSafe(F.col(id_)), "left_semi").withColumn(
        made, arrow_column(shingle_kernel, "set_key binary, shingles array<long>", text)["set_key"]
    )
    keepers = found.filter(F.col(key).eqNullSafe(F.col("class_id")) & (F.col("set_key") == F.col("class_key")))
    keepers = keepers.select(F.col(key).alias(id_), F.col("set_key").alias(set_)).distinct()
    empty = many.filter(F.col(made).isNull()).select(*clean)
    full = many.filter(F.col(made).isNotNull()).dropDuplicates([key, made])
    met = full[key].eqNullSafe(F.col(id_)) & (full[made] == F.col(set_))
    return single.unionByName(empty).unionByName(full.join(keepers, met, "left_semi").select(*clean))


@query()
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs.select("doc_id", "text")).drop("set_key", "class_key")
