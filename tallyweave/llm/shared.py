"""Helpers that several operators share: tables, durable cuts of the lineage, checked broadcasts,
and vectorised hashing of unit (word or line) sequences."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many rows and this many array elements.
BROADCAST_ROWS = 200_000
BROADCAST_ELEMENTS = 2_000_000


#: Stands for a null id inside the operators, so that id columns stay whole numbers; ids come out null again.
#: The least bigint is reserved for this: as an id of its own it comes out null too.
NULL_ID = -(1 << 63)


def whole_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_ID)).alias(column)


def text_mark(column: str = "text") -> Column:
    """A hash of the text: with doc_id the key of a row, so that rows without an id, or with one id, are told apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("mark")


def null_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NULL_ID)) for c in columns or ("doc_id",)})


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Fewer rows and bytes to an Arrow batch than by default (texts are long, and a row of tiles holds two whole
    tiles), unless the session has its own numbers. Batches lie outside the heap, and again in the worker."""
    for key, default, own in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(own))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is named, a temporary one serves a
    single machine; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(spark, "_tallyweave_checkpoints", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="tallyweave-checkpoints-")
            spark._tallyweave_checkpoints = named
            spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage; the rows lie in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_HELD: dict[str, object] = {}


def held_by_worker(key: str, make: Callable[[], object]):
    """make(), made once for each Python worker, which serves many tasks. A worker holds one such thing at a time:
    what a stage before has left goes first, and its memory back to the system."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what the worker holds, if anything; for tasks that need no table."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc keeps freed memory otherwise
            ctypes.CDLL(None).malloc_trim(0)


def attach(docs: DataFrame, side: DataFrame, key: str | list[str], weight: str | None = None) -> DataFrame:
    """docs left-joined to side (one row per key at most; already durable).

    The side is broadcast if its rows and the sum of `weight` are within the bounds above, so that
    whole texts are not shuffled; beyond them it is a shuffled join, which AQE can split.
    """
    total = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.lit(0)
    rows, elements = side.agg(F.count(F.lit(1)), total).first()
    small = rows <= BROADCAST_ROWS and elements <= BROADCAST_ELEMENTS
    return docs.join(F.broadcast(side) if small else side.hint("shuffle_merge"), key, "left")


def told_apart(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with row_id, a bigint: doc_id where it is unique. Rows whose id is null or not unique have one
    below all ids, and of those with equal texts too only one stays."""
    keyed = docs.select("*", whole_id().alias("own_id"), text_mark(text_col))
    shared = keyed.groupBy("own_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | (F.col("own_id") == NULL_ID)).select("own_id")
    shared = durable(shared)
    if not shared.head(1):
        return keyed.withColumn("row_id", F.col("own_id")).drop("own_id", "mark")
    pairs = durable(keyed.select("own_id", "mark").join(shared, "own_id").distinct())
    side = durable(pairs.withColumn("nth", F.lit(NULL_ID) + 1 + F.monotonically_increasing_id()))
    joined = attach(keyed, side, ["own_id", "mark"])
    clear = joined.filter("nth IS NULL").withColumn("row_id", F.col("own_id"))
    other = joined.filter("nth IS NOT NULL").withColumn("row_id", F.col("nth")).dropDuplicates(["row_id"])
    return clear.unionByName(other).drop("own_id", "mark", "nth")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs but those whose key, never null, is in ids(key); the ids are broadcast within the bound, else shuffled."""
    ids = durable(ids.select(key).distinct())
    small = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, "left_anti").select(*docs.columns)


def repeats(rows: DataFrame, keys: list[str], place: list[str], path: str, later_only: bool = False) -> DataFrame:
    """The places of rows(keys, place) whose key stands at two places at least; later_only: without the
    first place of each key. Rows that are equal in all columns are one place, reported once or more.

    The rows are sorted over all partitions by key and place, so a frequent key is spread over as many
    partitions as its rows fill, and each task walks its part once. Only the first rows of the first and the
    last key of a partition depend on its neighbours: two rows a partition, settled afterwards.
    All columns are whole numbers and not null. What the walk finds lies in files at `path`, for the caller to remove."""
    width = len(keys)
    columns = [*keys, *place]
    ordered = rows.select(*[F.col(c).cast("bigint").alias(c) for c in columns])
    ordered = ordered.repartitionByRange(*columns).sortWithinPartitions(*columns)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty((0, len(columns)), np.int64)
        held, more, opening = none, False, True  # the first row of the key at hand, and whether it has other places

        def out(found: np.ndarray, edge: bool, more: bool) -> pd.DataFrame:
            held = pd.DataFrame(found, columns=columns).assign(edge=edge, more=more)
            return held if edge else held.assign(**dict.fromkeys(keys, 0))  # keys matter no more, and take room

        for batch in batches:
            if not len(batch):
                continue
            data = np.concatenate([held, batch[columns].to_numpy(np.int64)])
            new = np.ones(len(data), bool)
            new[1:] = (data[1:, :width] != data[:-1, :width]).any(axis=1)
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            other = (data[:, width:] != data[starts][group][:, width:]).any(axis=1)
            several = np.bincount(group[other], minlength=len(starts)) > 0
            several[0] |= more
            yield out(data[other], False, True)
            closed = np.arange(len(starts) - 1)
            if opening and len(closed):
                yield out(data[starts[:1]], True, bool(several[0]))
                closed, opening = closed[1:], False
            if not later_only:
                yield out(data[starts[closed[several[closed]]]], False, True)
            held, more = data[starts[-1:]], bool(several[-1])
        yield out(held, True, more)

    schema = ", ".join(f"{c} bigint" for c in columns) + ", edge boolean, more boolean"
    ordered.mapInPandas(walk, schema).write.option("compression", "zstd").parquet(path)
    found = rows.sparkSession.read.schema(schema).parquet(path)
    edges, at = found.filter("edge"), F.struct(*place)
    ends = edges.groupBy(*keys).agg(F.min(at).alias("first_place"), F.max(at).alias("last_place"), F.max("more").alias("any_more"))
    settled = (at != F.col("first_place")) if later_only else F.col("any_more") | (F.col("first_place") != F.col("last_place"))
    return found.filter("NOT edge").select(*place).unionByName(edges.join(ends, keys).filter(settled).select(*place))


# --- hashing of unit sequences, whole batches at a time (arithmetic modulo 2**64) ---------------

_MULTIPLIERS = {"byte": 0x9E3779B97F4A7C15, "gram": 0xC2B2AE3D27D4EB4F, "window": 0x165667B19E3779F9}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, at least n of each."""
    have = _POWERS.get(name)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _MULTIPLIERS[name]
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        have = _POWERS[name] = (up, down)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, name: str) -> np.ndarray:
    """Hash of values[starts:ends] for each pair; equal ranges have equal hashes wherever they lie."""
    up, down = _powers(name, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))


def sliding(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """reduce (np.minimum or np.maximum) over each run of `width` neighbours."""
    have, out = 1, values
    while have * 2 <= width:
        out = reduce(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    if rest and len(out):
        out = reduce(out[: len(out) - rest], out[rest:]) if len(out) > rest else out[:0]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and each text's first word (n + 1 long)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes = range_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends, "byte")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)


def winnow(units: np.ndarray, first: np.ndarray, gram: int, window: int):
    """Winnowing over hash sequences of many documents laid end to end.

    gram units make a k-gram; of each `window` neighbouring k-grams the minima are chosen, so any run
    of gram + window - 1 units holds a chosen one, the same wherever the run stands. Returns
    (starts of all whole runs, their minima, positions of the chosen k-grams, their hashes), positions
    counted over all documents.
    """
    run = gram + window - 1
    lengths = np.diff(first)
    n = len(units)
    if n < run:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    grams = range_hashes(units, at, at + gram, "gram")
    lowest = sliding(grams, window, np.minimum)  # for each run's start
    owner_end = np.repeat(first[1:], lengths)[: len(lowest)]
    whole = np.arange(len(lowest)) + run <= owner_end
    starts = np.flatnonzero(whole)
    # A gram is chosen if it equals the minimum of some whole run that covers it.
    bound = np.where(whole, lowest, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), bound, np.zeros(window - 1, np.uint64)])
    highest = sliding(padded, window, np.maximum)
    chosen = np.flatnonzero((highest == grams) & (highest > 0))
    return starts, lowest[starts], chosen, grams[chosen]


def chunks(doc_ids, texts, limit: int = 1_000_000):
    """Split a batch by bytes, so that the arrays above stay small; one long text makes a chunk of its own."""
    ids, held, size = [], [], 0
    for doc_id, text in zip(doc_ids, texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(doc_id)
        held.append(data)
        size += len(data)
    if held:
        yield ids, held
