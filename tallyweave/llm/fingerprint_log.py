"""Substring dedup over a log-structured fingerprint index.

Windows of `length` words are found through winnowed k-gram hashes. The index is a list of runs:
immutable Parquet files of (fp, occ, repeated) sorted by fp. Each new batch becomes a run and is
merge-joined with the runs before it; a fingerprint met at two different places is repeated. When
more than `fan_in` runs lie there they are compacted into one. Windows around repeated fingerprints
are then verified by a second hash over all their words, and only those that do start at two places
are removed. The result depends on the input alone, not on how it was cut into batches.

Exact copies of whole texts count as one place in the index (else a group of thousands would fill it
with itself); all their words are removed if they hold a whole window.

Defined cases: a null or empty text has no words; a text shorter than a window keeps all its words;
words repeat within one document as across documents; the same doc_id twice is two documents; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, chunks, durable, mixed, null_ids, range_hashes, remove_path, repeats, scratch_path, table, text_mark, whole_id, winnow, word_hashes

#: k-grams of 15 words: any 35 words in a row hold 21 of them, the least of which is a fingerprint.
GRAM = 15
_RUN = "fp bigint, occ bigint, repeated boolean"


def _places(texts: list[bytes], owners: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each place (text, position): equal texts have equal places."""
    marks = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
    return mixed(marks[owners] ^ mixed((at - first[owners]).astype(np.uint64) + np.uint64(1)))


def run_of(docs: DataFrame, length: int, gram: int, text_col: str = "text") -> DataFrame:
    """The run of a batch: each fingerprint once, with a place of it and whether it has another."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in chunks(batch["text"], batch["text"]):
                units, first = word_hashes(texts)
                _, _, at, fps = winnow(units, first, gram, length - gram + 1)
                owners = np.searchsorted(first, at, side="right") - 1
                occ = _places(texts, owners, at, first)
                yield pd.DataFrame({"fp": fps.view(np.int64), "occ": occ.view(np.int64)})

    places = docs.select(F.col(text_col).alias("text")).mapInPandas(found, "fp bigint, occ bigint")
    return _one_each(places.withColumn("least", F.col("occ")).withColumn("most", F.col("occ")).withColumn("seen", F.lit(False)))


def _one_each(places: DataFrame) -> DataFrame:
    least = places.groupBy("fp").agg(F.min("least").alias("occ"), F.max("most").alias("most"), F.max("seen").alias("seen"))
    return least.select("fp", "occ", (F.col("seen") | (F.col("occ") != F.col("most"))).alias("repeated"))


class FingerprintLog:
    """Sorted immutable runs in a shared folder, and the fingerprints known to be repeated."""

    def __init__(self, spark: SparkSession, path: str, length: int = 35, gram: int = GRAM, fan_in: int = 8):
        self.spark, self.path, self.length, self.gram, self.fan_in = spark, path, length, gram, fan_in
        self.runs: list[str] = []
        self.written = 0

    def _write(self, run: DataFrame) -> str:
        self.written += 1
        to = f"{self.path}/run-{self.written:06d}"
        run.sortWithinPartitions("fp").write.option("compression", "lz4").parquet(to)
        return to

    def read(self, run: str) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(run)

    def append(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Add a batch; returns the fingerprints that are repeated now and of which a place is in it."""
        new = self._write(run_of(docs, self.length, self.gram, text_col))
        batch = self.read(new)
        hits = batch.filter("repeated").select("fp")
        for old in self.runs:
            known = self.read(old).select("fp", F.col("occ").alias("other"), F.col("repeated").alias("before"))
            met = batch.join(known.hint("merge"), "fp")
            hits = hits.unionByName(met.filter("before OR other <> occ").select("fp"))
        self.runs.append(new)
        return hits

    def compact(self) -> None:
        """Merge all runs into one and drop the old files."""
        if len(self.runs) < 2:
            return
        merged = None
        for run in self.runs:
            part = self.read(run).select("fp", F.col("occ").alias("least"), F.col("occ").alias("most"), F.col("repeated").alias("seen"))
            merged = part if merged is None else merged.unionByName(part)
        old, self.runs = self.runs, [self._write(_one_each(merged))]
        for run in old:
            remove_path(self.spark, run)

    def drop(self) -> None:
        for run in self.runs:
            remove_path(self.spark, run)
        self.runs = []


class _Sieve:
    """A Bloom filter of fixed size: it lets through all that were put in, and few others.

    It only spares work: what it lets through is verified afterwards."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, fps: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.bits) * 8 - 1)
        ok = np.ones(len(fps), bool)
        for k in (0, 32):
            at = mixed(fps ^ np.uint64(k)) & size
            ok &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def _sieve(hits: DataFrame, log2_bits: int) -> bytes:
    """The filter's bits, gathered as at most 2 ** log2_bits / 64 words, so of bounded size."""
    words = None
    size = (1 << log2_bits) - 1

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << log2_bits - 3, np.uint8)
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for k in (0, 32):
                at = mixed(fps ^ np.uint64(k)) & np.uint64(size)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        held = bits.view("<i8")
        at = np.flatnonzero(held)
        yield pd.DataFrame({"at": at, "word": held[at]})

    parts = hits.mapInPandas(spread, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word"))
    got = parts.toArrow()
    words = np.zeros(1 << log2_bits - 6, "<i8")
    words[got["at"].to_numpy()] = got["word"].to_numpy()
    return words.tobytes()


def _windows(docs: DataFrame, sieve, length: int, gram: int) -> DataFrame:
    """Windows whose fingerprint the sieve lets through: fp and wh (together 128 bits), doc_id, s, and mark,
    the hash of the whole text, so that equal texts have equal places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Sieve(np.frombuffer(sieve.value, np.uint8))
        for batch in batches:
            for ids, texts in chunks(zip(batch["doc_id"], batch["mark"]), batch["text"]):
                units, first = word_hashes(texts)
                starts, fps, _, _ = winnow(units, first, gram, length - gram + 1)
                pick = held.holds(fps)
                at, fps = starts[pick], fps[pick]
                if not len(at):
                    continue
                wh = range_hashes(units, at, at + length, "window")
                owners = np.searchsorted(first, at, side="right") - 1
                doc_id, mark = np.array(ids, np.int64).reshape(-1, 2)[owners].T
                yield pd.DataFrame(
                    {
                        "fp": fps.view(np.int64),
                        "wh": wh.view(np.int64),
                        "doc_id": doc_id,
                        "s": (at - first[owners]).astype(np.int32),
                        "mark": mark,
                    }
                )

    return docs.mapInPandas(run, "fp bigint, wh bigint, doc_id bigint, s int, mark bigint")


def _covered(spans: DataFrame, length: int) -> DataFrame:
    """Window starts of each document merged into spans [from, to) of words: one row for each doc_id and mark."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, mark, starts in zip(batch["doc_id"], batch["mark"], batch["starts"]):
                s = np.unique(np.asarray(starts))
                cut = np.flatnonzero(np.diff(s) > length)
                begin = s[np.concatenate([[0], cut + 1])]
                end = s[np.concatenate([cut, [len(s) - 1]])] + length
                out.append((doc_id, mark, np.stack([begin, end], axis=1).reshape(-1).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "mark", "spans"])

    # One document's windows are at most its own words.
    return spans.groupBy("doc_id", "mark").agg(F.collect_list("s").alias("starts")).mapInPandas(merge, "doc_id bigint, mark bigint, spans array<int>")


def dedup(
    batches: list[DataFrame], length: int = 35, gram: int = GRAM, log2_bits: int = 26, fan_in: int = 8, keep_text: bool = False, text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of all batches' documents."""
    batches = [b.select(whole_id(), text_mark(text_col), F.col(text_col).alias("text")) for b in batches]
    spark = batches[0].sparkSession
    log = FingerprintLog(spark, scratch_path(spark, "fingerprint-log"), length, gram, fan_in)
    hits = None
    for batch in batches:
        got = durable(log.append(batch))
        hits = got if hits is None else hits.unionByName(got)
        if len(log.runs) > log.fan_in:
            log.compact()
    sieve = spark.sparkContext.broadcast(_sieve(hits, log2_bits))
    log.drop()
    docs = batches[0]
    for batch in batches[1:]:
        docs = docs.unionByName(batch)
    # Copies of whole texts: every window of theirs starts in another document too.
    halves = [F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), at, 15), 16, 10).cast("bigint") for at in (1, 17)]
    texts = docs.select(halves[0].alias("one"), halves[1].alias("two"), "doc_id", "mark", F.monotonically_increasing_id().alias("row"))
    path = scratch_path(spark, "candidate-windows")
    copies = repeats(texts, ["one", "two"], ["doc_id", "mark", "row"], path + "-copies").groupBy("doc_id", "mark").agg(F.lit(True).alias("copied"))
    # As files they take a fifth of the room that rows take: but for wh the columns repeat.
    _windows(docs, sieve, length, gram).write.option("compression", "zstd").parquet(path)
    # One sort over all partitions tells which windows stand elsewhere; a frequent one is spread over many tasks.
    real = repeats(spark.read.parquet(path), ["fp", "wh"], ["doc_id", "mark", "s"], path + "-repeated")
    spans = _covered(real.withColumn("s", F.col("s").cast("int")), length)
    side = durable(spans.join(copies, ["doc_id", "mark"], "full_outer").select("doc_id", "mark", "spans", "copied", F.coalesce(F.size("spans"), F.lit(0)).alias("n_ends")))
    for done in ("", "-copies", "-repeated"):
        remove_path(spark, path + done)

    def keep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for doc_id, text, spans, copied in zip(batch["doc_id"], batch["text"], batch["spans"], batch["copied"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if copied is True and len(words) >= length:
                    kept = []
                elif spans is None:
                    kept = words
                else:
                    ends = np.asarray(spans).tolist()
                    kept, at = [], 0
                    for begin, end in zip(ends[::2], ends[1::2]):
                        kept += words[at:begin]
                        at = end
                    kept += words[at:]
                held = b" ".join(kept)
                row = (doc_id, len(words), len(words) - len(kept), hashlib.sha256(held).hexdigest())
                out.append((*row, held.decode("utf-8", "surrogatepass")) if keep_text else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    joined = attach(docs, side, ["doc_id", "mark"], "n_ends").select("doc_id", "text", "spans", "copied")
    return null_ids(joined.mapInPandas(keep, schema))


def in_batches(docs: DataFrame, count: int, key: str = "doc_id") -> list[DataFrame]:
    """docs cut into `count` batches by ranges of the key, as they would arrive one after another."""
    cuts = docs.approxQuantile(key, [k / count for k in range(1, count)], 0.01) if count > 1 else []
    cuts = sorted(set(cuts))
    if not cuts:
        return [docs]
    column = F.col(key)
    out = [docs.filter((column < F.lit(cuts[0])) | column.isNull())]
    out += [docs.filter((column >= F.lit(a)) & (column < F.lit(b))) for a, b in zip(cuts, cuts[1:])]
    return out + [docs.filter(column >= F.lit(cuts[-1]))]


def dedup_documents(spark: SparkSession, sf_dir: str, n_batches: int = 3, fan_in: int = 2) -> DataFrame:
    """The documents as three batches; the third run makes more than `fan_in`, so the log is compacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(in_batches(docs, n_batches), fan_in=fan_in)
