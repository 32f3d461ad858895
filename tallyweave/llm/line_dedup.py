"""Line dedup by winnowing over line hashes.

The units are a text's lines, trimmed of white space; blank lines are no units and always stay. Of each
`window` neighbouring k-grams of line hashes the minima are chosen, so every run of `gram + window - 1`
lines (three by default) holds a chosen one. Chosen positions whose fingerprint stands nowhere else are left
behind. From the others the match is extended both ways, by 0 to `window - 1` lines to the left and the rest
of the run to the right: places with the fingerprint and equal lines on both sides are the same run. Of equal
runs the first by (doc_id, line) stays, and the lines of all later ones are deleted; longer repeats are
covered by the runs around their chosen positions.

Defined cases: a null text stays null with no lines; an empty text has no units; a text with fewer lines
than a run is left alone; a run repeated inside a document counts from its second place on; rows with
the same doc_id and text are one place, those with other texts are not; a null doc_id comes before all
others; an empty table gives no rows; extra columns pass through `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, chunks, durable, let_go, mixed, range_hashes, remove_path, repeats, scratch_path, text_mark, whole_id, winnow

_BLANK = b" \t\n\x0b\x0c\r"


def units(text: bytes) -> list[int]:
    """Numbers of the lines that are not blank."""
    return [n for n, line in enumerate(text.split(b"\n")) if line.strip(_BLANK)]


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = [], [0]
    for text in texts:
        hashes += [xxhash.xxh3_64_intdigest(x) for line in text.split(b"\n") if (x := line.strip(_BLANK))]
        first.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(first, np.int64)


def extended(hashes: np.ndarray, first: np.ndarray, at: np.ndarray, owners: np.ndarray, gram: int, window: int):
    """For each chosen position and each reach to the left (0 to window - 1 lines) that gives a whole run inside
    its document: (number of the position, start of the run, hash of the lines on both sides)."""
    for reach in range(window):
        start, end = at - reach, at + gram + window - 1 - reach
        held = np.flatnonzero((start >= first[owners]) & (end <= first[owners + 1]))
        left = range_hashes(hashes, start[held], at[held], "window")
        right = range_hashes(hashes, at[held] + gram, end[held], "window")
        yield held, start[held], mixed(left ^ mixed(right + np.uint64(reach)))


def matches(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """fp, around, doc_id, mark, s: every chosen position of docs(doc_id, mark, text) with each of its extensions
    (the fingerprint, a hash of the lines to both sides, and where the run starts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            for ids, texts in chunks(zip(batch["doc_id"], batch["mark"]), batch["text"]):
                hashes, first = _lines(texts)
                _, _, at, fps = winnow(hashes, first, gram, window)
                owners = np.searchsorted(first, at, side="right") - 1
                keys = np.array(ids, np.int64).reshape(-1, 2)
                for held, start, around in extended(hashes, first, at, owners, gram, window):
                    doc_id, mark = keys[owners[held]].T
                    yield pd.DataFrame({"fp": fps[held].view(np.int64), "around": around.view(np.int64), "doc_id": doc_id, "mark": mark, "s": start - first[owners[held]]})

    return docs.mapInPandas(run, "fp bigint, around bigint, doc_id bigint, mark bigint, s bigint")


def later_runs(docs: DataFrame, gram: int = 2, window: int = 2, written: bool = True) -> DataFrame:
    """doc_id, mark, starts and n_starts: the first lines (counted over units) of the runs that occur earlier, and how many.

    docs: doc_id, mark, text. The mark tells rows with one doc_id (or none) and different texts apart.
    Positions meet by fingerprint and equal sides in one sort over all partitions, which splits frequent lines. Before it
    (sampled for the bounds of the sort, then read) they are written, or shuffled once more: that takes more memory, but an
    executor starts processes for each file it writes, and while one starts all memory of the JVM is seen twice."""
    path = scratch_path(docs.sparkSession, "line-later")
    places = matches(docs, gram, window)
    if written:
        places.write.option("compression", "zstd").parquet(path + "-matches")
        places = docs.sparkSession.read.parquet(path + "-matches")
    else:
        places = places.hint("rebalance", "doc_id", "s")
    later = repeats(places, ["fp", "around"], ["doc_id", "mark", "s"], path, later_only=True)
    starts = later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.col("s").cast("int"))).alias("starts"))
    starts = durable(starts.withColumn("n_starts", F.size("starts")))
    for done in [path] + [path + "-matches"] * written:
        remove_path(docs.sparkSession, done)
    return starts


def cut(text: str | None, starts, length: int) -> tuple[str | None, int, int]:
    """The text without the runs' lines, the number of its units and of those deleted."""
    if text is None:
        return None, 0, 0
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    held = [n for n, line in enumerate(lines) if line.strip(_BLANK)]
    gone = {held[k] for s in ([] if starts is None else starts) for k in range(s, s + length)}
    kept = b"\n".join(line for n, line in enumerate(lines) if n not in gone)
    return kept.decode("utf-8", "surrogatepass"), len(held), len(gone)


def deduplicate(docs: DataFrame, gram: int = 2, window: int = 2, id_col: str = "doc_id", text_col: str = "text", written: bool = True) -> DataFrame:
    """`row`, all columns of docs as a struct, and `lines`: struct<text, n_lines, n_removed>."""
    key = whole_id(id_col).alias("doc_id"), text_mark(text_col)
    texts = docs.select(*key, F.col(text_col).alias("text"))
    side = later_runs(texts, gram, window, written)
    length = gram + window - 1
    keyed = docs.select(*key, F.struct(*docs.columns).alias("row"))

    @F.pandas_udf("text string, n_lines bigint, n_removed bigint")
    def cut_all(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        let_go()
        return pd.DataFrame([cut(t, s, length) for t, s in zip(text, starts)], columns=["text", "n_lines", "n_removed"])

    # Spark would copy it into each filter on `lines`: texts cut twice, by two workers a task, which stay for all later stages.
    once = cut_all.asNondeterministic()
    return attach(keyed, side, ["doc_id", "mark"], "n_starts").select("row", once(F.col("row")[text_col], F.col("starts")).alias("lines"))


def report(docs: DataFrame, gram: int = 2, window: int = 2) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the remaining text (null: empty)."""
    out = deduplicate(docs.select("doc_id", "text"), gram, window, written=False)
    return out.select("row.doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("lines.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
