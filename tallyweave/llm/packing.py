"""Best-fit packing of token pieces into fixed-length sequences, over the whole table at once.

Each partition, a leaf, cuts its texts into pieces and counts them by length; the counts are summed over
nodes of leaves up to the root. Pieces of one length stand for each other, so the root packs the classes of
lengths best-fit (longest first), which is what packing the pieces one by one would give, and whose
work is bounded by the capacity, not by the table. Down the same tree each leaf learns the rank of its first piece
of each length, which gives every piece its sequence and offset. No bin is closed before all pieces are known.

Defined cases: a null or empty text is the end token alone; a text longer than the capacity is cut
into capacity-long pieces, the last one shorter; repeated rows are packed as often as they occur;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import attach, durable, held_by_worker, null_ids, whole_id

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECE + ", sequence_id bigint, offset bigint"


def _byte_letters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


#: Chunks whose tokens are plain to see: Latin letters and ASCII marks, no apostrophe (it opens
#: contractions), nothing that could be a special token, no letter whose lower case needs context or lies elsewhere.
_PLAIN = re.compile("[A-Za-z0-9!-&(-/:;=?@\\[-`{}~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_TOKEN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+|[0-9]|[^A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+")
#: The ASCII marks of plain chunks.
_MARKS = frozenset(filter(_PLAIN.fullmatch, map(chr, range(128)))) - set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Most plain chunks: a word, or a word and a mark.
_WORD = re.compile(f"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+)([{re.escape(''.join(sorted(_MARKS)))}]?)")
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(33)]


def _lowered(text: str) -> str:
    """The text in lower case where that gives the same ids: the tokenizer lowers letters, and up to U+00FF each
    by itself; a special token, in its own case, has a `<`."""
    if "<" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class _Entries(dict):
    """Ids by chunk; one that is not there is taken from the older half, or made."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]):
        self.make, self.old = make, old

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.make(chunk)
        self[chunk] = got
        return got


class ChunkIds:
    """Packed little-endian ids of space-free chunks of text, each computed when first met.

    The tokenizer drops white space and never merges across it, so a text's ids are its chunks' ids in
    turn; within a plain chunk the same holds for its runs of letters and of marks, which are entries of the
    same table. Memory is bounded: when `limit` entries are held they become the older half, of which those
    that are met again move on, and the rest goes at the next change."""

    def __init__(self, path: str, limit: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.new = _Entries(self._chunk, {})

    def _token(self, token: str) -> bytes:
        spelt = token if token.isascii() else codecs.charmap_decode(token.encode(), "strict", self.letters)[0]
        ids = [t.id for t in self.tokenize(spelt)]
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        lower, new = chunk.lower(), self.new
        if lower.isascii() and lower.isalpha() and chunk.isascii():
            return self._token(lower) if lower == chunk else new[lower]
        if word := _WORD.fullmatch(chunk):
            if word[2]:
                return new[lower[:-1]] + new[word[2]]
            return self._token(lower) if lower == chunk else new[lower]
        if not _PLAIN.fullmatch(chunk):
            return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        tokens = _TOKEN.findall(lower)
        return self._token(lower) if len(tokens) == 1 else b"".join(map(new.__getitem__, tokens))

    def ids(self, text: str) -> bytes:
        if len(self.new) > self.limit:
            self.new.old = {}
            self.new = _Entries(self._chunk, self.new)
        return b"".join(map(self.new.__getitem__, _lowered(text).replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its partition (leaf) and its rank among the
    leaf's pieces of the same length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, end = held_by_worker(tokenizer_path, lambda: ChunkIds(tokenizer_path)), np.asarray([end_id], "<u4").tobytes()
        leaf, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = table.ids(text or "") + end
                total = len(ids) // 4
                for n, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    out.append((doc_id, n, start, length, zlib.crc32(part), leaf, met[length]))
                    met[length] += 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "leaf", "nth"])

    return docs.select(whole_id(), F.col(text_col).alias("text")).mapInPandas(cut, PIECE + ", leaf int, nth bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: longest first, each into the bin with the least room that still takes it.

    Bins are held by the room they have left; a bit for each room that occurs makes a look-up one shift."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        need = lengths[i]
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
            bins[b].append(i)
            room -= need
        else:
            b, room = len(bins), capacity - need
            bins.append([i])
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def place_classes(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit over classes of equally long pieces, as best_fit packs them one by one: entries
    (length, first rank, first sequence, offset), and the number of sequences.

    The pieces of a length are ranked; from an entry's first rank on, each next one goes into the next
    sequence. Bins with the same filling are one group, so the work depends on the lengths that occur
    and not on the pieces."""
    entries: list[tuple[int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
    rooms, total = 0, 0

    def hold(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            groups.setdefault(room, []).append((first, n))
            rooms |= 1 << room

    for need in sorted(counts, reverse=True):
        rank, left = 0, counts[need]
        while left:
            fit = rooms >> need
            if fit:
                room = need + (fit & -fit).bit_length() - 1
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms &= ~(1 << room)
            else:
                room, first = capacity, total
                n = -(-left // (capacity // need))
                total += n
            # Each bin of the group is filled up before the next: whole ones, then at most one in part.
            each = room // need
            whole = min(n, left // each)
            for k in range(each if whole else 0):
                entries.append((need, rank + k * whole, first, capacity - room + k * need))
            hold(room - each * need, first, whole)
            rank, left = rank + each * whole, left - each * whole
            if whole < n:
                for k in range(left):
                    entries.append((need, rank + k, first + whole, capacity - room + k * need))
                part = 1 if left else 0
                hold(room - left * need, first + whole, part)
                hold(room, first + whole + part, n - whole - part)
                left = 0
    return entries, total


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    fan_in: int = 16,
    text_col: str = "text",
) -> DataFrame:
    """Pack docs(doc_id, text): one row per piece with its place (sequence_id, offset)."""
    held = durable(pieces(docs, tokenizer_path, capacity, end_id, text_col))
    leaves = held.groupBy("leaf", "length").agg(F.count(F.lit(1)).alias("n"))
    # A leaf's first rank: the pieces of the length in the nodes before its own, and in its own node before it.
    leaves = durable(leaves.withColumn("node", F.floor(F.col("leaf") / fan_in)))
    nodes = leaves.groupBy("node", "length").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    above = nodes.select("node", "length", F.coalesce(F.sum("n").over(before("length", "node")), F.lit(0)).alias("above"))
    own = leaves.withColumn("own", F.coalesce(F.sum("n").over(before("length", "node", "leaf")), F.lit(0)))
    firsts = durable(own.join(above, ["node", "length"]).select("leaf", "length", (F.col("above") + F.col("own")).alias("first")))
    counts = {r["length"]: r["n"] for r in nodes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    entries, _ = place_classes(counts, capacity)
    table = np.array(sorted(entries), np.int64).reshape(-1, 4)
    sent = docs.sparkSession.sparkContext.broadcast(((table[:, 0] << 44) + table[:, 1], table))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rows = sent.value
        for batch in batches:
            rank = batch["first"].to_numpy(np.int64) + batch["nth"].to_numpy(np.int64)
            found = rows[np.searchsorted(keys, (batch["length"].to_numpy(np.int64) << 44) + rank, side="right") - 1]
            yield batch.drop(columns=["nth", "first"]).assign(sequence_id=found[:, 2] + rank - found[:, 1], offset=found[:, 3])

    ranked = attach(held, firsts, ["leaf", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "first")
    return null_ids(ranked.mapInPandas(place, PLACED))
