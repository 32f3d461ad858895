"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may differ from a passage in k = floor(rate * m) edits. Cut into
k + 1 pieces, at least one of them stands unchanged in any such passage: all pieces are searched in one
pass (Aho-Corasick), and the surroundings of each hit are verified by Myers' bit-parallel distance.

Texts and items are normalised alike: lower case, and each run of other characters than letters and
digits becomes one space. The items are the stated query set; they are handled in blocks of at most
`block_chars` characters, one pass over the documents each, so what is sent to the executors is bounded.

An item so short that its budget is no error is one piece, and an exact passage is asked for; `min_chars`
can leave out short phrases, which are no evidence, but is off by default.

Defined cases: a null or empty text holds no passage; items that are null or hold no letter or digit are not
searched; equal items are each reported; repeated rows are reported each; a null doc_id or item_id comes
out null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import held_by_worker, null_ids, whole_id

FOUND = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint"
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall(text or "")).lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * n // (budget + 1) for n in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for n, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << n
    return masks


def myers(pattern: str, text: str, masks: dict[str, int] | None = None, enough: int = -1) -> list[int]:
    """For each end in text, the least edit distance of pattern to a passage that ends there.

    Stops early, with what it has, at the first distance that is `enough`."""
    m, masks = len(pattern), masks or _masks(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        across = eq | down
        eq |= ((eq & up) + up) ^ up
        grow, shrink = down | ~(eq | up) & full, up & eq
        if grow & high:
            score += 1
        elif shrink & high:
            score -= 1
        out.append(score)
        if score <= enough:
            break
        grow, shrink = grow << 1 & full, shrink << 1 & full
        up, down = shrink | ~(across | grow) & full, grow & across
    return out


def chains(item: str, budget: int) -> list[tuple[int, str, list]]:
    """The pieces as (offset, piece, nodes above, the nearest first).

    The pieces are the leaves of a binary tree; a node over l of them has budget l - 1. A passage
    within a node's budget is within that of one of its children (else there were l errors), so some
    leaf's whole chain holds, and a chance hit is mostly given up after a few characters."""
    leaves = pieces(item, budget)

    def node(low: int, high: int, above: list) -> list:
        if high - low == 1:
            return [(*leaves[low], above)]
        begin = leaves[low][0]
        text = item[begin : leaves[high - 1][0] + len(leaves[high - 1][1])]
        own = [] if high - low == len(leaves) else [(begin, text, _masks(text), high - low - 1)]
        middle = (low + high + 1) // 2
        return node(low, middle, own + above) + node(middle, high, own + above)

    return node(0, len(leaves), [])


def passages(item: str, text: str, budget: int) -> list[tuple[int, int, int]]:
    """(distance, start, end) of passages within the budget that do not overlap, from left to right, each
    with the nearest end of its neighbourhood. One pass over the text, and one back over each passage."""
    scores, backwards = myers(item, text), item[::-1]
    masks, out, free, at = _masks(backwards), [], 0, 0
    while at < len(scores):
        if scores[at] > budget:
            at += 1
            continue
        near = scores[at : at + 2 * budget + 1]
        end = at + near.index(min(near)) + 1
        back = myers(backwards, text[max(free, end - len(item) - budget) : end][::-1], masks)
        distance = min(back, default=budget + 1)
        if distance <= budget:
            out.append((distance, end - back.index(distance) - 1, end))
            free = end
        at = end
    return out


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        texts: dict[str, list[int]] = {}
        for item_id, text in items:
            texts.setdefault(text, []).append(item_id)
        self.items = [(text, ids, int(rate * len(text))) for text, ids in texts.items()]
        held: dict[str, list[tuple[int, int, list]]] = {}
        for n, (text, _, budget) in enumerate(self.items):
            for offset, piece, above in chains(text, budget):
                held.setdefault(piece, []).append((n, offset, above))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in a normalised text."""
        spans: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, offset, above in where:
                begin = last + 1 - size - offset
                if not all(myers(part, text[max(0, begin + at - k) : begin + at + len(part) + k], masks, k)[-1:] <= [k] for at, part, masks, k in above):
                    continue
                item, _, budget = self.items[n]
                begin, end = max(0, begin - budget), begin + len(item) + budget
                held = spans.setdefault(n, [])
                if held and begin <= held[-1][1]:
                    held[-1][0] = min(held[-1][0], begin)
                    held[-1][1] = max(held[-1][1], end)
                else:
                    held.append([begin, end])
        out = set()
        for n, held in spans.items():
            item, ids, budget = self.items[n]
            for begin, end in held:
                for distance, s, e in passages(item, text[begin:end], budget):
                    out |= {(i, distance, begin + s, begin + e) for i in ids}
        return sorted(out)


def _original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as spans of the text itself, in code points."""
    starts, words, at = [], [], 0
    for m in _WORD.finditer(text):
        starts.append(at)
        words.append(m.span())
        at += len(m.group().lower()) + 1
    from bisect import bisect_right

    out = []
    for s, e in spans:
        a, b = bisect_right(starts, s) - 1, bisect_right(starts, max(s, e - 1)) - 1
        left = min(words[a][1], words[a][0] + s - starts[a])
        out.append((left, max(left, min(words[b][1], words[b][0] + e - starts[b]))))
    return out


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield block


@F.pandas_udf(StringType())
def _normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normalised)


def leaks(
    docs: DataFrame, items: DataFrame, rate: float = 0.08, min_chars: int = 1, block_chars: int = 8_000_000, text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, distance, start, end: each passage of docs(doc_id, text) near an item(item_id, text)."""
    known = items.select(whole_id("item_id"), _normalised("text").alias("text")).filter(F.length("text") >= max(1, min_chars))
    spark, out = docs.sparkSession, None
    for block in _blocks(known, block_chars):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], sent=sent, key=key) -> Iterator[pd.DataFrame]:
            matcher = held_by_worker(key, lambda: Matcher(sent.value, rate)) if sent.value else None
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    if matcher and text and (got := matcher.find(normalised(text))):
                        spans = _original(text, [x[2:] for x in got])
                        rows += [(doc_id, *x[:2], *span) for x, span in zip(got, spans)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"])

        found = docs.select(whole_id(), F.col(text_col).alias("text")).mapInPandas(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return null_ids(out, "doc_id", "item_id")
