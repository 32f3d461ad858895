"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces (forward algorithm), a text's the product over its words,
each a letter and the letters and combining marks after it, in lower case. The piece probabilities are
learnt by expectation maximisation (forward-backward) on word counts of labelled documents. Pieces with
capitals are left out, which no such word can hold.

The classifier is fitted on a bounded sample: of each language the labelled documents whose hash is below
its share, `docs_per_language` on average, and of their words the most frequent, `words_per_language` at
most (a count that only part of its words could enter with stays out). Prediction covers every document.

Defined cases: a null, empty or letterless text is `und` with score 0 (digits, fractions, number letters
and lone marks are no letters); without labelled documents all are; ties go to the language that sorts
first; a letter that no piece covers costs the same in every language; very long words are learnt and scored
whole; repeated rows each get their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable, held_by_worker

UNDETERMINED = "und"
#: Probability of a letter that is not a piece.
STRAY = 1e-7
#: A text's log-odds are divided by this power of its number of words: words are not independent.
EVIDENCE = 0.5


def vocabulary(path: str) -> list[str]:
    """Pieces without control and byte symbols; a leading mark stands for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (n for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n)))
    return [p for n in keep if (p := model.id_to_piece(n)) == p.lower()]


def _ranges(category: str, last: int) -> str:
    """The characters up to `last` of a Unicode category (its first letter) as ranges of a character class."""
    out, start = [], None
    for n in range(last + 2):
        inside = n <= last and unicodedata.category(chr(n))[0] == category
        if inside and start is None:
            start = n
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{n - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=2)
def _letters(last: int) -> re.Pattern:
    return re.compile(f"[{_ranges('L', last)}][{_ranges('L', last)}{_ranges('M', last)}]*")


_FAR = re.compile("[\U00010000-\U0010ffff]")


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    # Without far characters, which are rare, the class is a table; otherwise it is a list of ranges too.
    return _letters(sys.maxunicode if _FAR.search(text) else 0xFFFF).findall(text)


def with_prefixes(table: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, ...] | None]:
    """The table and, as None, all prefixes of its pieces: a look-up can stop where nothing goes on."""
    out: dict[str, tuple[float, ...] | None] = {p[:n]: None for p in table for n in range(1, len(p))}
    return out | table


def forward(word: str, table: dict[str, tuple[float, ...] | None], n_languages: int, longest: int = 64) -> list[float]:
    """Log-probability of a word in each language, summed over all segmentations; no piece is longer than `longest`."""
    marked = "▁" + word
    size = len(marked)
    found: list[list] = [[] for _ in range(size + 1)]
    for begin in range(size):
        for end in range(begin + 1, size + 1):
            got = table.get(marked[begin:end], False)
            if got:
                found[end].append((begin, got))
            elif got is False:
                break
    out = []
    for k in range(n_languages):
        sums, scale, total = [1.0], 0.0, 1.0
        for arcs in found[1:]:
            total *= STRAY
            for begin, got in arcs:
                total += sums[begin] * got[k]
            if total < 1e-200:  # keep the live window in range; further back no piece reaches
                low = max(0, len(sums) - longest)
                sums[low:] = [x / total for x in sums[low:]]
                scale += math.log(total)
                total = 1.0
            sums.append(total)
        out.append(math.log(total) + scale)
    return out


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    high, low = (x, y) if x >= y else (y, x)
    return high + math.log1p(math.exp(low - high))


def _expected(word: str, weight: float, probs: dict[str, float], longest: int, counts: dict[str, float]) -> None:
    """Add the expected uses of each piece in a word (forward-backward) to counts; long words by logarithms."""
    marked = "▁" + word
    size = len(marked)
    arcs = [(b, e, p, q) for e in range(1, size + 1) for b in range(max(0, e - longest), e) if (q := probs.get(p := marked[b:e])) is not None]
    if size > 30:
        ahead, back, at, stray = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0], 0, math.log(STRAY)
        for e in range(1, size + 1):
            ahead[e] = ahead[e - 1] + stray
            while at < len(arcs) and arcs[at][1] == e:
                ahead[e] = _add(ahead[e], ahead[arcs[at][0]] + math.log(arcs[at][3]))
                at += 1
        for n in range(size, 0, -1):
            back[n - 1] = _add(back[n - 1], back[n] + stray) if back[n - 1] > -math.inf else back[n] + stray
            while at and arcs[at - 1][1] == n:
                at -= 1
                b, more = arcs[at][0], back[n] + math.log(arcs[at][3])
                back[b] = _add(back[b], more) if back[b] > -math.inf else more
        for b, e, p, q in arcs:
            counts[p] = counts.get(p, 0.0) + weight * math.exp(ahead[b] + math.log(q) + back[e] - ahead[size])
        return
    ahead = [1.0] + [0.0] * size
    at = 0
    for e in range(1, size + 1):
        ahead[e] = ahead[e - 1] * STRAY
        while at < len(arcs) and arcs[at][1] == e:
            ahead[e] += ahead[arcs[at][0]] * arcs[at][3]
            at += 1
    back = [0.0] * size + [1.0]
    for n in range(size, 0, -1):
        back[n - 1] += back[n] * STRAY
        while at and arcs[at - 1][1] == n:
            at -= 1
            back[arcs[at][0]] += back[n] * arcs[at][3]
    for b, e, p, q in arcs:
        counts[p] = counts.get(p, 0.0) + weight * ahead[b] * q * back[e] / ahead[size]


def fit_language(counts: list[tuple[str, int]], pieces: list[str], rounds: int) -> dict[str, float]:
    """Piece probabilities of one language from word counts."""
    probs, longest = {p: math.exp(-3.0) / 32 for p in pieces}, max(map(len, pieces), default=1)
    for _ in range(rounds):
        found: dict[str, float] = {}
        for word, n in counts:
            _expected(word, n, probs, longest, found)
        total = sum(found.values())
        # Pieces that no word uses keep a small share, so that each language can spell any word.
        floor = 0.1 / (total + 0.1 * len(pieces)) if total else 1.0 / len(pieces)
        probs = {p: (found.get(p, 0.0) + 0.1) / (total + 0.1 * len(pieces)) if total else floor for p in pieces}
    return probs


@dataclass
class Model:
    languages: list[str]
    table: dict[str, tuple[float, ...]]


def held_out(doc_id: Column) -> Column:
    """A null id is not held out, and not learnt from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, vocabulary_path: str, docs_per_language: int = 400, words_per_language: int = 4000, rounds: int = 2) -> Model:
    """Learn from docs(doc_id, text, lang) that are not held out and have a language.

    Counts and thresholds are partial aggregates; no language's documents or words are gathered in one task."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A few languages; the share of each language's documents that is learnt from, in 2 ** 30ths.
    shares = {lang: min(1 << 30, (docs_per_language << 30) // n) for lang, n in labelled.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not shares:
        return Model([], {})
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    below = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    sample = labelled.filter(draw < F.try_element_at(below, F.col("lang")))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    spoken = sample.select("lang", F.explode(split("text")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    spoken = durable(spoken)
    least: dict[str, int] = {}
    sizes: dict[str, list[tuple[int, int]]] = {}
    for lang, n, size in spoken.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("size")).collect():  # different counts: few
        sizes.setdefault(lang, []).append((n, size))
    for lang, held in sizes.items():
        room = words_per_language
        for n, size in sorted(held, reverse=True):
            room -= size
            if room < 0:
                break
            least[lang] = n
    if not least:
        return Model([], {})
    from_n = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    top = spoken.filter(F.col("n") >= F.try_element_at(from_n, F.col("lang")))
    by_language: dict[str, list[tuple[str, int]]] = {}
    for lang, word, n in sorted((r["lang"], r["word"], r["n"]) for r in top.collect()):
        by_language.setdefault(lang, []).append((word, n))
    pieces = vocabulary(vocabulary_path)
    longest = max(map(len, pieces))
    # Only pieces that some sampled word holds can differ between languages; the others stay out.
    used = {marked[b:e] for held in by_language.values() for w, _ in held for marked in ("▁" + w,) for b in range(len(marked)) for e in range(b + 1, min(b + longest, len(marked)) + 1)}
    pieces = [p for p in pieces if p in used or len(p) == 1]
    languages = sorted(by_language)
    fitted = [fit_language(by_language[lang], pieces, rounds) for lang in languages]
    return Model(languages, {p: tuple(f[p] for f in fitted) for p in pieces})


class Scorer:
    """Scores texts. Words met before are looked up; when `limit` words are held they become the older
    half, of which those that are met again move on, so memory is bounded."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.table, self.longest = with_prefixes(model.table), max(map(len, model.table), default=1)
        self._start({}, np.zeros((0, len(model.languages))))

    def _start(self, old: dict[str, int], old_rows: np.ndarray) -> None:
        self.old, self.old_rows, self.new = old, old_rows, {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def score(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        n = len(self.model.languages)
        if not found or not n:
            return UNDETERMINED, 0.0
        if len(self.new) > self.limit:
            self._start(self.new, self.rows)
        new, counts = self.new, Counter(found)
        for word in [w for w in counts if w not in new]:
            at = self.old.get(word)
            if len(new) == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(new)] = forward(word, self.table, n, self.longest) if at is None else self.old_rows[at]
            new[word] = len(new)
        at = np.fromiter(map(new.__getitem__, counts), np.int64, len(counts))
        totals = np.fromiter(counts.values(), float, len(counts)) @ self.rows[at]
        best = int(np.argmax(totals))
        shares = np.exp((totals - totals[best]) / len(found) ** EVIDENCE)
        return self.model.languages[best], float(1.0 / shares.sum())


def tagger(spark: SparkSession, model: Model):
    """A column function: text -> struct<lang_pred, score>."""
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held_by_worker(key, lambda: Scorer(sent.value))
        for texts in parts:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["lang_pred", "score"])

    return tag


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    tag = tagger(docs.sparkSession, model)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tag(F.col(text_col)).alias("tag")).select("doc_id", "tag.lang_pred", "tag.score")


def identify(docs: DataFrame, vocabulary_path: str, **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs, vocabulary_path, **settings))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
