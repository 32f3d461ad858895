import hashlib
import random
from collections import Counter

import pytest

from tallyweave.llm import fingerprint_log as f


def brute(rows, length):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c d é f g hh i j k l".split())
    shared = [" ".join(word() for _ in range(n)) for n in (8, 9, 12, 40)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        if d % 3 == 0:
            parts.insert(1, shared[d % 4])
        rows.append((d, " \n".join(parts)))
    return rows + [(100, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "x y " * 40), (105, "x " * 30), (106, " \t")]


@pytest.mark.parametrize("n_batches", [1, 3])
def test_against_brute_force(spark, n_batches):
    rows = corpus(n_batches)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = f.dedup(f.in_batches(docs, n_batches), length=9, gram=4, log2_bits=16, fan_in=1)
    assert sorted(map(tuple, got.collect())) == brute(rows, 9)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert f.dedup(f.in_batches(docs, 2)).count() == 0


def test_compaction_keeps_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "q r s t u v w z")], "doc_id long, text string")
    log = f.FingerprintLog(spark, str(tmp_path / "log"), length=5, gram=3)
    for d in (1, 2, 3):
        log.append(docs.filter(f"doc_id = {d}")).collect()
    before = {r["fp"] for run in log.runs for r in log.read(run).collect()}
    log.compact()
    (run,) = log.runs
    rows = log.read(run).collect()
    assert {r["fp"] for r in rows} == before and any(r["repeated"] for r in rows) and not all(r["repeated"] for r in rows)
    assert log.append(docs.filter("doc_id = 1")).count() > 0


def test_rows_without_or_with_one_id(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefghijkl") + rng.choice("abcdefghijkl") for _ in range(30))
    shared, twice = text(), text()
    rows = [(None, t) for t in (text(), shared + " " + text(), twice, twice, text() + " " + shared)] + [(9, text()), (9, "x " + shared), (9, text())]
    got = f.dedup([spark.createDataFrame(rows, "doc_id long, text string")], length=9, gram=4, log2_bits=16).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted([(d if d > 0 else None, *r) for d, *r in brute([(d or -1, t) for d, t in rows], 9)], key=key)
