import random

import pytest

from tallyweave.llm import line_dedup as m


def brute(rows, length):
    seen, out = set(), {}
    gone = {}
    for n, (d, t) in sorted(enumerate(rows), key=lambda x: x[1][0]):
        lines = [] if t is None else t.encode().split(b"\n")
        units = [k for k, x in enumerate(lines) if x.strip()]
        cut = set()
        for s in range(len(units) - length + 1):
            key = tuple(lines[k].strip() for k in units[s : s + length])
            if key in seen:
                cut |= set(units[s : s + length])
            seen.add(key)
        gone[d] = cut
        out[d] = None if t is None else b"\n".join(x for k, x in enumerate(lines) if k not in cut).decode()
    return out


@pytest.mark.parametrize("gram,window", [(1, 1), (2, 2), (1, 4), (3, 2)])
def test_against_brute_force(spark, gram, window):
    rng = random.Random(gram * 10 + window)
    rows = []
    for d in range(80):
        lines = [rng.choice(["a", "b", " b ", "c", "d", "é", "", "  "]) for _ in range(rng.randrange(0, 14))]
        rows.append((d, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "z\n" * 40), (94, rows[7][1])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, row string, lines int")
    got = {r["row"]["doc_id"]: r["lines"]["text"] for r in m.deduplicate(docs, gram, window).collect()}
    assert got == brute(rows, gram + window - 1)


def test_empty_table(spark):
    assert m.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_or_with_one_id(spark):
    shared = "one\ntwo\nthree"
    texts = ["a\n" + shared, "b\nc\n" + shared + "\nd\ne", "only line", "p\nq\nr\ns\nt\nu", shared + "\nz"]
    for doc_id in (None, 5):
        docs = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
        got = {r["row"]["text"]: r["lines"] for r in m.deduplicate(docs).collect()}
        holding = [t for t in texts if shared in t]
        kept = [t for t in holding if not got[t]["n_removed"]]
        assert len(kept) == 1 and all(got[t]["n_removed"] == 3 and got[t]["text"] == t.replace(shared + "\n", "").replace("\n" + shared, "") for t in holding if t not in kept)
        assert all(got[t]["n_removed"] == 0 and got[t]["text"] == t for t in texts if shared not in t)


def test_only_what_is_read_twice_is_written(spark, monkeypatch):
    cuts, gone = [], []
    durable, remove_path = m.durable, m.remove_path
    monkeypatch.setattr(m, "durable", lambda df: cuts.append(1) or durable(df))
    monkeypatch.setattr(m, "remove_path", lambda s, path: gone.append(path) or remove_path(s, path))
    docs = spark.createDataFrame([(n, "a\nb\nc\nd" + "\ne" * n) for n in range(6)], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in m.report(docs).collect()}
    assert removed == {0: 0, 1: 4, 2: 5, 3: 6, 4: 8, 5: 9}
    assert len(cuts) == 1 and len(gone) == 1
