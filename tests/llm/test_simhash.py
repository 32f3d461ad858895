import random

import numpy as np
import xxhash

from tallyweave.llm import simhash as m
from tallyweave.llm.components import components


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if grams else 0


def union(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for text in (None, "", " \t", "One", "one Two", "a b c", "É é A B c D e", "x " * 5000, "the cat sat on the mat and the cat sat"):
        assert m.fingerprint(text)[0] == (slow_fingerprint(text),)


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE", 5)
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(60)) for _ in range(25)]
    texts = base + [t + " end" for t in base] + [t.replace("ab", "xy", 1) for t in base] + base[:5] + [None, "", "\n", "one", "One"]
    rows = [(n, t, "clash") for n, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in m.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string"), radius=6).collect()}
    fps = [m.fingerprint(t)[0][0] for t in texts]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6]
    assert got == union(range(len(texts)), near)


def test_near_copies_by_similarity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(20):
        words = [word() for _ in range(150)]
        for k in range(3):
            copy = list(words)
            copy[10 * k] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(900 + k, " ".join(word() for _ in range(100))) for k in range(20)]
    dropped = {r["doc_id"] for r in m.surplus(spark.createDataFrame(rows, "doc_id long, text string"), **m.SIMILAR).collect()}
    assert dropped == {i for i in range(60) if i % 3}


def test_tile_stars_within_and_between():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**8, (30, 1), dtype=np.uint64), rng.integers(0, 2**8, (20, 1), dtype=np.uint64)
    ids = np.arange(30), np.arange(100, 120)
    near = [(int(i), int(j)) for i, x in zip(ids[0], a[:, 0]) for j, y in zip(ids[1], b[:, 0]) if int(x ^ y).bit_count() <= 1]
    assert union([*ids[0], *ids[1]], m.tile_stars(a, b, *ids, 1)) == union([*ids[0], *ids[1]], near)
    own = [(i, j) for i in range(30) for j in range(i) if int(a[i, 0] ^ a[j, 0]).bit_count() <= 2]
    assert union(range(30), m.tile_stars(a, None, ids[0], None, 2)) == union(range(30), own)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(20)]
    nodes = {x for e in edges for x in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == union(nodes, edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert m.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similarity_is_verified(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(15):
        words = [word() for _ in range(120)]
        for changes in (0, 1, 2, 3, 5, 7, 9):
            copy = list(words)
            for k in range(changes):
                copy[6 + 12 * k] = word()
            texts.append(" ".join(copy))
    noise = "same old words again here " * 400
    texts += [noise + " ".join(word() for _ in range(60)) for _ in range(5)] + [texts[0]] * 2 + [None, "", "one two"]
    sets = [set(m.shingle_set(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = union(range(len(texts)), near)
    dropped = {r["doc_id"] for r in m.surplus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **m.SIMILAR).collect()}
    assert dropped == {i for i in roots if roots[i] != i}
