import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from tallyweave.llm import pii as m
from tallyweave.llm import queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *x.span()) for x in EMAIL.finditer(text)]
    out += [("ip", *x.span()) for x in IP.finditer(text) if all(int(p) <= 255 for p in x[0].split("."))]
    out += [("card", *x.span()) for x in CARD.finditer(text) if 13 <= len(digits(x[0])) <= 19 and m.luhn(digits(x[0]))]
    return out + [("phone", *x.span()) for x in PHONE.finditer(text) if 9 <= len(digits(x[0])) <= 15]


def test_base_spans():
    rng = np.random.default_rng(6)
    alphabet = np.array(list("ab1234567890@@..+- ()%_é\n"))
    texts = ["".join(rng.choice(alphabet, 60)) for _ in range(2000)]
    texts += ["a@b.c_d@e.f", "@@a.b", "x@y.z@w.v.u", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (017) 555-7713", "0.0.0." + "0" * 5000, "a" * 5000 + "@b.c", ""]
    for t in texts:
        if "0" * 5000 not in t:
            assert m.base_spans(t) == plain(t), t
    assert m.base_spans(texts[-3])[0][0] == "ip" and m.base_spans(texts[-2]) == [("email", 0, 5004)]


def test_gradients():
    rng = np.random.default_rng(0)
    model, ids, gold = m.Tagger(embed=4, hidden=3), rng.integers(0, 129, (2, 9)), rng.integers(0, m.LABELS, (2, 9))
    _, grads = model.step(ids, gold)
    for name, p in model.p.items():
        at = (int(ids[0, 2]), 1) if name == "E" else tuple(int(rng.integers(0, s)) for s in p.shape)
        p[at] += 1e-5
        high, _ = model.step(ids, gold)
        p[at] -= 2e-5
        low, _ = model.step(ids, gold)
        p[at] += 1e-5
        assert abs((high - low) / 2e-5 - grads[name][at]) < 1e-6


def viterbi(decoder, e):
    score, back = e[0] + decoder.start, []
    for t in range(1, len(e)):
        ways = score[:, None] + decoder.trans
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e[t]
    label = int(score.argmax())
    out = [label]
    for ways in reversed(back):
        label = int(ways[label])
        out.append(label)
    return out[::-1]


@pytest.fixture(scope="module")
def decoder():
    return m.Decoder(m.trained())


def made(seed, n):
    rng = random.Random(seed)
    return [m._made_window(rng) for _ in range(n)]


def laid(texts):
    return m._classes("".join(texts)), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def test_scores_are_the_taggers(decoder):
    texts = [t for t, _ in made(3, 40)]
    want, _ = m.trained().emissions(np.stack([m._classes(t) for t in texts]))
    want[:, :, 0] -= 0.4
    assert np.abs(want.transpose(1, 0, 2).reshape(-1, m.LABELS) - decoder.scores(*laid(texts), lanes=7)).max() < 1e-3


def test_labels_are_the_best_of_whole_texts(decoder):
    parts = made(4, 120)
    texts = ["".join(t for t, _ in parts[k : k + 6]) for k in range(0, 120, 6)] + ["", "x" * 3000, "+1 (555) 123-4567", "12 " * 900]
    classes, first = laid(texts)
    e = decoder.scores(classes, first)
    got = decoder.labels(e, first, lanes=5)
    for a, b in zip(first[:-1], first[1:]):
        assert a == b or got[a:b].tolist() == viterbi(decoder, e[a:b])


def test_long_spans_over_the_edges_of_windows(decoder):
    for part in ("j.doe (at) example (dot) org", "firstname.lastname (at) department.university (dot) example (dot) org", "555-123-4567", "4111.1111.1111.1111", "john dot smith at example dot com"):
        for offsets in (range(0, 60), range(m.STRIDE - 80, m.STRIDE + 80)):
            texts = [("anda the rela of tion " * 60)[:offset] + " " + part + " and so on" for offset in offsets]
            found = [[text[s:e] for _, s, e in base + added] == [part] for text, (base, added, _) in zip(texts, m.find(decoder, texts))]
            assert sum(found) / len(found) > 0.85, (part, found)


def test_held_out_spans(decoder):
    parts = made(99, 400)
    classes, first = laid([t for t, _ in parts])
    got, gold = decoder.labels(decoder.scores(classes, first), first), np.concatenate([g for _, g in parts])
    assert (got == gold).mean() > 0.97 and (got == gold)[gold > 0].mean() > 0.93


def test_the_model_alone_on_the_documents(decoder):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{path}' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    base = [set(m.base_spans(t)) for t in texts]
    spans = [set(x) for x in decoder.spans(texts, 0.0)]
    assert sum(len(b & s) for b, s in zip(base, spans)) / sum(map(len, base)) > 0.85
    tokens = [(n, x.start(1), x.end(1)) for n, t in enumerate(texts) for x in re.finditer('(?i)token = "([0-9a-f]{40})"', t)]
    found = {(n, s, e) for n, (_, _, secrets) in enumerate(m.find(decoder, texts)) for _, s, e in secrets}
    assert tokens and len(found & set(tokens)) / len(tokens) > 0.95 and len(found - set(tokens)) <= 0.1 * len(tokens)


def test_apart_is_every_pair():
    rng = random.Random(2)
    for _ in range(200):
        cut = lambda n: [("ip", s := rng.randrange(60), s + rng.randrange(1, 9)) for _ in range(n)]
        spans, base = cut(6), cut(5)
        assert m.apart(spans, base) == [x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in base)]


def test_training_learns():
    parts = made(98, 100)
    decoder = m.Decoder(m.train(1600, 4, 32))
    classes, first = laid([t for t, _ in parts])
    assert (decoder.labels(decoder.scores(classes, first), first) == np.concatenate([g for _, g in parts])).mean() > 0.9


def test_scan(spark):
    rows = [(1, "mail a.b@c.org or 10.0.0.1"), (2, None), (3, ""), (4, "z" * 200_000), (1, "mail a.b@c.org or 10.0.0.1"), (None, "mail a.b@c.org or 10.0.0.1"), (5, 'key = "0123456789abcdef0123456789abcdef01234567" here')]
    got = [r for r in m.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")).collect()]
    assert got[0]["spans"] == "email:5:14,ip:18:26" and got[0] == got[4] and got[5]["doc_id"] is None and got[5][1:] == got[0][1:]
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[6]["secrets"], got[6]["n_secret"], got[6]["n_found"], got[6]["spans"]) == ("secret:7:47", 1, 1, "")
    assert m.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_result_by_brute_force(spark, decoder):
    """Every column of the query, row by row: base spans by regular expressions, the rest by plain Viterbi."""
    texts = ["".join(t for t, _ in made(40 + k, 5)) for k in range(20)]
    got = {r["doc_id"]: r for r in m.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (m.MODEL_KINDS.index(x[0]), x[1])))
    for n, text in enumerate(texts):
        tags, base, more, at = viterbi(decoder, decoder.scores(*laid([text]))), plain(text), [], 0
        while at < len(tags):
            end = at + 1
            while tags[at] & 1 and end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            if tags[at] & 1:
                more.append((m.MODEL_KINDS[tags[at] // 2], at, end))
            at = end
        more = [(m.checked(x[0], text[x[1] : x[2]]), *x[1:]) for x in more if m.checked(x[0], text[x[1] : x[2]]) and not any(s < x[2] and x[1] < e for _, s, e in base)]
        scores = decoder.scores(*laid([text]))
        more = [x for x in more if np.mean([scores[t, tags[t]] - scores[t, 0] for t in range(x[1], x[2])]) >= 0]
        kinds = base + [x for x in more if x[0] != "secret"]
        assert got[n]["spans"] == line(kinds) and got[n]["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert [got[n][f"n_{k}"] for k in m.KINDS] == [sum(x[0] == k for x in kinds) for k in m.KINDS]
        assert got[n]["secrets"] == line([x for x in more if x[0] == "secret"])


def test_counts_of_the_query_are_of_base_spans(spark, tmp_path):
    """Whatever the model adds, the query's counts and digest are those of the regular expressions."""
    texts = ["".join(t for t, _ in made(70 + k, 3)) for k in range(12)] + [None, "", "a.b@c.org, j.doe (at) example (dot) org, 10.0.0.1, 555-123-4567, +1 (017) 555-7713, 4111.1111.1111.1111 and 4111 1111 1111 1111"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    total = dict.fromkeys(m.KINDS, 0)
    for n, text in enumerate(texts):
        base, every = plain(text or ""), [x.split(":")[0] for x in got[n]["spans"].split(",") if x]
        assert [got[n][f"n_{k}"] for k in m.KINDS] == [sum(x[0] == k for x in base) for k in m.KINDS]
        assert got[n]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert got[n]["n_added"] == len(every) - len(base) and got[n]["n_found"] == len(every) + got[n]["n_secret"]
        for k in m.KINDS:
            total[k] += every.count(k) - got[n][f"n_{k}"]
    assert all(total[k] > 0 for k in ("email", "card", "phone"))  # the model does add here
    assert [c for c, _ in queries.op5_pii(spark, str(tmp_path)).dtypes][:7] == ["doc_id", *[f"n_{k}" for k in m.KINDS], "base_sha256", "spans"]


def test_windows_of_all_lengths_score_as_alone():
    """Windows that are over are left out of the steps that follow; the scores stay those of each text alone."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab @.0123é") for _ in range(n)) for n in (0, 1, 2, 15, 16, 17, 31, 33, 400, m.STRIDE, m.STRIDE + 1, 2 * m.STRIDE + 40)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = m.Decoder(m.trained())
    asked = []
    step, model._run = model._run, lambda *x: asked.append(x) or step(*x)
    together = model.scores(m._classes("".join(texts)), first)
    for n, text in enumerate(texts):
        alone = model.scores(m._classes(text), np.array([0, len(text)]))
        np.testing.assert_allclose(together[first[n] : first[n + 1]], alone, atol=1e-4)
    sizes = asked[0][1]
    assert list(sizes) == sorted(sizes, reverse=True) and sizes.sum() < 0.6 * len(sizes) * sizes[0]
