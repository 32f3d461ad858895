import itertools
import math
import random

import public_tokenizers

from tallyweave.llm import langid as m

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {"en": "the and of with house water through", "de": "der und das mit straße wasser durch", "fr": "le et de avec maison eau être"}


def test_forward_sums_all_segmentations():
    table = {"▁": (0.1, 0.2), "▁a": (0.2, 0.1), "a": (0.1, 0.1), "ab": (0.3, 0.05), "b": (0.05, 0.2), "▁ab": (0.01, 0.02)}
    for word in ("a", "ab", "abab", "zab", "zz"):
        marked = "▁" + word
        for k, got in enumerate(m.forward(word, m.with_prefixes(table), 2)):
            total = 0.0
            for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
                edges = [0, *[n for n, c in enumerate(cuts, 1) if c], len(marked)]
                parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
                total += math.prod(table.get(p, (0, 0))[k] + (m.STRAY if len(p) == 1 else 0) for p in parts)
            assert abs(got - math.log(total)) < 1e-9
    assert math.isfinite(m.forward("a" * 4000, m.with_prefixes(table), 2)[0])


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for d in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((d, " ".join(rng.choice(WORDS[lang].split()) for _ in range(12)), lang if d % 7 else None, "clash"))
    return spark.createDataFrame(rows + [(900, None, "en", ""), (901, "12 ...", "de", ""), (902, "", None, ""), (903, "日本語 " * 3000, None, "")], "doc_id long, text string, lang string, score string"), rows


def test_identify(spark):
    docs, rows = corpus(spark)
    got = {r["doc_id"]: r for r in m.identify(docs, PIECES).collect()}
    known = {d: lang for d, _, lang, _ in rows if lang}
    held = [d for d in known if got[d]["held_out"]]
    assert held and sum(got[d]["lang_pred"] == known[d] for d in held) / len(held) > 0.95
    assert all(got[d]["lang_pred"] == m.UNDETERMINED and got[d]["score"] == 0 for d in (900, 901, 902))
    assert got[903]["lang_pred"] in WORDS and all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the and", None)], "doc_id long, text string, lang string")
    assert m.identify(docs, PIECES).first()["lang_pred"] == m.UNDETERMINED
    assert m.identify(docs.limit(0), PIECES).count() == 0


def test_letters_by_unicode():
    assert m.words("x² ½ Ⅷ 12 _ हिन्दी e\u0301t\u00e9 \u0301") == ["x", "हिन्दी", "e\u0301t\u00e9"]
    scorer = m.Scorer(m.Model(["a", "b"], {"▁x": (0.1, 0.2)}))
    assert [scorer.score(t) for t in ("² ½", "Ⅷ", "\u0301", "१२")] == [(m.UNDETERMINED, 0.0)] * 4
    assert scorer.score("x")[0] == "b"


def test_long_words_are_learnt_whole():
    pieces = ["▁", "a", "b", "ab", "▁ab", "abab"]
    probs = {p: 0.1 for p in pieces}
    for word in ("ab" * 14, "ab" * 15):  # by products, by logarithms
        plain: dict = {}
        m._expected(word, 2.0, probs, 4, plain)
        assert abs(sum(len(p) * n for p, n in plain.items()) - 2.0 * (len(word) + 1)) < 0.01
    far: dict = {}
    m._expected("ab" * 500, 1.0, probs, 4, far)
    assert abs(sum(len(p) * n for p, n in far.items()) - 1001) < 1
