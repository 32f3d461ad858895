import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyweave.llm import packing as m

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hi<|endoftext|> there", "á ́b É É", "ΣΑΣ İx ıx ǅ ŉa", "!\x1c! a\x1cb", "don't 're x's a12b", "a\xa0b_c—d", "  ", "Ångström ſ ÿ Ŀl x́", "日本語 テスト", "x​y ­- ªº µm ×÷", "a\n\nb\tc"]


def test_ids_are_the_tokenizers_ids():
    table, plain = m.ChunkIds(PATH, limit=20), Tokenizer.from_file(PATH)
    for text in ODD * 3 + ["word, " * 300]:
        assert np.frombuffer(table.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_best_fit():
    rng = random.Random(8)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    bins = m.best_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill) <= 100 and len(bins) <= -(-sum(lengths) // 100) * 1.03 + 1
    assert m.best_fit([], 5) == []


def test_pack(spark):
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice(["cat", "dog", "a", "xylophone"]) for _ in range(rng.randrange(0, 90)))) for n in range(200)] + [(500, None), (501, ""), (502, "a " * 300), (502, "a " * 300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(7)
    got = [r.asDict() for r in m.pack(docs, PATH, capacity=64, fan_in=3).collect()]
    plain = Tokenizer.from_file(PATH)
    wanted = []
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 64):
            wanted.append((d, p // 64, p, len(ids[p : p + 64]), zlib.crc32(np.array(ids[p : p + 64], "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(wanted)
    total = sum(r["length"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-total // 64) * 1.02 + 1
    assert m.pack(docs.limit(0), PATH).count() == 0


def test_classes_are_packed_like_pieces():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.randrange(1, 60)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 150))]
        entries, total = m.place_classes({x: lengths.count(x) for x in set(lengths)}, capacity)
        assert total == len(m.best_fit(lengths, capacity))
        held = {}
        for length in set(lengths):
            own = sorted(e for e in entries if e[0] == length)
            for rank in range(lengths.count(length)):
                _, first, sequence, offset = max(e for e in own if e[1] <= rank)
                held.setdefault(sequence + rank - first, []).append((offset, length))
        assert set(held) == set(range(total))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_long_and_short_texts_apart(spark):
    # Texts a little over half the capacity in the first partitions, short ones in the last.
    rows = [(n, "cat " * (35 if n < 300 else 3)) for n in range(300 + 300 * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    got = m.pack(docs, PATH, capacity=64, fan_in=3).select("sequence_id", "length").collect()
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 64)


def test_letters_whose_lower_case_lies_elsewhere():
    table, plain = m.ChunkIds(PATH), Tokenizer.from_file(PATH)
    odd = ["aƁara1 ƁARA, xƏy2", "aȺb1 ȺB. b\u023eB", "ÀÉ.Þß ĀĂ.1 Ÿÿ,", "<|ENDOFTEXT|> A<|endoftext|>B", "µM ªA ºB Ab\xa0C"]
    odd += [f"a{chr(c)}b1 {chr(c)}A. {chr(c)}" for c in range(0x80, 0x260)]
    for text in odd:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(table.ids(text), "<u4").tolist() == ids


def test_words_are_held_once():
    table = m.ChunkIds(PATH)
    tokenize, made = table.tokenize, []
    table.tokenize = lambda x: made.append(x) or tokenize(x)
    table.ids("House house, HOUSE. \u00c9t\u00e9 \u00e9t\u00e9! (house)")
    assert len(made) == len(set(made)) == 7  # two words and five marks
