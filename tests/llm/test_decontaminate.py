import random

from tallyweave.llm import decontaminate as m


def distances(pattern, text):
    row, out = list(range(len(pattern) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (p != c)))
        row = new
        out.append(row[-1])
    return out


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcxyz"))
    return "".join(chars)


def test_myers_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (20, 60))
        assert m.myers(p, t) == distances(p, t)


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8)))
    for _ in range(60):
        item = " ".join(word() for _ in range(rng.randrange(10, 40)))
        budget = int(0.1 * len(item))
        text = " ".join(word() for _ in range(60)) + " " + edited(rng, item, rng.randrange(0, budget + 3)) + " " + " ".join(word() for _ in range(60))
        found = m.Matcher([(7, item)], 0.1).find(text)
        assert bool(found) == (min(distances(item, text)) <= budget)
        assert not found or found[0][1] == min(distances(item, text))


def test_leaks(spark):
    item = "Which of the seven rivers of the old kingdom did not reach the sea, and why was that so?"
    near = item.replace("seven", "sevn").replace("kingdom", "Kingdom —")
    rows = [(1, f"Before.\n{near}\nafter"), (2, "nothing here"), (3, None), (4, ""), (5, item[:30]), (6, f"{item} and {item}"), (7, "long " * 30_000 + item), (7, item)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, "the"), (5, "")], "item_id long, text string")
    every = {(r["doc_id"], r["item_id"]) for r in m.leaks(docs, items).collect()}
    assert {x for x in every if x[1] == 4} == {(d, 4) for d in (1, 5, 6, 7) if d != 2} and {x for x in every if x[1] != 4} == {(d, i) for d in (1, 6, 7) for i in (1, 2)}
    got = sorted(map(tuple, m.leaks(docs, items, min_chars=40).collect()))
    assert {(d, i) for d, i, *_ in got} == {(d, i) for d in (1, 6, 7) for i in (1, 2)}
    assert len([x for x in got if x[0] == 6]) == 4 and [x[2] for x in got if x[0] == 1] == [1, 1]
    texts = dict(rows[:6])
    d, _, _, s, e = next(x for x in got if x[0] == 6)
    assert texts[d][s:e] == item[:-1]
    assert sorted(map(tuple, m.leaks(docs, items, min_chars=40, block_chars=50).collect())) == got
    assert m.leaks(docs.limit(0), items).count() == 0 and m.leaks(docs, items.limit(0)).count() == 0


def test_short_items_are_searched(spark):
    docs = spark.createDataFrame([(1, "He asked: what is the capital of Peru? Then he left."), (2, "what is the capitol of Peru"), (3, "What's the capital")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "What is the capital of Peru?"), (2, "Peru"), (None, "?!")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in m.leaks(docs, items).collect()} == {(1, 1, 0), (2, 1, 1), (1, 2, 0), (2, 2, 0)}
