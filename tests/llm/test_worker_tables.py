"""What a Python worker holds from task to task."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import line_dedup, packing, shared, simhash

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_worker_holds_one_table():
    made = []
    make = lambda x: lambda: made.append(x) or [x]
    assert shared.held_by_worker("a", make(1)) is shared.held_by_worker("a", make(2))
    assert shared.held_by_worker("b", make(3)) == [3] and made == [1, 3]
    assert list(shared._HELD) == ["b"]
    shared.let_go()
    assert not shared._HELD


def test_stages_without_a_table_let_go_of_the_one_before(spark):
    class Docs:
        """Gives the function that the workers run."""

        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    for run in (simhash.fingerprints(Docs()), line_dedup.matches(Docs(), 2, 2)):
        shared.held_by_worker("table", object)
        assert shared._HELD and list(run(iter([]))) == [] and not shared._HELD


def test_marks_and_words_have_the_tokenizers_ids():
    table, plain = packing.ChunkIds(PATH, limit=50), Tokenizer.from_file(PATH)
    for text in [f"Word{chr(c)} {chr(c)} {chr(c)}word{chr(c)}{chr(c)} A{chr(c)}" for c in range(33, 127)] + ["Ⱥ éa. É, Word", ". a .a a. A1. 1"]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert list(memoryview(table.ids(text)).cast("I")) == ids


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"size": [sum(8 * len(x) for x in batch["held"])]})

    shared.small_batches(spark)
    rows = spark.range(0, 300, 1, 1).select(F.array_repeat(F.col("id"), 1 << 14).alias("held"))
    found = [r[0] for r in rows.mapInPandas(sizes, "size long").collect()]
    assert sum(found) == 300 * 8 << 14 and max(found) <= 9 << 20
