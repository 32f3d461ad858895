"""The pipeline end to end on a small corpus, and the package without its subpackage."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]
WORDS = {"en": "the and of with house water through", "de": "der und das mit straße wasser durch"}


def test_run(spark, tmp_path):
    rng = random.Random(4)
    word = lambda lang: rng.choice(WORDS[lang].split()) + "".join(rng.choice("abcdefg") for _ in range(3))
    line = lambda lang, n=9: " ".join(word(lang) for _ in range(n)) + "."
    item = line("en", 25)
    shared = "\n".join(line("en") for _ in range(4))
    texts = {n: "\n".join(line("en" if n % 2 else "de") for _ in range(12)) for n in range(30)}
    texts[30] = texts[4]  # an exact copy
    texts[31] = texts[6].replace(texts[6].split()[40], "other", 1).replace("\n", " ")  # a near copy on one line
    texts[32], texts[33] = line("en") + "\n" + shared + "\n" + line("en"), line("de") + "\n" + shared + "\n" + line("de")
    texts[34] = line("en") + " " + item + " " + line("en")
    texts[35], texts[36], texts[37] = "123 ...", None, ""
    rows = [(n, t, "en" if n % 2 else "de", "s", len(t or "")) for n, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(texts) - set(seen["language ID"]) == {35, 36, 37}
    assert set(seen["language ID"]) - set(seen["line dedup"]) == {30}
    assert shared in seen["line dedup"][32] and shared.split("\n")[1] not in seen["line dedup"][33]
    assert set(seen["line dedup"]) - set(seen["SimHash near-dedup"]) == {31}
    assert set(seen["SimHash near-dedup"]) - set(seen["benchmark decontamination"]) == {34}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["benchmark decontamination"])


def test_rows_without_or_with_one_id(spark, tmp_path):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS["en"].split()) + "".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(60)) + "."
    item = " ".join(line().split()[:25])
    texts = [line() for _ in range(4)]
    leak = line() + " " + item + " " + line()
    rows = [(None, t, "en", "s", len(t)) for t in [*texts, texts[0], leak]] + [(3, t, "en", "s", len(t)) for t in (texts[1], line())]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    alone = corpus_pipeline.near_deduplication(spark, docs, str(tmp_path))
    assert sorted(r["text"] for r in alone.collect()) == sorted([*texts, leak, rows[-1][1]])
    clean = corpus_pipeline.decontamination(spark, alone, str(tmp_path))
    assert sorted(r["text"] for r in clean.collect()) == sorted([*texts, rows[-1][1]]) and clean.columns == docs.columns


def test_line_dedup_cuts_texts_once(spark):
    """The stage filters on what the cut gives; a second cut in the filter takes a second worker for each task."""
    docs = spark.createDataFrame([(n, "a\nb\nc", "en", "s", 5) for n in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_deduplication(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_entry_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_the_rest_works_without_the_subpackage(tmp_path):
    import shutil

    for name in ("tallyweave", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyweave" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
