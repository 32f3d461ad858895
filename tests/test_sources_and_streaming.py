import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import archive
from tallyweave.sources import records as R
from tallyweave.streaming import scoring

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_strict_tsv(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("﻿" + HEADER + 'S1-1\t"He said ""hi"""\t"two\nlines"\tUS\nS1-2\tB\t\t\n', encoding="utf-8")
    got = [tuple(r) for r in R.read_tsv(spark, str(path)).orderBy("entity_id").collect()]
    assert got == [("S1-1", 'He said "hi"', "two\nlines", "US"), ("S1-2", "B", "", "")]
    for bad in ("id\tbusiness_name\tbusiness_address\tcountry\na\tb\tc\td\n", HEADER + "a\tb\n", HEADER + "a\tb\tc\td\te\n"):
        path.write_text(bad)
        with pytest.raises(Exception):
            R.read_tsv(spark, str(path)).collect()


def test_build_is_ordered_and_refuses_changed_inputs(spark, tmp_path):
    paths = []
    for n in (2, 3):
        paths.append(str(tmp_path / f"s{n}.tsv"))
        (tmp_path / f"s{n}.tsv").write_text(HEADER + "".join(f"S{n}-{k}\tN{k}\tA\tUS\n" for k in range(5)))
    table = R.build(spark, paths, str(tmp_path / "store"))
    assert [r["entity_id"] for r in table.orderBy("row_id").collect()] == [f"S{n}-{k}" for n in (2, 3) for k in range(5)]
    assert sorted(r["row_id"] for r in table.collect()) == list(range(10))
    assert R.point(table, 7)["entity_id"] == "S3-2"
    for row in (-1, 10):
        with pytest.raises(IndexError):
            R.point(table, row)
    assert R.build(spark, paths, str(tmp_path / "store")).count() == 10
    (tmp_path / "s3.tsv").write_text(HEADER)
    with pytest.raises(ValueError):
        R.build(spark, paths, str(tmp_path / "store"))


def test_results_round_trip(spark, tmp_path):
    queries = spark.createDataFrame([(1, "S1-b", 0), (2, "S1-a", 1)], "query_id long, entity_id string, ordinal long")
    ranked = spark.createDataFrame([(1, 2, "S2-x"), (1, 1, "S3-y")], "query_id long, rank int, target_entity_id string")
    rows = R.result_rows(queries, ranked, "matched_entity_ids")
    path = str(tmp_path / "matching_results.tsv")
    R.write_tsv(rows, path)
    assert open(path).read() == "source1_entity_id\tmatched_entity_ids\nS1-b\tS3-y,S2-x\nS1-a\t\n"
    back = [tuple(r) for r in R.read_results(spark, path, "matched_entity_ids").select("ordinal", "source1_entity_id", "matched_entity_ids").orderBy("ordinal").collect()]
    assert back == [(0, "S1-b", "S3-y,S2-x"), (1, "S1-a", "")]


def test_manifest_and_durable_copies(tmp_path):
    manifest = R.Manifest(str(tmp_path / "m"))
    assert manifest.ensure({"a": 1}) is False and manifest.ensure({"a": 1}) is True
    with pytest.raises(ValueError):
        manifest.ensure({"a": 2})
    local, far = tmp_path / "x" / "t", tmp_path / "far" / "t"
    local.mkdir(parents=True)
    (local / "part").write_text("1")
    R.persist(str(local), str(far))
    (local / "part").unlink()
    local.rmdir()
    assert not R.restore(str(local), str(far))  # not complete
    (far / "_SUCCESS").write_text("")
    assert R.restore(str(local), str(far)) and (local / "part").read_text() == "1"
    R.persist(str(local / "part"), str(tmp_path / "far" / "part"))
    (local / "part").unlink()
    assert R.restore(str(local / "part"), str(tmp_path / "far" / "part")) and not R.restore(str(tmp_path / "no"), str(tmp_path / "none"))


def test_stream_resumes(spark, tmp_path):
    frame = spark.range(30).withColumn("q", F.col("id") * 2)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda settings: scoring.score_stream(spark, str(tmp_path / "in"), frame.schema, str(tmp_path / "out"), lambda b: b.withColumn("p", F.lit(0.5)), settings)
    assert run({"t": 1}) == 3 and run({"t": 1}) == 0
    assert scoring.scored(spark, str(tmp_path / "out")).count() == 30
    with pytest.raises(ValueError):
        run({"t": 2})
    expected = spark.createDataFrame([(n,) for n in range(5)], "batch_id long")
    assert sorted(r[0] for r in scoring.missing_batches(expected, scoring.scored(spark, str(tmp_path / "out"))).collect()) == [3, 4]


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("data/a.txt", "1")
        z.writestr("data/.hidden", "2")
        z.writestr("other/b.txt", "3")
    assert [p.rsplit("/", 1)[1] for p in archive.extract(str(tmp_path / "in.zip"), str(tmp_path / "to"), "data/")] == ["a.txt"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("data/../../evil.txt", "1")
    with pytest.raises(ValueError):
        archive.extract(str(tmp_path / "bad.zip"), str(tmp_path / "to"), "data/")
    project, out = tmp_path / "p", tmp_path / "o"
    (project / "src" / "__pycache__").mkdir(parents=True)
    out.mkdir()
    for path in (project / "README.md", project / "requirements.txt", project / "src" / "a.py", project / "src" / ".env", project / "src" / "__pycache__" / "x.py", out / "matching_results.tsv", out / "candidate_pairs.tsv", tmp_path / "methods.md"):
        path.write_text("x")
    made = archive.package(str(tmp_path / "z" / "out.zip"), str(out), str(project), str(tmp_path / "methods.md"))
    assert sorted(zipfile.ZipFile(made).namelist()) == ["code/README.md", "code/requirements.txt", "code/src/a.py", "methods.md", "output/candidate_pairs.tsv", "output/matching_results.tsv"]
    (out / "matching_results.tsv").unlink()
    with pytest.raises(FileNotFoundError):
        archive.package(made, str(out), str(project), str(tmp_path / "methods.md"))


def test_reports(tmp_path):
    block = {"queries": 2, "macro_f05": 0.5, "micro_precision": 1.0, "micro_recall": 0.5, "candidate_recall": 1.0, "singleton_accuracy": None}
    report = {"holdout": block, "holdout_by_country": {"US": block}, "threshold": 0.7, "threshold_curve": [{"threshold": 0.7, "macro_f05": 0.5}], "feature_importance": {f"f{n}": n for n in range(20)}}
    data = json.loads(open(archive.write_figure_data(report, str(tmp_path / "figures"))).read())
    assert len(data["importance"]) == 15 and data["importance"][0]["feature"] == "f19" and len(data["groups"]) == 2
    audit = {"ok": True, "errors": [], "counts": {"candidate_ids": 3, "matched_ids": 1}}
    assert "macro_f05: 0.5" in archive.methods_text(audit, report, {"top_k": 32, "max_postings": 150, "threshold": 0.7})
    with pytest.raises(ValueError):
        archive.methods_text({**audit, "ok": False}, report, {})
