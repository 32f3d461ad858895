"""From TSV files to audited outputs on a made-up set of businesses."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.text import prepared
from tallyweave.operators import audit, blocking, decision, metrics, model, pairs
from tallyweave.sources import records as R


def made(root, split, count):
    """References with two spelling variants each, but every tenth has none; and one stranger each."""
    folder = root / split
    folder.mkdir(parents=True)
    files, truth = {1: [], 2: [], 3: []}, []
    for n in range(count):
        mark = chr(97 + n // 26) + chr(97 + n % 26)
        country = "France" if split == "test" and n % 3 == 0 else "India" if n % 2 else "US"
        files[1].append((f"S1-{n}", f"Acme {mark} Workshop", f"{100 + n} Pine Road, District {mark}", country))
        matched = [f"S{s}-{n}" for s in (2, 3)] if n % 10 else []
        for target in matched:
            files[int(target[1])].append((target, f"Acme {mark} Workshop Limited", f"{100 + n} Pine Rd, District {mark}", country))
        files[2].append((f"S2-x{n}", f"Unrelated {mark} Retail", f"{900 + n} Cedar Street", country))
        truth.append((f"S1-{n}", ",".join(matched)))
    for s, rows in files.items():
        (folder / f"{split}_source{s}.tsv").write_text("\n".join("\t".join(r) for r in [R.FIELDS, *rows]) + "\n")
    (folder / f"{split}_ground_truth.tsv").write_text("\n".join("\t".join(r) for r in [("source1_entity_id", "matched_entity_ids"), *truth]) + "\n")


@pytest.fixture(scope="module")
def train(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    made(root, "train", 100)
    made(root, "test", 15)
    targets = prepared(R.build(spark, [f"{root}/train/train_source{n}.tsv" for n in (2, 3)], f"{root}/store")).cache()
    drawn = metrics.sampled(R.read_source(spark, str(root), "train", 1), 100, 17)
    queries = prepared(metrics.with_truth(drawn.withColumn("row_id", F.col("position").cast("long")), R.read_truth(spark, str(root)))).cache()
    truth = queries.select(F.col("row_id").alias("query_id"), F.explode("truth").alias("entity_id")).join(targets.select("row_id", "entity_id"), "entity_id").select("query_id", "row_id").cache()
    top = blocking.top_candidates(blocking.scored_pairs(blocking.candidate_pairs(queries, targets), queries, targets), 12)
    made_features = pairs.features(top, queries, targets, ("query_id", "row_id", "prelim"))
    side = queries.select(F.col("row_id").alias("query_id"), "split", "country")
    labelled = made_features.join(side, "query_id").join(truth.withColumn("label", F.lit(1.0)), ["query_id", "row_id"], "left").fillna(0.0, ["label"]).cache()
    return root, queries, targets, truth, labelled


def test_fit_calibrate_and_measure(spark, train, tmp_path):
    _, queries, _, truth, labelled = train
    fit = labelled.filter("split = 'fit'")
    with pytest.raises(RuntimeError):
        model.score(None, labelled)
    first, second = model.fit(fit, "first", 4), model.fit(fit, "second", 4)
    model.save(first, str(tmp_path / "first"))
    scored = model.score(second, model.score(model.load(str(tmp_path / "first")), labelled, "p"), "p2").cache()
    ids = queries.select(F.col("row_id").alias("query_id"), "split", "country")
    tune, hold = (ids.filter(F.col("split") == s) for s in ("tune", "holdout"))
    inside = lambda df, part: df.join(part.select("query_id"), "query_id", "left_semi")
    best = metrics.swept(metrics.curve(tune, inside(truth, tune), inside(scored, tune), tuple(metrics.SWEEP_GRID), metrics.WEIGHTS, "p", "p2")).first()
    blended = scored.withColumn("p", model.blend(F.col("p"), F.col("p2"), best["weight"]))
    got = metrics.report(metrics.per_query(hold, inside(truth, hold), inside(blended, hold), best["threshold"])).first()
    assert got["queries"] == 15 and got["candidate_recall"] == 1.0 and got["macro_f05"] > 0.9
    ranked = model.importance(first)
    assert len(ranked) == 47 and ranked[0][1] >= ranked[-1][1] and ranked[0][1] > 0
    transfer = model.country_transfer(labelled, ids, truth, 0.5, 2)
    assert set(transfer) <= {"US", "India"} and all(0 <= v["macro_f05"] <= 1 for v in transfer.values())


def test_outputs_pass_the_audit(spark, train, tmp_path):
    root = train[0]
    targets = prepared(R.build(spark, [f"{root}/test/test_source{n}.tsv" for n in (2, 3)], f"{tmp_path}/store"))
    source = R.read_source(spark, str(root), "test", 1).withColumn("_line", F.monotonically_increasing_id())
    queries = prepared(R.with_rows(source, ["_line"]).drop("_line"))
    top = blocking.top_candidates(blocking.scored_pairs(blocking.candidate_pairs(queries, targets), queries, targets), 12).withColumnRenamed("prelim", "p").cache()
    owned = decision.exclusive_scores(top, 0.6)
    ranked = owned.join(targets.select("row_id", F.col("entity_id").alias("target_entity_id")), "row_id")
    listed = queries.select(F.col("row_id").alias("query_id"), "entity_id", F.col("row_id").alias("ordinal"))
    for name, keep in (("matched_entity_ids", metrics.at_least(F.col("p"), 0.6)), ("candidate_entity_ids", None)):
        R.write_tsv(R.result_rows(listed, ranked, name, keep), f"{tmp_path}/{name}.tsv")
    rows = audit.aligned(listed, R.read_results(spark, f"{tmp_path}/matched_entity_ids.tsv", "matched_entity_ids"), R.read_results(spark, f"{tmp_path}/candidate_entity_ids.tsv", "candidate_entity_ids"))
    report = audit.audit(rows, targets)
    assert report["ok"], report
    assert report["counts"]["s1"] == 15 and report["counts"]["matched_ids"] == 26
