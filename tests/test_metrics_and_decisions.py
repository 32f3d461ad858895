import itertools

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import audit, decision, metrics

PAIRS = "query_id long, row_id long, p double"


def score(spark, queries, truth, pairs, threshold=0.5):
    q = spark.createDataFrame([(x,) for x in queries], "query_id long")
    t = spark.createDataFrame(truth, "query_id long, row_id long")
    return metrics.report(metrics.per_query(q, t, spark.createDataFrame(pairs, PAIRS), threshold)).first()


def test_macro_scores(spark):
    assert score(spark, [1, 2], [(1, 1), (2, 2)], [(1, 1, 0.9)])["macro_f05"] == 0.5
    assert score(spark, [1, 2], [], [])["macro_f05"] == 1.0
    got = score(spark, [1], [(1, 1)], [(1, 2, 0.9)])
    assert got["macro_f05"] == 0.0 and got["singleton_accuracy"] is None and got["candidate_recall"] == 0.0


def test_threshold_is_inclusive_as_float(spark):
    assert score(spark, [1], [(1, 1)], [(1, 1, 0.7)], 0.7)["true_positive_links"] == 1


def test_ties_of_the_sweeps(spark):
    q, t = spark.createDataFrame([(1,)], "query_id long"), spark.createDataFrame([(1, 1)], "query_id long, row_id long")
    p = spark.createDataFrame([(1, 1, 0.9, 0.9)], "query_id long, row_id long, p double, p2 double")
    assert metrics.calibrated(metrics.curve(q, t, p)).first()["threshold"] == 0.05
    best = metrics.swept(metrics.curve(q, t, p, tuple(metrics.SWEEP_GRID), metrics.WEIGHTS, "p", "p2")).first()
    assert (round(best["threshold"], 3), best["weight"]) == (0.9, 0.0)
    assert len(metrics.CALIBRATION_GRID) == 40 and len(metrics.SWEEP_GRID) == 38


def test_sampling_is_fixed(spark):
    rows = spark.createDataFrame([(f"S1-{n}",) for n in range(50)], "entity_id string")
    one, two = (sorted(map(tuple, metrics.sampled(r, 20, 7).collect())) for r in (rows, rows.repartition(9)))
    assert one == two and len(one) == 20 and sum(x[2] == "fit" for x in one) == 14 and sum(x[2] == "tune" for x in one) == 3


def test_truth_must_cover_all_queries(spark):
    q = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    schema = "source1_entity_id string, matched_entity_ids string"
    good = spark.createDataFrame([("a", "x,y"), ("b", "")], schema)
    assert {r["entity_id"]: r["truth"] for r in metrics.with_truth(q, good).collect()} == {"a": ["x", "y"], "b": []}
    with pytest.raises(ValueError):
        metrics.with_truth(q, good.limit(1))


@pytest.mark.parametrize("hidden", [0.0, 0.3])
def test_expected_score_against_all_outcomes(spark, hidden):
    ps, want = [0.8, 0.5, 0.15], [0.0] * 4
    for bits in itertools.product((0, 1), repeat=4):
        mass = 1.0
        for p, b in zip([*ps, hidden], bits):
            mass *= p if b else 1 - p
        for k in range(4):
            want[k] += mass * (1.25 * sum(bits[:k]) / (k + 0.25 * sum(bits)) if k or sum(bits) else 1.0)
    row = spark.range(1).select(decision.expected_f05(F.array(*map(F.lit, ps)), hidden).alias("e"), decision.best_prefix(F.array(F.lit(0.15), F.lit(0.8), F.lit(0.5)), hidden).alias("b")).first()
    assert row["e"] == pytest.approx(want) and row["b"]["selected"] == max(range(4), key=want.__getitem__)
    assert spark.range(1).select(decision.expected_f05(F.array().cast("array<double>"))).first()[0] == [1.0]


def test_tied_owners_abstain(spark):
    rows = lambda *ps: spark.createDataFrame([(n, 7, p) for n, p in enumerate(ps)], PAIRS)
    kept = lambda df: [r["query_id"] for r in df.collect()]
    assert kept(decision.exclusive(rows(0.9, 0.9))) == []
    assert kept(decision.exclusive(rows(0.95, 0.9), 0.01)) == [0]
    assert kept(decision.exclusive(rows(0.905, 0.9), 0.01)) == []
    assert sorted(r["p"] for r in decision.exclusive_scores(rows(0.95, 0.9, 0.2), 0.5).collect()) == [0.0, 0.0, 0.95]
    assert tuple(decision.conflicts(rows(0.95, 0.9, 0.2), 0.5).first()) == (2, 1, 1)
    assert decision.exclusivity_helps(0.5, 0.51) and not decision.exclusivity_helps(0.5, 0.5 + 1e-7)


def test_audit(spark):
    schema = "ordinal long, source1_entity_id string, {} string"
    expected = spark.createDataFrame([(0, "S1-1"), (1, "S1-2")], "ordinal long, entity_id string")
    targets = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")

    def run(matches, candidates):
        m = spark.createDataFrame(matches, schema.format("matched_entity_ids"))
        c = spark.createDataFrame(candidates, schema.format("candidate_entity_ids"))
        return audit.audit(audit.aligned(expected, m, c), targets)

    good = [(0, "S1-1", "S2-1"), (1, "S1-2", "")]
    assert run(good, good) == {"ok": True, "errors": [], "warnings": [], "counts": {"s1": 2, "matching": 2, "candidate": 2, "matched_ids": 1, "candidate_ids": 1}}
    assert "absent" in run(good, [(0, "S1-1", ""), (1, "S1-2", "")])["errors"][0]
    assert not run(good, good[:1])["ok"] and not run([good[1], good[0]][:1], good)["ok"]
    assert "unknown" in run(good, [(0, "S1-1", "S2-1,S2-9"), good[1]])["errors"][0]
    assert "invalid" in run(good, [(0, "S1-1", "S2-1,Q-9"), good[1]])["errors"][0]
    assert "invalid" in run(good, [(0, "S1-1", "S2-1,S2-" + "é" * 40), good[1]])["errors"][0]
    assert "duplicate" in run([(0, "S1-1", "S2-1,S2-1"), good[1]], good)["errors"][0]
    assert "order" in run([(0, "S1-2", "S2-1"), good[1]], good)["errors"][0]
