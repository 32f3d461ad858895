"""The linkage jobs over TSV files: build, candidates, training with calibration, scoring, assembly, audit.

Each step stores its tables under `artifacts` with a manifest of its settings, is skipped when they are
whole, and refuses to go on under other settings.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prepared
from ..operators import audit, blocking, decision, metrics, model, pairs
from ..sources import records as R
from ..streaming import scoring

DEFAULTS = {"samples": 12_000, "seed": 20260925, "top_k": blocking.TOP_K, "max_postings": blocking.POSTING_CAP, "trees": 20, "country_transfer": False, "transliterate": True}


def _kept(spark: SparkSession, path: str, settings: dict, make) -> DataFrame:
    """The table at path, made if it is not whole."""
    R.Manifest(path).ensure(settings)
    table = f"{path}/table"
    if not Path(table, "_SUCCESS").exists():
        make().write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def targets(spark: SparkSession, data: str, artifacts: str, split: str, config: dict) -> DataFrame:
    """Prepared targets of a split, with their ordinals."""
    store = R.build(spark, [f"{data}/{split}/{split}_source{n}.tsv" for n in (2, 3)], f"{artifacts}/{split}/store")
    how = {"transliterate": config["transliterate"]}
    return _kept(spark, f"{artifacts}/{split}/prepared", how, lambda: prepared(store, **how))


def candidates(spark: SparkSession, data: str, artifacts: str, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sampled queries, their truth, and the labelled features of their top candidates."""
    settings = {k: config[k] for k in ("samples", "seed", "top_k", "max_postings", "transliterate")}
    known = targets(spark, data, artifacts, "train", config)

    def sample() -> DataFrame:
        drawn = metrics.sampled(R.read_source(spark, data, "train", 1), config["samples"], config["seed"])
        return prepared(metrics.with_truth(drawn.withColumn("row_id", F.col("position").cast("long")), R.read_truth(spark, data)), config["transliterate"])

    queries = _kept(spark, f"{artifacts}/experiment/queries", settings, sample)
    linked = queries.select(F.col("row_id").alias("query_id"), F.explode("truth").alias("entity_id"))
    # Truth that no target row carries still counts as missed: it keeps a row of its own.
    truth = linked.join(known.select("row_id", "entity_id"), "entity_id", "left").select("query_id", F.coalesce("row_id", -F.xxhash64("entity_id")).alias("row_id"))

    def featurised() -> DataFrame:
        found = blocking.scored_pairs(blocking.candidate_pairs(queries, known, config["max_postings"]), queries, known)
        top = blocking.top_candidates(found, config["top_k"])
        return pairs.features(top, queries, known).join(truth.withColumn("label", F.lit(1.0)), ["query_id", "row_id"], "left").fillna(0.0, ["label"])

    labelled = _kept(spark, f"{artifacts}/experiment/features", settings, featurised)
    ids = queries.select(F.col("row_id").alias("query_id"), "entity_id", "country", "split")
    return ids, truth, labelled.join(ids.select("query_id", "country", "split"), "query_id")


def _inside(rows: DataFrame, part: DataFrame) -> DataFrame:
    return rows.join(part.select("query_id"), "query_id", "left_semi")


def _measure(queries: DataFrame, truth: DataFrame, scored: DataFrame, threshold: float, by: list[str] | None = None) -> list[dict]:
    held = metrics.per_query(queries, _inside(truth, queries), _inside(scored, queries), threshold)
    return [r.asDict() for r in metrics.report(held, by).collect()]


def train(spark: SparkSession, data: str, artifacts: str, config: dict) -> dict:
    """Fit both models on the fit split, choose weight, threshold and exclusivity on the tuning split,
    and report on the holdout. Writes validation.json and calibration.json."""
    queries, truth, labelled = candidates(spark, data, artifacts, config)
    labelled, home = labelled.cache(), f"{artifacts}/experiment"
    R.Manifest(f"{home}/training").ensure({k: config[k] for k in ("trees", "seed")})
    fit = labelled.filter("split = 'fit'")
    fitted = {kind: model.fit(fit, kind, config["trees"], config["seed"]) for kind in ("first", "second")}
    for kind, held in fitted.items():
        model.save(held, f"{home}/{kind}")
    scored = model.score(fitted["second"], model.score(fitted["first"], labelled, "p1"), "p2").select("query_id", "row_id", "p1", "p2").cache()
    tune, hold = (queries.filter(F.col("split") == s) for s in ("tune", "holdout"))
    points = metrics.curve(tune, _inside(truth, tune), _inside(scored, tune), tuple(metrics.SWEEP_GRID), metrics.WEIGHTS, "p1", "p2").cache()
    best = metrics.swept(points).first()
    weight, threshold = best["weight"], best["threshold"]
    blended = scored.withColumn("p", model.blend(F.col("p1"), F.col("p2"), weight)).cache()
    ablation = {}
    for name, part in (("tune", tune), ("holdout", hold)):
        single = decision.exclusive_scores(_inside(blended, part), threshold)
        ablation[name] = {"independent": _measure(part, truth, blended, threshold)[0], "exclusive": _measure(part, truth, single, threshold)[0]}
    alone = decision.exclusivity_helps(ablation["tune"]["independent"]["macro_f05"], ablation["tune"]["exclusive"]["macro_f05"])
    report = {
        "threshold": threshold,
        "weight": weight,
        "seed": config["seed"],
        "threshold_curve": [r.asDict() for r in points.orderBy("weight", "threshold").collect()],
        "holdout": ablation["holdout"]["independent"],
        "holdout_by_country": {r.pop("country"): r for r in _measure(hold, truth, blended, threshold, ["country"])},
        "feature_importance": dict(model.importance(fitted["first"])),
        "graph_ablation": ablation,
        "exclusive_selected_on_tune": alone,
    }
    if config["country_transfer"]:
        report["country_transfer"] = model.country_transfer(labelled, queries, truth, threshold, config["trees"])
    R.write_json(report, f"{home}/validation.json")
    R.write_json({"threshold": threshold, "top_k": config["top_k"], "max_postings": config["max_postings"], "weight": weight, "exclusive": alone}, f"{home}/calibration.json")
    return report


def predict(spark: SparkSession, data: str, artifacts: str, config: dict, files_per_batch: int = 8) -> DataFrame:
    """Score all test queries in resumable micro-batches: query_id, row_id, rank, p."""
    home, out = f"{artifacts}/experiment", f"{artifacts}/predictions"
    calibration = json.loads(Path(f"{home}/calibration.json").read_text())
    known = targets(spark, data, artifacts, "test", config)
    source = f"{data}/test/test_source1.tsv"

    def numbered() -> DataFrame:
        rows = R.read_tsv(spark, source).withColumn("_line", F.monotonically_increasing_id())
        return prepared(R.with_rows(rows, ["_line"]).drop("_line"), config["transliterate"])

    queries = _kept(spark, f"{artifacts}/test/queries", {"source": R.digest(source), "transliterate": config["transliterate"]}, numbered)
    first = model.load(f"{home}/first")
    second = model.load(f"{home}/second") if calibration["weight"] else None

    def score(batch: DataFrame) -> DataFrame:
        found = blocking.scored_pairs(blocking.candidate_pairs(batch, known, calibration["max_postings"]), batch, known)
        top = blocking.top_candidates(found, calibration["top_k"])
        wide = model.score(first, pairs.features(top, batch, known, ("query_id", "row_id", "rank")), "p1")
        wide = model.score(second, wide, "p2") if second else wide.withColumn("p2", F.col("p1"))
        return wide.select("query_id", "row_id", "rank", model.blend(F.col("p1"), F.col("p2"), calibration["weight"]).alias("p"))

    scoring.score_stream(spark, f"{artifacts}/test/queries/table", queries.schema, out, score, {"calibration": calibration, "source": R.digest(source)}, files_per_batch)
    return scoring.scored(spark, out).drop("batch_id")


def assemble(spark: SparkSession, data: str, artifacts: str, output: str, config: dict, exclusive: bool | None = None) -> dict:
    """Write matching_results.tsv, candidate_pairs.tsv and prediction_summary.json."""
    calibration = json.loads(Path(f"{artifacts}/experiment/calibration.json").read_text())
    alone, threshold = calibration["exclusive"] if exclusive is None else exclusive, calibration["threshold"]
    if not Path(f"{artifacts}/predictions/_checkpoint/commits").exists():
        raise ValueError("the queries are not scored yet")
    scored = scoring.scored(spark, f"{artifacts}/predictions").drop("batch_id").cache()
    chosen = decision.exclusive_scores(scored, threshold) if alone else scored
    known = targets(spark, data, artifacts, "test", config).select("row_id", F.col("entity_id").alias("target_entity_id"))
    queries = spark.read.parquet(f"{artifacts}/test/queries/table").select(F.col("row_id").alias("query_id"), "entity_id", F.col("row_id").alias("ordinal"))
    ranked, keep = chosen.join(known, "row_id"), metrics.at_least(F.col("p"), threshold)
    Path(output).mkdir(parents=True, exist_ok=True)
    R.write_tsv(R.result_rows(queries, ranked, "matched_entity_ids", keep), f"{output}/matching_results.tsv")
    R.write_tsv(R.result_rows(queries, ranked, "candidate_entity_ids"), f"{output}/candidate_pairs.tsv")
    lost = decision.conflicts(scored, threshold).first()["conflicts"] if alone else 0
    summary = {"queries": queries.count(), "matched_links": ranked.filter(keep).count(), "exclusive": alone, "conflicts": lost}
    R.write_json(summary, f"{output}/prediction_summary.json")
    return summary


def audited(spark: SparkSession, data: str, output: str) -> dict:
    """The audit of the written files against the test sources."""
    source = R.with_rows(R.read_source(spark, data, "test", 1).withColumn("_line", F.monotonically_increasing_id()), ["_line"], "ordinal")
    rows = audit.aligned(source, R.read_results(spark, f"{output}/matching_results.tsv", "matched_entity_ids"), R.read_results(spark, f"{output}/candidate_pairs.tsv", "candidate_entity_ids"))
    report = audit.audit(rows, R.read_targets(spark, data, "test"))
    R.write_json(report, f"{output}/audit.json")
    return report


def reproduce(spark: SparkSession, data: str, artifacts: str, output: str, config: dict | None = None) -> dict:
    """All steps; the audit's report."""
    config = DEFAULTS | (config or {})
    train(spark, data, artifacts, config)
    predict(spark, data, artifacts, config)
    assemble(spark, data, artifacts, output, config)
    return audited(spark, data, output)
