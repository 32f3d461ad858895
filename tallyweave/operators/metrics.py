"""Set metrics of linkage, calibration sweeps, sampling and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_least(probability: Column, threshold) -> Column:
    """Inclusive, compared as floats: a stored float 0.7 reaches the threshold 0.7."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return probability.cast("float") >= limit.cast("float")


def f05(hits: Column, truths: Column, predicted: Column) -> Column:
    """F0.5 of one query; nothing true and nothing predicted is a full score."""
    bottom = 0.25 * truths + predicted
    return F.when(bottom > 0, 1.25 * hits / bottom).otherwise(1.0)


def per_query(queries: DataFrame, truth: DataFrame, pairs: DataFrame, threshold: float, score: str = "p") -> DataFrame:
    """For each query: n_true (all truth, retrieved or not), n_predicted, n_hits, n_found, f05.

    queries(query_id, ...), truth(query_id, row_id), pairs(query_id, row_id, score)."""
    marked = pairs.join(truth.select("query_id", "row_id", F.lit(True).alias("match")), ["query_id", "row_id"], "left")
    chosen, match = at_least(F.col(score), threshold), F.coalesce("match", F.lit(False))
    counts = marked.groupBy("query_id").agg(F.count_if(chosen).alias("n_predicted"), F.count_if(chosen & match).alias("n_hits"), F.count_if(match).alias("n_found"))
    true = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_true"))
    out = queries.join(true, "query_id", "left").join(counts, "query_id", "left").fillna(0, ["n_true", "n_predicted", "n_hits", "n_found"])
    return out.withColumn("f05", f05(F.col("n_hits"), F.col("n_true"), F.col("n_predicted")))


def report(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The ten figures over per-query rows, in one aggregate, whole or for each group."""
    total = lambda c: F.sum(c).cast("bigint")
    single = F.col("n_true") == 0
    out = scored.groupBy(*(by or [])).agg(
        F.avg("f05").alias("macro_f05"),
        F.coalesce(F.try_divide(total("n_hits"), total("n_predicted")), F.lit(0.0)).alias("micro_precision"),
        F.coalesce(F.try_divide(total("n_hits"), total("n_true")), F.lit(0.0)).alias("micro_recall"),
        F.coalesce(F.try_divide(total("n_found"), total("n_true")), F.lit(1.0)).alias("candidate_recall"),
        F.avg(F.when(single, (F.col("n_predicted") == 0).cast("double"))).alias("singleton_accuracy"),
        F.count(F.lit(1)).alias("queries"),
        total("n_true").alias("true_links"),
        total("n_predicted").alias("predicted_links"),
        total("n_hits").alias("true_positive_links"),
        F.count_if(single).alias("singleton_queries"),
    )
    return out


def grid(low: float, steps: int, step: float, extra: tuple[float, ...] = (0.975, 0.99, 0.995)) -> list[float]:
    return [round(low + n * step, 6) for n in range(steps)] + list(extra)


#: Threshold grids of a plain calibration and of the training sweep, and the blend weights of the latter.
CALIBRATION_GRID, SWEEP_GRID, WEIGHTS = grid(0.05, 37, 0.025), grid(0.1, 35, 0.025), (0.0, 0.25, 0.5, 0.75, 1.0)


def curve(queries: DataFrame, truth: DataFrame, pairs: DataFrame, thresholds=tuple(CALIBRATION_GRID), weights=(0.0,), first: str = "p", second: str | None = None) -> DataFrame:
    """weight, threshold and macro_f05 over a grid.

    The grid is a literal array on the pairs, so the blow-up is a bounded factor and needs no join; a
    query without a pair above a threshold is scored from its truth alone."""
    marked = pairs.join(truth.select("query_id", "row_id", F.lit(True).alias("match")), ["query_id", "row_id"], "left")
    points = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(float(t)).alias("threshold")) for w in weights for t in thresholds])
    blend = F.col(first) if second is None else (1 - F.col("g.weight")) * F.col(first) + F.col("g.weight") * F.col(second)
    over = marked.withColumn("g", F.explode(points)).filter(at_least(blend, F.col("g.threshold")))
    counts = over.groupBy("query_id", F.col("g.weight").alias("weight"), F.col("g.threshold").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count_if(F.coalesce("match", F.lit(False))).alias("n_hits")
    )
    true = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = queries.select("query_id").join(true, "query_id", "left").fillna(0, ["n_true"])
    every = base.withColumn("g", F.explode(points)).select("query_id", "n_true", "g.weight", "g.threshold")
    full = every.join(counts, ["query_id", "weight", "threshold"], "left").fillna(0, ["n_predicted", "n_hits"])
    return full.groupBy("weight", "threshold").agg(F.avg(f05(F.col("n_hits"), F.col("n_true"), F.col("n_predicted"))).alias("macro_f05"))


def calibrated(points: DataFrame) -> DataFrame:
    """The best threshold; of equal ones the lowest."""
    return points.orderBy(F.round("macro_f05", 12).desc(), "threshold").limit(1)


def swept(points: DataFrame) -> DataFrame:
    """The best threshold and weight of the sweep; of equal ones the highest threshold, then the lowest weight."""
    return points.orderBy(F.round("macro_f05", 12).desc(), F.col("threshold").desc(), "weight").limit(1)


def sampled(queries: DataFrame, size: int, seed: int, key: str = "entity_id") -> DataFrame:
    """A sample of fixed size, the same whatever the partitioning, with its position and split.

    The order is a hash of seed and key; the split is 70 / 15 / 15 per cent of the positions."""
    drawn = queries.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))).orderBy("draw", key).limit(size)
    n = drawn.count()  # at most `size`
    place = F.row_number().over(Window.orderBy("draw", key)) - 1  # over the sample alone
    split = F.when(F.col("position") < n * 7 // 10, "fit").when(F.col("position") < n * 85 // 100, "tune").otherwise("holdout")
    return drawn.withColumn("position", place).withColumn("split", split).drop("draw")


def with_truth(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """queries(entity_id) with their truth list; a query without a truth row is an error."""
    out = queries.join(truth.withColumnRenamed("source1_entity_id", "entity_id"), "entity_id", "left")
    if out.filter(F.col("matched_entity_ids").isNull()).limit(1).count():
        raise ValueError("some queries have no ground truth row")
    return out.withColumn("truth", F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).drop("matched_entity_ids")


def source_profile(records: DataFrame, columns: tuple[str, ...] = ("business_name", "business_address", "country")) -> DataFrame:
    """Rows, distinct ids and missing values, whole (country null) and for each country, in one pass."""
    missing = [F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"missing_{c}") for c in columns]
    out = records.withColumn("group", F.coalesce("country", F.lit(""))).rollup("group")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("unique_ids"), *missing).withColumnRenamed("group", "country_group")


def truth_cardinality(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """How many queries have so many matches, zero included."""
    true = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"))
    return queries.select("query_id").join(true, "query_id", "left").fillna(0, ["matches"]).groupBy("matches").agg(F.count(F.lit(1)).alias("n_queries"))


def noise_profile(truth: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs by what is exactly equal: name and address, one of them, neither."""
    side = lambda df, p, key: df.select(F.col("row_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("business_name", "business_address")])
    both = truth.join(side(queries, "l", "query_id"), "query_id").join(side(targets, "r", "row_id"), "row_id")
    name, place = F.col("l_business_name") == F.col("r_business_name"), F.col("l_business_address") == F.col("r_business_address")
    blank = (F.col("l_business_address") == "") | (F.col("r_business_address") == "")
    return both.agg(
        F.count(F.lit(1)).alias("positive_pairs"),
        F.count_if(name & place).alias("exact_both"),
        F.count_if(name & ~place).alias("name_only"),
        F.count_if(~name & place).alias("address_only"),
        F.count_if(~name & ~place).alias("neither"),
        F.count_if(blank).alias("missing_address"),
    )
