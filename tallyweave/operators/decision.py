"""Decision rules: expected utility of a prefix, and one owner for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_distribution(probabilities: Column) -> Column:
    """Distribution of the number of hits among independent events, as an array from zero on."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(
        probabilities,
        F.array(F.lit(1.0)),
        lambda d, p: F.zip_with(F.concat(d, zero), F.concat(zero, d), lambda miss, hit: miss * (1 - p) + hit * p),
    )


def expected_f05(probabilities: Column, hidden: float = 0.0) -> Column:
    """Expected F0.5 of each prefix of a descending probability list, the empty one first.

    hidden: probability of one more true match that is not in the list."""
    ps = F.transform(probabilities, lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    more = min(1.0, max(0.0, hidden))

    def gain(m: Column, i: Column) -> Column:
        others = F.concat(F.slice(ps, F.lit(1), i - 1), F.slice(ps, i + 1, F.size(ps)))
        weighted = F.transform(
            count_distribution(others),
            lambda q, k: q * ((1 - more) / (m + 0.25 * (k + 1)) + more / (m + 0.25 * (k + 2))),
        )
        return F.element_at(ps, i) * F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)

    none = F.aggregate(ps, F.lit(1.0), lambda a, p: a * (1 - p)) * (1 - hidden)
    some = F.when(F.size(ps) == 0, F.array().cast("array<double>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1))),
            lambda m: 1.25 * F.aggregate(F.transform(F.sequence(F.lit(1), m), lambda i: gain(m, i)), F.lit(0.0), lambda a, x: a + x),
        )
    )
    return F.concat(F.array(none), some)


def best_prefix(probabilities: Column, hidden: float = 0.0) -> Column:
    """struct<selected, expected>: the shortest of the prefixes with the best expected score."""
    ordered = F.transform(F.array_sort(F.transform(probabilities, lambda p: -p)), lambda p: -p)
    return F.transform(
        F.array(expected_f05(ordered, hidden)),
        lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("selected"), F.array_max(s).alias("expected")),
    )[0]


def exclusive(pairs: DataFrame, margin: float = 0.0, score: str = "p") -> DataFrame:
    """pairs that own their target: the best score, ahead of the second by more than the margin.

    A tie leaves the target to nobody. Two partial aggregates find the best and how often it occurs,
    and the runner-up; a target with many pairs is never gathered in one task."""
    best = pairs.groupBy("row_id").agg(F.max(score).alias("best"))
    marked = pairs.join(best, "row_id")
    rivals = marked.groupBy("row_id").agg(F.count_if(F.col(score) == F.col("best")).alias("tops"), F.max(F.when(F.col(score) < F.col("best"), F.col(score))).alias("second"))
    owned = marked.filter(F.col(score) == F.col("best")).join(rivals, "row_id")
    alone = (F.col("tops") == 1) & (F.col("second").isNull() | (F.col(score) - F.col("second") > margin))
    # With a negative margin ties would be won too; a margin is never negative here.
    return owned.filter(alone).select(*pairs.columns)


def exclusive_scores(pairs: DataFrame, threshold: float, score: str = "p") -> DataFrame:
    """All pairs; the score stays for owners among those at or above the threshold and is 0 for the others."""
    from .metrics import at_least

    kept = exclusive(pairs.filter(at_least(F.col(score), threshold)), 0.0, score).select("query_id", "row_id", F.col(score).alias("kept"))
    return pairs.join(kept, ["query_id", "row_id"], "left").withColumn(score, F.coalesce("kept", F.lit(0.0))).drop("kept")


def conflicts(pairs: DataFrame, threshold: float, score: str = "p") -> DataFrame:
    """One row: pairs at or above the threshold, their targets, and the pairs beyond one a target."""
    from .metrics import at_least

    per_target = pairs.filter(at_least(F.col(score), threshold)).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    return per_target.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("eligible"), F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("conflicts")
    )


def exclusivity_helps(independent: float, constrained: float) -> bool:
    """Chosen only if the tuning score grows by more than rounding."""
    return constrained > independent + 1e-6
