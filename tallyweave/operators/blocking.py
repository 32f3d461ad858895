"""Blocking: key explosion, posting counts, capped multi-key join, and top-k candidates per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio_col, token_set_col
from ..functions.text import ADDRESS_COMMON, salient, tokens
from .pairs import spread

#: A key with more target postings than this is dropped whole; so many candidates stay for a query.
POSTING_CAP, TOP_K = 150, 32


def key_column(records_core: Column, records_address: Column, nation: Column) -> Column:
    """The blocking keys `nation|kind|value` of a record, in order, without repeats."""
    name, place = tokens(records_core), tokens(records_address)
    told = F.slice(salient(records_core), 1, 5)
    numbers = F.slice(F.filter(place, lambda t: t.rlike("[0-9]")), 1, 2)
    words = F.filter(place, lambda t: (F.length(t) >= 3) & ~t.rlike("[0-9]") & ~t.isin(*ADDRESS_COMMON))
    by_name = F.array_sort(told)
    following = lambda x, i: F.filter(F.slice(by_name, i + F.lit(2), F.lit(5)), lambda y: y.isNotNull())
    pairs = F.flatten(F.transform(by_name, lambda x, i: F.transform(following(x, i), lambda y: F.concat_ws(" ", x, y))))
    kinds = {
        "n": F.array(records_core),
        "ns": F.array(F.array_join(F.array_sort(name), " ")),
        "a": F.array(records_address),
        "as": F.array(F.array_join(F.array_sort(place), " ")),
        "h": F.flatten(F.transform(numbers, lambda n: F.transform(F.slice(words, 1, 4), lambda w: F.concat_ws(" ", n, w)))),
        "t": told,
        "p": F.slice(pairs, 1, 6),
        "f": F.transform(F.filter(F.slice(told, 1, 3), lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 5)),
        "w": F.slice(words, 1, 2),
    }

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat_ws("|", nation, F.lit(kind), v))

    return F.array_distinct(F.concat(*[named(kind, values) for kind, values in kinds.items()]))


def postings(records: DataFrame, row: str = "row_id") -> DataFrame:
    """(key, row): one narrow stage over prepared records."""
    return records.select(row, F.explode(key_column(F.col("core"), F.col("address"), F.col("nation"))).alias("key"))


def eligible(target_postings: DataFrame, query_keys: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """(key, postings) of the keys that queries use and that have at most `cap` postings.

    The semi-join stands below the count: it keeps or drops whole groups, and only keys in use are
    counted. The count is a partial aggregate, so a frequent key is never gathered."""
    used = target_postings.join(query_keys.select("key").distinct(), "key", "left_semi")
    return used.groupBy("key").agg(F.count(F.lit(1)).alias("postings")).filter(F.col("postings") <= cap)


def candidate_pairs(queries: DataFrame, targets: DataFrame, cap: int = POSTING_CAP) -> DataFrame:
    """Distinct (query_id, row_id): query keys meet the eligible postings.

    Dropping frequent keys comes before the join, which bounds its fan-out by `cap` a key."""
    query_keys = postings(queries, "row_id").withColumnRenamed("row_id", "query_id")
    target_keys = postings(targets, "row_id")
    good = eligible(target_keys, query_keys, cap).select("key")
    return query_keys.join(target_keys.join(good, "key"), "key").select("query_id", "row_id").distinct()


def scored_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs with `prelim`; only the three strings that the score needs are joined on."""
    narrow = lambda df, p, key: df.select(F.col("row_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("core", "core_sorted", "address")])
    joined = spread(pairs.join(narrow(targets, "t", "row_id"), "row_id"), "query_id").join(narrow(queries, "q", "query_id"), "query_id")
    parts = joined.select(
        "query_id",
        "row_id",
        *[F.col(c) for c in ("q_core", "t_core", "q_address", "t_address")],
        ratio_col("q_core_sorted", "t_core_sorted").alias("n"),
        token_set_col("q_address", "t_address").alias("a"),
    )
    name = F.when((F.col("q_core") != "") & (F.col("t_core") != ""), F.col("n")).otherwise(0.0)
    both = (F.col("q_address") != "") & (F.col("t_address") != "")
    score = F.when(both, 0.55 * name + 0.35 * F.col("a") + 0.1 * F.least(name, F.col("a"))).otherwise(0.75 * name)
    return parts.select("query_id", "row_id", score.alias("prelim"))


def top_candidates(scored: DataFrame, k: int = TOP_K, score: str = "prelim") -> DataFrame:
    """The k best of each query with their rank; of equal scores the larger row first."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("row_id").desc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidate_counts(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Raw candidates of every query, zero included."""
    counted = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select(F.col("row_id").alias("query_id")).join(counted, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("raw_candidates"))
