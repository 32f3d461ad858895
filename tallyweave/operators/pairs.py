"""The 47 features of a candidate pair. Identifiers are never among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy_tokens_col, jaro_winkler_col, overlap, partial_col, ratio_col, token_set_col

MEASURES = ("ratio", "token_sort", "token_set", "partial", "jaro", "length_ratio", "equal")
FIELDS = ("name", "core", "address")
FEATURES = tuple(f"{f}_{m}" for f in FIELDS for m in MEASURES) + (
    "unicode_name_ratio", "name_token_jaccard", "name_token_containment", "address_token_jaccard", "address_token_containment",
    "address_digit_jaccard", "address_digit_overlap", "address_digit_conflict", "house_equal", "house_conflict", "postcode_equal",
    "postcode_conflict", "name_digit_jaccard", "left_name_tokens", "right_name_tokens", "left_address_tokens", "right_address_tokens",
    "left_name_missing", "right_name_missing", "left_address_missing", "right_address_missing", "country_equal", "name_address_min",
    "name_address_product", "initials_equal", "name_fuzzy_tokens",
)

CARRIED = (
    "business_name business_address country name unicode_name core address name_sorted core_sorted address_sorted core_set address_set "
    "name_numbers address_numbers house postcodes initials"
).split()


def joined(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs(query_id, row_id, ...) with both prepared records, as columns l_* and r_*."""
    side = lambda df, p, key: df.select(F.col("row_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in CARRIED])
    return spread(pairs.join(side(targets, "r", "row_id"), "row_id"), "query_id").join(side(queries, "l", "query_id"), "query_id")


def spread(pairs: DataFrame, key: str) -> DataFrame:
    """pairs dealt by the key of the join that follows into all shuffle partitions: string kernels cost far more
    than the bytes that adaptive coalescing goes by."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def plain_features() -> dict[str, Column]:
    """The features that need no string kernel: pure expressions over l_* and r_*."""
    both = lambda c: (F.col(f"l_{c}"), F.col(f"r_{c}"))
    some = lambda c: (F.size(f"l_{c}") > 0) & (F.size(f"r_{c}") > 0)
    out: dict[str, Column] = {}
    for f in FIELDS:
        a, b = both(f)
        blank = (a == "") | (b == "")
        out[f"{f}_length_ratio"] = F.when(blank, 0.0).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))
        out[f"{f}_equal"] = F.when(blank, 0.0).otherwise(_flag(a == b))
    out["name_token_jaccard"], out["name_token_containment"] = overlap(*both("core_set"))
    out["address_token_jaccard"], out["address_token_containment"] = overlap(*both("address_set"))
    out["address_digit_jaccard"], out["address_digit_overlap"] = overlap(*both("address_numbers"))
    out["address_digit_conflict"] = _flag(some("address_numbers") & ~F.arrays_overlap(*both("address_numbers")))
    houses = (F.col("l_house") != "") & (F.col("r_house") != "")
    out["house_equal"] = _flag(houses & (F.col("l_house") == F.col("r_house")))
    out["house_conflict"] = _flag(houses & (F.col("l_house") != F.col("r_house")))
    out["postcode_equal"] = _flag(some("postcodes") & F.arrays_overlap(*both("postcodes")))
    out["postcode_conflict"] = _flag(some("postcodes") & ~F.arrays_overlap(*both("postcodes")))
    out["name_digit_jaccard"] = overlap(*both("name_numbers"))[0]
    for side, p in (("left", "l"), ("right", "r")):
        out[f"{side}_name_tokens"] = F.size(f"{p}_core_set").cast("double")
        out[f"{side}_address_tokens"] = F.size(f"{p}_address_set").cast("double")
        out[f"{side}_name_missing"] = _flag(F.col(f"{p}_business_name") == "")
        out[f"{side}_address_missing"] = _flag(F.col(f"{p}_business_address") == "")
    out["country_equal"] = _flag(F.col("l_country") == F.col("r_country"))
    out["initials_equal"] = _flag((F.col("l_initials") != "") & (F.col("l_initials") == F.col("r_initials")))
    return out


def kernel_features() -> dict[str, Column]:
    """The features by Arrow kernels; two empty or one empty field is no likeness at all."""
    out: dict[str, Column] = {}
    for f in FIELDS:
        a, b = F.col(f"l_{f}"), F.col(f"r_{f}")
        sorted_pair = (F.col(f"l_{f}_sorted"), F.col(f"r_{f}_sorted"))
        for measure, value in (("ratio", ratio_col(a, b)), ("token_sort", ratio_col(*sorted_pair)), ("token_set", token_set_col(a, b)), ("partial", partial_col(a, b)), ("jaro", jaro_winkler_col(a, b))):
            out[f"{f}_{measure}"] = F.when((a == "") | (b == ""), 0.0).otherwise(value)
    a, b = F.col("l_unicode_name"), F.col("r_unicode_name")
    out["unicode_name_ratio"] = F.when((a == "") | (b == ""), 0.0).otherwise(ratio_col(a, b))
    out["name_fuzzy_tokens"] = fuzzy_tokens_col(F.col("l_core_set"), F.col("r_core_set"))
    return out


def features(pairs: DataFrame, queries: DataFrame, targets: DataFrame, keep: tuple[str, ...] = ("query_id", "row_id")) -> DataFrame:
    """keep and the 47 features, in order, as floats."""
    wide = joined(pairs, queries, targets)
    made = wide.select(*keep, *[v.alias(k) for k, v in (plain_features() | kernel_features()).items()])
    made = made.withColumns(
        {"name_address_min": F.least("core_token_sort", "address_token_set"), "name_address_product": F.col("core_token_sort") * F.col("address_token_set")}
    )
    return made.select(*keep, *[F.col(c).cast("float").alias(c) for c in FEATURES])
