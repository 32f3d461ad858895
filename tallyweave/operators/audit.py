"""Checks of the output tables as DataFrame constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ERRORS, MAX_ID_BYTES, PREFIXES = 100, 64, ("S2-", "S3-")


def id_list(column: str | Column) -> Column:
    """A comma-joined list as an array; the empty string is the empty list."""
    column = F.col(column) if isinstance(column, str) else column
    return F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")


def aligned(expected: DataFrame, matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """The three files row by row: each has `ordinal`; expected has entity_id, the others
    source1_entity_id and their list. A row that one lacks has nulls there."""
    e = expected.select("ordinal", F.col("entity_id").alias("expected_id"), F.lit(True).alias("has_expected"))
    m = matching.select("ordinal", F.col("source1_entity_id").alias("match_id"), id_list("matched_entity_ids").alias("matched"), F.lit(True).alias("has_match"))
    c = candidates.select("ordinal", F.col("source1_entity_id").alias("candidate_id"), id_list("candidate_entity_ids").alias("candidates"), F.lit(True).alias("has_candidate"))
    return e.join(m, "ordinal", "full_outer").join(c, "ordinal", "full_outer")


def _complete() -> Column:
    return F.col("has_expected").isNotNull() & F.col("has_match").isNotNull() & F.col("has_candidate").isNotNull()


def violations(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(ordinal, rule, detail) for every violation; targets has entity_id.

    The rules inside a row are one pass; unknown target ids are an anti-join."""
    bad_id = lambda x: ~F.substring(x, 1, 3).isin(*PREFIXES) | (F.octet_length(x) > MAX_ID_BYTES)
    listed = F.array_union("candidates", "matched")
    rules = {
        "row count mismatch": ~_complete(),
        "source coverage or order": _complete() & ((F.col("expected_id") != F.col("match_id")) | (F.col("expected_id") != F.col("candidate_id"))),
        "duplicate ids": _complete() & ((F.size("matched") != F.size(F.array_distinct("matched"))) | (F.size("candidates") != F.size(F.array_distinct("candidates")))),
        "match absent from candidates": _complete() & (F.size(F.array_except("matched", "candidates")) > 0),
        "invalid target id": _complete() & F.exists(listed, bad_id),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    inside = rows.select("ordinal", F.explode(found).alias("rule"), F.coalesce("expected_id", "match_id", "candidate_id").alias("detail"))
    ids = rows.filter(_complete()).select("ordinal", F.explode(listed).alias("detail")).filter(~bad_id(F.col("detail")))
    known = targets.select(F.col("entity_id").alias("detail"))
    unknown = ids.join(known, "detail", "left_anti").select("ordinal", F.lit("unknown target id").alias("rule"), "detail")
    return inside.unionByName(unknown)


def summary(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: ok, n_violations, and the counts of rows and ids."""
    wrong = violations(rows, targets).agg(F.count(F.lit(1)).alias("n_violations"))
    full = _complete()
    counts = rows.agg(
        F.count_if(full).alias("s1"),
        F.count_if(full).alias("matching"),
        F.count_if(full).alias("candidate"),
        F.coalesce(F.sum(F.when(full, F.size("matched"))), F.lit(0)).cast("bigint").alias("matched_ids"),
        F.coalesce(F.sum(F.when(full, F.size("candidates"))), F.lit(0)).cast("bigint").alias("candidate_ids"),
    )
    return counts.crossJoin(F.broadcast(wrong)).withColumn("ok", F.col("n_violations") == 0)  # one row each


def audit(rows: DataFrame, targets: DataFrame) -> dict:
    """The report as a dict, with at most 100 errors."""
    first = violations(rows, targets).orderBy("ordinal", "rule", "detail").limit(MAX_ERRORS).collect()
    out = summary(rows, targets).first().asDict()
    ok, _ = out.pop("ok"), out.pop("n_violations")
    return {"ok": ok, "errors": [f"{r['rule']} at row {r['ordinal']}: {r['detail']}" for r in first], "warnings": [], "counts": out}
