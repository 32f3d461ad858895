import itertools

from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import blocking

FIELDS = "row_id long, entity_id string, business_name string, business_address string, country string"


def prepared(spark, rows, **how):
    return T.prepared(spark.createDataFrame([(n, f"S1-{n}", *r) for n, r in enumerate(rows)], FIELDS), **how)


def test_any_script(spark):
    values = ["Café, दिल्ली", "Acme & Co_Ltd", None, "", "ﬁne ＡＢＣ", "Straße Łódź", "---"]
    rows = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    got = [r[0] for r in rows.orderBy("n").select(T.normalize_any(F.col("v"))).collect()]
    assert got == ["cafe दिल्ली", "acme and co ltd", "", "", "fine abc", "strasse łodz", ""]
    assert T.romanise("Straße Łódź") == "strasse lodz" and T.romanise("क") == "ka"


def test_latin_expression_agrees_with_the_function(spark):
    values = ["Café École SARL", "ÄÖÜß & Söhne", "23, Rue_du Centre", "ÇÈÊÍÑÓÚ", "  a  b ", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for r in rows.select(T.latin(F.col("v")).alias("a"), T.latin_any(F.col("v")).alias("b")).collect():
        assert r["a"] == r["b"]


def test_prepared_columns(spark):
    (r,) = prepared(spark, [("Café 42 The Ltd", "12b Main Rd Apt 7 75001", "France")]).collect()
    assert (r["core"], r["address"], r["initials"]) == ("cafe 42", "12b main road apartment 7 75001", "c4")
    assert r["house"] == "12" and r["postcodes"] == ["75001"] and r["name_numbers"] == ["42"]
    assert r["name_sorted"] == "42 cafe ltd the"


def test_keys(spark):
    (r,) = blocking.postings(prepared(spark, [("Acme Ltd", "12 Main Road", "France")])).groupBy("row_id").agg(F.collect_list("key").alias("k")).collect()
    assert r["k"] == ["france|n|acme", "france|ns|acme", "france|a|12 main road", "france|as|12 main road", "france|h|12 main", "france|t|acme", "france|w|main"]


def test_name_pairs_are_the_first_six_combinations(spark):
    (r,) = blocking.postings(prepared(spark, [("delta alpha gamma beta epsilon", "", "x")])).groupBy("row_id").agg(F.collect_list("key").alias("k")).collect()
    told = sorted(["delta", "alpha", "gamma", "beta", "epsilon"])
    assert [k[4:] for k in r["k"] if k.startswith("x|p|")] == [" ".join(c) for c in list(itertools.combinations(told, 2))[:6]]


def test_frequent_keys_are_dropped_whole(spark):
    same = prepared(spark, [("Acme Ltd", "1 Main St", "FR")] * 20)
    assert blocking.candidate_pairs(same.limit(1), same, cap=3).count() == 0
    assert blocking.candidate_pairs(same.limit(1), same, cap=20).count() == 20


def test_top_k_prefers_larger_rows_in_ties(spark):
    scored = spark.createDataFrame([(1, n, 0.5) for n in range(6)] + [(1, 9, 0.9)], "query_id long, row_id long, prelim double")
    assert [r["row_id"] for r in blocking.top_candidates(scored, 3).orderBy("rank").collect()] == [9, 5, 4]


def test_missing_address_does_not_suppress_a_name(spark):
    q, t = prepared(spark, [("Acme", "", "x")]), prepared(spark, [("Acme", "1 Main", "x")])
    (r,) = blocking.scored_pairs(spark.createDataFrame([(0, 0)], "query_id long, row_id long"), q, t).collect()
    assert abs(r["prelim"] - 0.75) < 1e-12
