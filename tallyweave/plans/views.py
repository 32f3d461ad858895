"""Entity records derived from the tables: documents as queries and targets, parts as string pairs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import overlap
from ..functions.text import latin, prepared
from ..operators import blocking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a record: words 1 to 5 are its name, 6 to 13 its address, its language the country."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", latin(F.col("text")).alias("norm"))
    words = F.split("norm", " ")
    role = F.pmod(F.col("doc_id"), F.lit(3))
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("S"), (role + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        role.cast("int").alias("role"),
        F.array_join(F.slice(words, 1, 5), " ").alias("business_name"),
        F.array_join(F.slice(words, 6, 8), " ").alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
        F.md5(F.col("norm").cast("binary")).alias("mark"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Prepared queries (role 0) and targets (roles 1 and 2).

    Records are prepared once: the narrow derived table is kept (memory, then disk) for all its uses in a
    query and for later queries over the same files; a lost block is computed again."""
    every = prepared(records(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)
    return every.filter("role = 0"), every.filter("role > 0")


def truth(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """True links: the same language and normalised text."""
    left = queries.select(F.col("row_id").alias("query_id"), "country", "mark")
    return left.join(targets.select("row_id", "country", "mark"), ["country", "mark"]).select("query_id", "row_id")


def overlap_pairs(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidate pairs with a score of token overlaps alone (p), and a second one (p2): no string kernels."""
    pairs = blocking.candidate_pairs(queries, targets)
    side = lambda df, p, key: df.select(F.col("row_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("core_set", "address_set")])
    joined = pairs.join(side(queries, "l", "query_id"), "query_id").join(side(targets, "r", "row_id"), "row_id")
    name, name_in = overlap(F.col("l_core_set"), F.col("r_core_set"))
    place, place_in = overlap(F.col("l_address_set"), F.col("r_address_set"))
    return joined.select("query_id", "row_id", F.round(0.6 * name + 0.4 * place, 6).alias("p"), F.round(0.5 * name_in + 0.5 * place_in, 6).alias("p2"))


def string_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name and type in lower case."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
