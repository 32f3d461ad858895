"""Sources and sinks: strict TSV records, the record table, result files, reports and manifests."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FIELDS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = StructType([StructField(f, StringType()) for f in FIELDS])
TRUTH = StructType([StructField(f, StringType()) for f in ("source1_entity_id", "matched_entity_ids")])
TEXT = FIELDS[1:]


def read_tsv(spark: SparkSession, paths, schema: StructType = SCHEMA) -> DataFrame:
    """Tab-separated UTF-8 with exactly the schema's header; short and long rows fail the read.

    Quoted fields may span lines, which makes a file unsplittable: read it once, into `write_table`."""
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True, "enforceSchema": False, "mode": "FAILFAST"}
    frame = spark.read.schema(schema).options(**options).csv(paths if isinstance(paths, list) else [paths])
    return frame.fillna("", [f.name for f in schema if f.name not in ("entity_id", "source1_entity_id")])


def read_source(spark: SparkSession, root: str, split: str, source: int) -> DataFrame:
    return read_tsv(spark, f"{root}/{split}/{split}_source{source}.tsv")


def read_targets(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Sources 2 and 3 together, with the source's number."""
    two, three = (read_source(spark, root, split, n).withColumn("source", F.lit(n)) for n in (2, 3))
    return two.unionByName(three)


def read_truth(spark: SparkSession, root: str) -> DataFrame:
    return read_tsv(spark, f"{root}/train/train_ground_truth.tsv", TRUTH)


def durable(frame: DataFrame) -> DataFrame:
    """frame computed once, its rows in the shared checkpoint folder; a temporary one only where none is named."""
    context = frame.sparkSession.sparkContext
    if not frame.sparkSession.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyweave-checkpoints-"))
    return frame.checkpoint(eager=True)


def with_rows(frame: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Dense ordinals from 0 by `order`, without gathering all rows in one task.

    Rows are range-partitioned and numbered inside their partition; the partitions' sizes, one row
    each, give the offsets."""
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = dealt.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = durable(local)  # both uses below must see the same partitions
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return local.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before", "_n")


def write_table(frame: DataFrame, path: str) -> DataFrame:
    """Parquet; Spark's commit protocol leaves `_SUCCESS` only when it is whole."""
    frame.write.mode("errorifexists").parquet(path)
    return frame.sparkSession.read.parquet(path)


def point(records: DataFrame, row: int) -> dict:
    """The record with that ordinal; IndexError if there is none."""
    got = records.filter(F.col("row_id") == row).limit(1).collect() if row >= 0 else []
    if not got:
        raise IndexError(row)
    return got[0].asDict()


def result_rows(queries: DataFrame, ranked: DataFrame, list_name: str, keep=None) -> DataFrame:
    """ordinal, source1_entity_id and the comma-joined target ids in rank order; every query has a row.

    queries(query_id, entity_id, ordinal); ranked(query_id, rank, target_entity_id): at most k a query."""
    return result_lists(queries, ranked, {list_name: F.lit(True) if keep is None else keep})


def result_lists(queries: DataFrame, ranked: DataFrame, lists: dict) -> DataFrame:
    """As result_rows with several lists, by name the condition of each, in one aggregate."""
    entry = F.struct("rank", "target_entity_id")
    held = ranked.groupBy("query_id").agg(*[F.array_sort(F.collect_list(F.when(keep, entry))).alias(name) for name, keep in lists.items()])
    joined = lambda name: F.coalesce(F.array_join(F.transform(name, lambda x: x["target_entity_id"]), ","), F.lit("")).alias(name)
    return queries.join(held, "query_id", "left").select("ordinal", F.col("entity_id").alias("source1_entity_id"), *[joined(name) for name in lists])


def write_tsv(rows: DataFrame, path: str) -> None:
    """One ordered TSV file with a header and LF, put in place by a rename."""
    ordered = rows.orderBy("ordinal").drop("ordinal")
    temporary = f"{path}.parts"
    ordered.coalesce(1).write.mode("overwrite").options(sep="\t", header=True, emptyValue="", lineSep="\n").csv(temporary)
    (part,) = Path(temporary).glob("part-*.csv")
    os.replace(part, path)
    shutil.rmtree(temporary)


def write_json(value, path: str) -> None:
    temporary = Path(f"{path}.tmp")
    temporary.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    os.replace(temporary, path)


def digest(path: str, block: int = 4 << 20) -> str:
    """SHA-256 of a file, read in blocks."""
    found = hashlib.sha256()
    with open(path, "rb") as handle:
        while part := handle.read(block):
            found.update(part)
    return found.hexdigest()


def signatures(paths: list[str]) -> list[dict]:
    return [{"name": Path(p).name, "bytes": os.path.getsize(p), "sha256": digest(p)} for p in paths]


VERSION = 1


class Manifest:
    """What a stored table was made from; a table is used again only under the same manifest."""

    def __init__(self, folder: str):
        self.path = Path(folder) / "_manifest.json"

    def ensure(self, settings: dict) -> bool:
        """True if the same settings are there already; other settings, or another version, are an error."""
        wanted = {"version": VERSION, "settings": settings}
        if self.path.exists():
            if json.loads(self.path.read_text()) != json.loads(json.dumps(wanted)):
                raise ValueError(f"settings differ from those in {self.path}; use another folder")
            return True
        self.path.parent.mkdir(parents=True, exist_ok=True)
        write_json(wanted, str(self.path))
        return False


def build(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """The record table of TSV files, in file order; built once, refused if the inputs changed."""
    table = Path(folder) / "records"
    known = Manifest(folder).ensure({"inputs": signatures(paths)})
    if known and (table / "_SUCCESS").exists():
        return spark.read.parquet(str(table))
    shutil.rmtree(table, ignore_errors=True)
    parts = None
    for n, path in enumerate(paths):
        part = read_tsv(spark, path).withColumn("_file", F.lit(n)).withColumn("_line", F.monotonically_increasing_id())
        parts = part if parts is None else parts.unionByName(part)
    return write_table(with_rows(parts, ["_file", "_line"]).drop("_file", "_line"), str(table))


def restore(local: str, durable: str) -> bool:
    """Bring a file or a complete folder back from durable storage if it is missing here."""
    if os.path.exists(local):
        return True
    if os.path.isdir(durable):
        if not os.path.exists(f"{durable}/_SUCCESS"):
            return False
        shutil.copytree(durable, f"{local}.part")
    elif os.path.isfile(durable):
        os.makedirs(os.path.dirname(local) or ".", exist_ok=True)
        shutil.copyfile(durable, f"{local}.part")
    else:
        return False
    os.replace(f"{local}.part", local)
    return True


def persist(local: str, durable: str) -> None:
    """Copy a file or folder to durable storage; its last step is a rename."""
    os.makedirs(os.path.dirname(durable) or ".", exist_ok=True)
    temporary = f"{durable}.part"
    if os.path.isdir(local):
        shutil.rmtree(temporary, ignore_errors=True)
        shutil.copytree(local, temporary)
        shutil.rmtree(durable, ignore_errors=True)
    else:
        shutil.copyfile(local, temporary)
    os.replace(temporary, durable)


def header_of(path: str) -> list[str]:
    """The header of a TSV file; an empty file is an error."""
    with open(path, encoding="utf-8-sig", newline="") as handle:
        header = next(csv.reader(handle, delimiter="\t"), None)
    if not header:
        raise ValueError(f"empty file: {path}")
    return header


def read_results(spark: SparkSession, path: str, list_name: str) -> DataFrame:
    """A result file with its row order as `ordinal`."""
    schema = StructType([StructField(f, StringType()) for f in ("source1_entity_id", list_name)])
    if header_of(path) != [f.name for f in schema]:
        raise ValueError(f"unexpected header in {path}")
    rows = read_tsv(spark, path, schema).withColumn("_line", F.monotonically_increasing_id())
    return with_rows(rows, ["_line"], "ordinal").drop("_line")
