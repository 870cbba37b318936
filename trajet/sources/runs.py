"""The run store: NDJSON records in bench/config/seed folders, summaries, resumable appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RUN_RECORD, RUN_SUMMARY

CELL = ["bench", "config_id", "seed"]


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A missing path is an empty table."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def append_records(records: DataFrame, root: str) -> None:
    """Adds NDJSON files under root/bench=…/config_id=…/seed=…"""
    records.write.mode("append").partitionBy(*CELL).json(root)


def append_pending(records: DataFrame, root: str) -> int:
    """Appends only tasks that the store lacks, so a repeated append changes nothing. Returns how many were new."""
    done = completed_ids(records.sparkSession, root)
    pending = records.join(done, [*CELL, "task_id"], "left_anti").dropDuplicates([*CELL, "task_id"]).cache()
    n = pending.count()
    if n:
        append_records(pending, root)
    pending.unpersist()
    return n


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """All well-formed records; blank and malformed lines are skipped, and a seed that is no number drops its folder."""
    schema = f"{RUN_RECORD}, _bad string"
    raw = _read(spark, root, schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", basePath=root)
    # the corrupt-record column may only be read along with the data
    return raw.filter("_bad is null and task_id is not null and seed is not null").drop("_bad")


def count_malformed(spark: SparkSession, root: str) -> int:
    """Lines that are neither blank nor JSON."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    return lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull()).count()


def completed_ids(spark: SparkSession, root: str) -> DataFrame:
    return read_records(spark, root).select(*CELL, "task_id").distinct()


def cell_paths(spark: SparkSession, root: str) -> DataFrame:
    """Cells of a store laid out as root/bench/config/seed/records.ndjson, from the paths alone."""
    pattern = r"/([^/]+)/([^/]+)/(\d+)/records\.ndjson$"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "records.ndjson").load(root).select("path")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "bench string, config_id string, seed int, path string")
        raise
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files.filter(F.col("path").rlike(pattern)).select(part(1).alias("bench"), part(2).alias("config_id"), part(3).cast("int").alias("seed"), "path")


def summaries(records: DataFrame) -> DataFrame:
    """One summary per cell. Empty means are 0; both counts are the number of rows."""
    n = F.count(F.lit(1))
    return records.groupBy(*CELL).agg(
        n.alias("n_total"), n.alias("n_completed"), F.coalesce(F.avg("score.primary"), F.lit(0.0)).alias("mean_primary_score"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("halt_reason"),
    )


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Single JSON documents; what is absent or unreadable is no row."""
    return _read(spark, path, RUN_SUMMARY, multiLine=True, mode="DROPMALFORMED").filter("bench is not null")


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, with the file's name to sort by."""
    return _read(spark, path, schema, multiLine=True).withColumn("file_name", F.col("_metadata.file_name"))


def read_either_form(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A document that is either an array of rows or a map of key to row: (key, row) as variants."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    is_array = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    listed = doc.filter(is_array).select(F.explode(F.col("v").cast("array<variant>")).alias("row")).select(F.variant_get("row", f"$.{key}", "string").alias("key"), "row")
    keyed = doc.filter(~is_array).select(F.explode(F.col("v").cast("map<string,variant>")).alias("key", "row"))
    return listed.unionByName(keyed)


def validated(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with the names of their broken rules). rules: name -> SQL predicate."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def cached_calls(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses). Misses go to a caller and are appended; failures are not."""
    one = cache.dropDuplicates([key])
    return requests.join(one, key), requests.join(one.select(key), key, "left_anti")


def named_cells(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells whose folder is a hash take the config's name from their meta document: join on the cell's key."""
    names = meta.select(*CELL, F.col("config_name"))
    return cells.join(names, CELL, "left").withColumn("config_name", F.coalesce("config_name", "config_id"))


def read_capped(spark: SparkSession, folder: str, most: int = 100_000) -> DataFrame:
    """(path, content, cut): the first bytes of each file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.substring("content", 1, most).alias("content"), (F.col("length") > most).alias("cut"))


def stale_files(spark: SparkSession, folder: str, now, ttl_seconds: int) -> DataFrame:
    """Paths last written more than ttl_seconds before now."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))).select("path")
