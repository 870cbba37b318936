"""What the operators share: table access, lineage cuts, and the white space that the contracts name."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is not set, a local session (tests) gets one of its own; on a
    cluster it must be set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="trajet-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: rows go to the shared checkpoint folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but columnar and compressed, for wide rows of which later steps read a few columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of_keys(docs: DataFrame, keys: dict, kept: DataFrame, order: list | None = None) -> DataFrame:
    """The rows whose keys are in kept (columns of the same names; null equals null), one of each key, with all their
    columns whatever they are called: the least by `order`, then by a hash of the other columns."""
    plain = [f"`{c.replace('`', '``')}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind and kind != "void"]
    ranks = F.struct(*(order or []), F.xxhash64(*plain))
    rows = docs.select(F.expr("struct(*)").alias("row"), ranks.alias("rank"), *(e.alias(k) for k, e in keys.items()))
    wanted = kept.select(*(F.col(k).alias(f"kept_{k}") for k in keys))
    same = [rows[k].eqNullSafe(wanted[f"kept_{k}"]) for k in keys]
    return rows.join(wanted, same, "left_semi").groupBy(*keys).agg(F.min_by("row", "rank").alias("row")).select("row.*")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c):
    return F.translate(c, UPPER, UPPER.lower())


def without_spaces(c):
    """The text without its white space, one character kind at a time: byte searches beat a character map."""
    for space in SPACES:
        c = F.replace(c, F.lit(space), F.lit(""))
    return c


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def arrow_rows(rows: list[tuple], schema: str, **given: pa.Array) -> pa.RecordBatch:
    """Rows as a record batch of a schema like "a long, b string"; given columns pass as they are, so that an id
    keeps its value beside nulls."""
    names = dict(c.split() for c in schema.split(", "))
    columns = iter(zip(*rows)) if rows else iter([()] * len(names))
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.array(next(columns), _ARROW[t]) for c, t in names.items()], list(names))
