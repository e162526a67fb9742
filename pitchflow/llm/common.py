"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors share files: under ``SparkContext.setCheckpointDir``, or else under the
    session's ``spark.checkpoint.dir``. Without either it is an error: a folder of one machine would not do."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("no folder to share tables in: call SparkContext.setCheckpointDir, or set spark.checkpoint.dir when the session starts")
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


#: Folders of the tables that ``stored`` has made in this process and nothing has deleted.
_MADE: list[str] = []


def made(folder: str) -> str:
    """Note a folder that ``sweep`` may delete."""
    _MADE.append(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts lineage, so that a lost executor costs the current stage alone, and nothing is computed twice. The table stays
    until ``forget`` or ``sweep`` deletes it.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(f"{folder}/{name}")
    _MADE.append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that is no longer read."""
    files = df.inputFiles()
    for folder in [f for f in _MADE if files and f"/{f.rsplit('/', 1)[1]}/" in files[0]]:
        _delete(df.sparkSession, folder)
        _MADE.remove(folder)


def sweep(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete the tables that ``stored`` has made in this process, but for those that ``keep`` reads: what is left of a run
    whose results are written."""
    read = [f for df in keep for f in df.inputFiles()]
    for folder in list(_MADE):
        if not any(f"/{folder.rsplit('/', 1)[1]}/" in f for f in read):
            _delete(spark, folder)
            _MADE.remove(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more`` of a document table, whatever other columns it has."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def remainder(doc_id, n: int):
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def column_function(kind: str):
    """A Pandas UDF of the given DDL type, made when it is called: workers that import the module have no session."""

    def wrap(f):
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return wrap
