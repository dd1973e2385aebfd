"""Shared folder, written tables and file access used by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one below the warehouse, or a temporary one if all runs in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="quillon-") if sc._jsc.sc().isLocal() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_quillon"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return re.sub(r"^file:/*", "file:///", found if ":/" in found else f"file://{found}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return Scratch(df.sparkSession, name).written(df, name)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


FILE_ROWS = 100_000  # of narrow tables whose size is known beforehand


class Scratch:
    """A folder below the shared one for the tables of one call, which drop() deletes when its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch(spark, name)

    def written(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """df as a table; if it is known to have `most` rows at most, in no more files than these need."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        (df if most is None else df.coalesce(max(1, -(-most // FILE_ROWS)))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        removed(self.spark, self.root)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its partitions fixed, in the reliable checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def uncheckpointed(df: DataFrame) -> None:
    """Deletes the files of what checkpointed() returned; df can't be read afterwards."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())


def fresh(df: DataFrame, *names: str, besides: tuple[str, ...] = ()) -> list[str]:
    """Column names that neither df nor `besides` has, in whatever case, made from names."""
    taken = {c.lower() for c in (*df.columns, *besides)}
    return [next(x for x in (n, *(f"{n}_{k}" for k in range(len(taken) + 1))) if x not in taken) for n in names]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, and the path on it; works on the driver and on executors."""
    return pafs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
