"""What the operators share about the session: tables, shared folder, written intermediate results."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from evidara.sources.files import new_path
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: list[str], like: str) -> str:
    """A column name that isn't among names, whatever the case."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like += "_"
    return like


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join(name, os.path.relpath(os.path.join(folder, f), package)))
    path = os.path.join(tempfile.mkdtemp(prefix="evidara-"), f"{name}.zip")
    with open(path, "wb") as out:
        out.write(raw.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, what: str, key: str) -> tuple[DataFrame, str, str]:
    """df written to the shared folder in buckets by key, as many as shuffles have partitions: joins on key don't move it.

    With it the name of its table, which is to be dropped, and its folder.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    name = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name, path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
