"""CSV, database-dump and NDJSON files as DataFrames with declared schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions.text import dump_value

# The first and the last line of a section of a dump.
COPY_LINE, COPY_END = r"(?i)^COPY\s+(?:public\.)?([a-z_]+)\s+\(", "\\."

#: More sections than this are joined to their lines by a shuffle.
MOST_SPANS = 50_000

INTERACTIONS = "id_a string, drug_a string, id_b string, drug_b string, level string"


def csv(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """Quoted CSV with a header line, positional columns; blank lines are skipped. Adds file and line for ordered dedup."""
    df = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', pathGlobFilter=pattern, enforceSchema=True)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def csv_line(c, schema: str):
    """A column of CSV lines as structs."""
    return F.from_csv(c, F.lit(schema), {"quote": '"', "escape": '"'})


def version(spark: SparkSession, path: str) -> DataFrame:
    """The files' dates of change and the eight digits that stand alone in their own names, if any; folders' names don't count."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", F.to_date("modificationTime").alias("changed"), F.nullif(F.regexp_extract("path", r"(?:^|/)[^/]*?(?<!\d)(\d{8})(?!\d)[^/]*$", 1), F.lit("")).alias("named"))


def dump_sections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, line, table, fields) of the COPY sections of a PostgreSQL dump, gzip or plain.

    A row belongs to the last COPY line before it, up to a line of \\. alone. Only those marks are put in order: a file's few
    marks give its sections as ranges of lines, and lines meet the ranges of their file in place. A
    plain dump is read by as many tasks as it has splits, a compressed one by one.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    begins = F.nullif(F.lower(F.regexp_extract("value", COPY_LINE, 1)), F.lit(""))
    mark = F.when(begins.isNotNull(), begins).when(F.col("value") == COPY_END, F.lit(""))
    marks = lines.select("file", "line", mark.alias("table")).where("table is not null")
    stop = F.lead("line").over(Window.partitionBy("file").orderBy("line"))
    spans = marks.select("file", F.col("line").alias("first"), "table", F.coalesce(stop, F.lit((1 << 63) - 1)).alias("stop")).where("table <> ''")
    # A row for each table of a dump: sent if there are few, which they are counted for.
    spans, _ = written(spans, "spans")
    spans = F.broadcast(spans) if spans.count() <= MOST_SPANS else spans
    held = lines.join(spans, "file").where("line > first and line < stop")
    return held.select("file", "line", "table", F.split("value", "\t").alias("fields"))


def parsed_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """dump_sections written to the shared folder, a folder a table: every relation that is picked from it afterwards reads its own table's rows, and nothing is parsed again."""
    out = new_path(spark, "dump")
    rows = dump_sections(spark, path)
    rows.write.partitionBy("table").option("compression", "zstd").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def picked(rows: DataFrame, table: str, fields: dict[str, int]) -> DataFrame:
    """Columns of one table of a dump by position; \\N and empty are null."""
    return rows.where(F.col("table") == table).select("file", "line", *[dump_value(F.get("fields", F.lit(i))).alias(n) for n, i in fields.items()])


def required(spark: SparkSession, path: str) -> str:
    """The path, which has to exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{path}: prepare the sources before they are loaded")
    return path


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The NDJSON file, or an empty table of its schema where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return ndjson(spark, path, schema)
    return spark.createDataFrame([], schema)


_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all hosts share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="evidara-"))
    return _own_folder[0]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path: it is computed once, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of a table that is sent to every task.
MOST_SENT = 50_000


def shuffled(df: DataFrame) -> DataFrame:
    """df, of which there may be a row for every record: the next join deals both sides, whatever Spark takes its size to be.

    Spark measures what it reads by its files. Runs of equal values take hardly a byte a row there, so that tables of many
    million rows would be collected by the driver.
    """
    return df.hint("merge")


def looked_up(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and counted: it is sent to every task if it has up to MOST_SENT rows, else dealt."""
    held, _ = written(df, what)
    return F.broadcast(held) if held.count() <= MOST_SENT else shuffled(held)
