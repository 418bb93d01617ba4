"""Writers of per-user tables and reports, and the readers that go with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import list_path
from netloom.sources.flows import TIME_FORMAT

# Users a file is expected to hold at most; sets the size of its Bloom filter, beyond it more row groups are read.
BLOOM_USERS = 100_000
INDEX = "file string, first string, last string, rows long, unnamed long, part string"


def write_raw_flows(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("append").option("timestampNTZFormat", TIME_FORMAT.replace("[", "").replace("]", "")).csv(
        path, header=header
    )


def _cluster(df: DataFrame, path: str, user: str, part: str | None, order: tuple) -> None:
    """Write a part in ranges of user and time, then its index: per file the first and last user and the rows.

    A range never holds more than its share, whoever the rows belong to: a heavy user spans
    several files, light ones share one, and adaptive execution joins ranges until a file is worth
    writing.  The index is written last and commits the part; a part of the same name is replaced.
    """
    spark, part = df.sparkSession, part or uuid.uuid4().hex
    keys = [user, *[c for c in order if c in df.columns]]
    data = f"{path}/data/part={part}"
    (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{user}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{user}", BLOOM_USERS).parquet(data)
    )
    written = spark.read.schema(df.schema).parquet(data)
    index = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(user).cast("string").alias("first"), F.max(user).cast("string").alias("last"), F.count("*").alias("rows"),
        F.count_if(F.col(user).isNull()).alias("unnamed"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/part={part}")


def write_user_flows(df: DataFrame, path: str, user: str = "user", part: str | None = None) -> None:
    """Append flows to storage clustered by user: the number of files follows the bytes, not the users."""
    _cluster(df.withColumn(user, F.col(user).cast("string")), path, user, part, ("te", "flow_id"))


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, last, rows, unnamed, part`` of every committed file."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_user_flows(spark: SparkSession, path: str, *users: str, user: str = "user") -> DataFrame:
    """Flows of the clustered storage, of the given users only if there are any.

    For given users the index names the files whose range holds one of them; their row
    groups are left out by range and Bloom filter.
    """
    whole = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").drop("part")
    parts = stored_files(spark, path)
    if not users:
        return whole if _all_committed(spark, path) else spark.read.schema(whole.schema).parquet(*[r.file for r in parts.collect()])
    holds = F.lit(False)
    for u in users:
        holds = holds | F.lit(u).between(F.col("first"), F.col("last"))
    files = [r.file for r in parts.filter(holds).select("file").collect()]
    found = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return found.filter(F.col(user).isin(*users))


def _all_committed(spark: SparkSession, path: str) -> bool:
    """Whether every part has its index: one that lacks it was not written to its end."""
    return set(list_path(spark, f"{path}/data")) <= set(list_path(spark, f"{path}/index"))


def write_windows(windows: DataFrame, path: str, user: str = "user", part: str | None = None) -> None:
    """Append window rows (context, then label) as one line of numbers each, clustered by user like flows."""
    values = F.concat("ctx", "label").cast("array<string>")
    order = [c for c in ("te", "flow_id") if c in windows.columns]
    lines = windows.select(F.col(user).cast("string").alias(user), *order, F.concat_ws(",", values).alias("line"))
    _cluster(lines, path, user, part, tuple(order))


def export_windows(spark: SparkSession, path: str, target: str, *users: str, user: str = "user") -> None:
    """The stored windows as headerless text in gzip files, of the given users or of all."""
    read_user_flows(spark, path, *users, user=user).select("line").write.mode("overwrite").option("compression", "gzip").text(target)


def recover_user_list(spark: SparkSession, path: str, user: str = "user") -> DataFrame:
    """Users of the stored files, with the rows each holds; one sorted column is read."""
    return read_user_flows(spark, path, user=user).groupBy(F.col(user).alias("user")).agg(F.count("*").alias("rows"))


def folder_total(users: DataFrame) -> DataFrame:
    """Rows over all user files."""
    return users.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("total_rows"))


def write_report(report: DataFrame, path: str, name: str, run: str) -> None:
    """Put one metric table into the report store as rows of JSON; a repeated run replaces its own."""
    report.select(F.to_json(F.struct("*")).alias("row")).write.mode("overwrite").parquet(f"{path}/report={name}/run={run}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``row, report, run`` of every stored table."""
    return spark.read.schema("row string, report string, run string").parquet(path)
