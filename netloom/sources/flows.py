"""Readers of flow, piece and window tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_SCHEMA = T.StructType([
    T.StructField("te", T.TimestampNTZType()),
    T.StructField("td", T.DoubleType()),
    T.StructField("sa", T.StringType()),
    T.StructField("da", T.StringType()),
    T.StructField("sp", T.IntegerType()),
    T.StructField("dp", T.IntegerType()),
    T.StructField("pr", T.StringType()),
    T.StructField("flg", T.StringType()),
    T.StructField("fwd", T.IntegerType()),
    T.StructField("stos", T.IntegerType()),
    T.StructField("pkt", T.LongType()),
    T.StructField("byt", T.LongType()),
    T.StructField("lable", T.StringType()),
])

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

# Flow records derived from an event table; the same text runs in Spark and in DuckDB.
FLOWS_FROM_EVENTS = """
WITH b AS (
  SELECT event_id e, ts, user_id u, event_type, value v,
         CAST(floor(value / 2) AS BIGINT) h,
         concat('42.219.', CAST(152 + CAST(floor(user_id / 250) AS BIGINT) % 8 AS VARCHAR(9)), '.', CAST(user_id % 250 + 1 AS VARCHAR(9))) lip
  FROM {events}),
c AS (
  SELECT b.*, CASE WHEN e % 4 < 2 AND u % 10 <> 4 OR u % 10 = 3 THEN 1 ELSE 0 END outg,
         CASE WHEN e % 6 = 5 AND e % 7 = 0 THEN '42.219.160.255'
              WHEN e % 53 = 0 THEN '239.255.0.250'
              WHEN e % 61 = 0 THEN '192.168.0.0'
              WHEN e % 11 = 0 THEN concat('42.219.160.', CAST(h % 250 + 1 AS VARCHAR(9)))
              ELSE concat(CAST(43 + h * 37 % 180 AS VARCHAR(9)), '.', CAST(h * 101 % 256 AS VARCHAR(9)), '.', CAST(h * 59 % 256 AS VARCHAR(9)), '.', CAST(h * 83 % 256 AS VARCHAR(9))) END rip,
         CASE e % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN CAST(1024 + e * 97 % 64512 AS INT) ELSE 137 END svc,
         CAST(1024 + e * 7919 % 64512 AS INT) eph
  FROM b)
SELECT e AS flow_id, ts AS te, CAST(e % 364 AS DOUBLE) / 4 AS td,
  CASE WHEN outg = 1 THEN lip ELSE rip END AS sa, CASE WHEN outg = 1 THEN rip ELSE lip END AS da,
  eph AS sp, svc AS dp,
  CASE WHEN event_type = 'purchase' THEN 'UDP' WHEN event_type = 'error' THEN 'ICMP' ELSE 'TCP' END AS pr,
  1 + CAST(floor(v / 10) AS BIGINT) AS pkt, (1 + CAST(floor(v / 10) AS BIGINT)) * (38 + e % 1400) AS byt,
  CASE WHEN e % 97 = 0 THEN 'blacklist' ELSE 'background' END AS lable, lip AS this_ip
FROM c
"""


def flows_from_events(events: DataFrame) -> DataFrame:
    """Flow records of an event table, a projection only."""
    return events.sparkSession.sql(FLOWS_FROM_EVENTS, events=events)


def load_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def raw_columns(flows: DataFrame) -> DataFrame:
    """The 13 raw columns in file order; the three the events lack become literals."""
    filled = flows.withColumns({
        name: F.lit(value)
        for name, value in {"flg": ".AP.SF", "fwd": 0, "stos": 0}.items()
        if name not in flows.columns
    })
    return filled.select(*[F.col(f.name).cast(f.dataType) for f in FLOW_SCHEMA])


def read_raw_flows(spark: SparkSession, path) -> DataFrame:
    """Headerless raw flow files; file splits take the place of chunks.  A malformed field is an error, not a null."""
    reader = spark.read.schema(FLOW_SCHEMA).option("timestampNTZFormat", TIME_FORMAT).option("mode", "FAILFAST")
    return reader.csv(path, header=False)


def union_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of named datasets with a ``dataset`` column."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def read_flow_pieces(spark: SparkSession, datasets: dict[str, list[str]], schema) -> DataFrame:
    """Header files of several datasets, each the union of its pieces; ``piece`` is a path's place in its list.

    Columns go by the names in the header, in any order.  A file whose header differs from
    others of its piece, a missing column and a malformed field are errors.
    """
    def read(path: str, piece: int) -> DataFrame:
        named = spark.read.option("header", True).csv(path).schema
        text = spark.read.schema(named).option("enforceSchema", False).option("mode", "FAILFAST").csv(path, header=True)
        return text.select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit(piece).alias("piece"))

    return union_datasets({
        name: reduce(DataFrame.unionByName, [read(path, i) for i, path in enumerate(paths)])
        for name, paths in datasets.items()
    })


def read_windows(spark: SparkSession, path, height: int, width: int) -> DataFrame:
    """Headerless window rows: ``height`` context rows flattened, then one label row."""
    names = [f"v{i}" for i in range((height + 1) * width)]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=False)
    flat = F.array(*names)
    return rows.select(
        F.slice(flat, 1, height * width).alias("ctx"),
        F.slice(flat, height * width + 1, width).alias("label"),
    )
