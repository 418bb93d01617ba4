"""Incremental versions of the profile, the rule report, the windows and the user sink.

Every job runs until the source has no new files (``availableNow``) and can be started
again with the same folder.  What a micro-batch adds is filed under its number, so a batch
that is run twice replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom import config as cfg
from netloom.functions import columns as c
from netloom.functions.rules import RULES
from netloom.operators.chunks import TARGET_ROWS, chunked, lags
from netloom.operators.filters import by_endpoint
from netloom.operators.profile import count_roles, endpoint_roles, user_type
from netloom.operators.rule_report import rule_verdicts
from netloom.operators.windows import complete, windows_of, with_inter_arrival
from netloom.session import broadcast_if_small, list_path, materialize
from netloom.sources.flows import flows_from_events
from netloom.sources.sinks import read_user_flows, write_user_flows
from netloom.streaming.levels import Levels, latest, sums


def stream_flows(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files: int = 1) -> DataFrame:
    """Flows of event files as they arrive, ``files`` files per micro-batch."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files).parquet(folder)
    )
    return flows_from_events(events)


def _run(writer, path: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _user_levels(spark: SparkSession, path: str) -> Levels:
    return Levels(spark, f"{path}/stats", sums("ip"))


def running_user_stats(flows: DataFrame, path: str) -> None:
    """Keep host profiles up to date: each batch adds the counts of its addresses to levelled runs."""
    levels = _user_levels(flows.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        levels.add(count_roles(endpoint_roles(batch)), number)

    _run(flows.writeStream.foreachBatch(write), path)


def read_user_stats(spark: SparkSession, path: str) -> DataFrame:
    """The profile of each address, from a number of runs that grows with the logarithm of the batches."""
    kind = user_type(F.col("incoming_num"), F.col("outgoing_num"))
    return _user_levels(spark, path).read().withColumn("user_type", kind)


def _rate_levels(spark: SparkSession, path: str) -> Levels:
    """Counts of windows, flows that came too late for theirs, and the latest time of any flow of a batch."""
    def merge(rows: DataFrame) -> DataFrame:
        totals = [F.sum(n).alias(n) for n in rows.columns if n not in ("window_start", "newest")]
        return rows.groupBy("window_start").agg(*totals, F.max("newest").alias("newest"))

    return Levels(spark, f"{path}/rates", merge)


def rule_rates(flows: DataFrame, path: str, every: str = "1 day", late: str = "10 minutes") -> None:
    """Per time window and rule: flows that pass and flows it applies to.

    The watermark is the latest time of all batches before, less ``late``.  A flow of a window that
    ended by then does not change the window any more; it is counted as late under that window, a flow
    without a time under none, so that reported and late flows together are the input.
    """
    levels = _rate_levels(flows.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        before = levels.read(before=number)
        newest = before.agg(F.max("newest")).first()[0] if before is not None else None
        timed = rule_verdicts(batch.withColumn("time", F.timestamp_micros(c.micros(F.col("te")))), "time")
        # a grouping window drops rows without a time, so they get one from a start of their own
        window = F.window(F.coalesce("time", F.lit(0).cast("timestamp")), every)
        timed = timed.withColumn("w", window).withColumn("untimed", F.col("time").isNull())
        over = F.col("untimed")
        if newest is not None:
            over = over | (F.col("w.end") <= F.lit(newest).cast("timestamp") - F.expr(f"interval {late}"))
        on_time = ~over
        counts = [
            agg
            for r in RULES
            for agg in (F.count_if(on_time & F.col(r)).alias(f"{r}_true"), F.count_if(on_time & F.col(r).isNotNull()).alias(f"{r}_total"))
        ]
        start = F.when(~F.col("untimed"), F.unix_seconds("w.start"))
        levels.add(timed.groupBy(start.alias("window_start")).agg(
            F.count_if(on_time).alias("flows"), F.count_if(over).alias("late"), *counts, F.max("time").alias("newest")), number)

    _run(flows.writeStream.foreachBatch(write), path)


def read_rule_rates(spark: SparkSession, path: str) -> DataFrame:
    """The counts of each window that any flow came in time for, and rule."""
    stack = ", ".join(f"'{r}', {r}_true, {r}_total" for r in RULES)
    counted = _rate_levels(spark, path).read().filter("flows > 0")
    return counted.selectExpr("window_start", f"stack({len(RULES)}, {stack}) AS (rule, true_count, total)")


def read_window_flows(spark: SparkSession, path: str) -> DataFrame:
    """``window_start, reported, late``: flows that count in a window and flows that came too late for it."""
    return _rate_levels(spark, path).read().select("window_start", F.col("flows").alias("reported"), "late")


def _edge_levels(spark: SparkSession, path: str, key: str) -> Levels:
    return Levels(spark, f"{path}/edges", latest(key, "cell"))


def carried_windows(
    flows: DataFrame, path: str, agg: int = cfg.FLOW_WINDOW, key: str = "this_ip", target_rows: int = TARGET_ROWS,
    cell_seconds: int = 86_400,
) -> None:
    """Context windows of arriving flows, in whatever order files arrive.

    Flows are filed by cells of time.  Of each user and cell the first and last rows are kept as an
    index of edges.  A batch reads the cells its flows fall into, for its users only, and the edges
    of these users' other cells: that holds the rows before and behind every new flow.  Windows are
    made of the new flows and of the flows up to ``agg + 1`` behind one, whose context or times
    between flows it changes; the earlier windows of the latter are retracted.  Inside a batch the
    windows are cut like in a batch job, so a user with most of the flows is spread over tasks.
    """
    spark = flows.sparkSession
    names, reach = flows.columns, agg + 1
    edges = _edge_levels(spark, path, key)

    def filed(cells: list[int], number: int) -> DataFrame | None:
        """Flows of earlier batches in the cells."""
        there = set(list_path(spark, f"{path}/flows")) if number else set()
        folders = [f"{path}/flows/cell={x}" for x in cells if f"cell={x}" in there]
        if not folders:
            return None
        return spark.read.option("basePath", f"{path}/flows").parquet(*folders).filter(F.col("batch") < number).select(*names, "cell")

    def step(batch: DataFrame, number: int) -> None:
        cell = F.floor(c.micros(F.col("te")) / (cell_seconds * 1_000_000)).cast("long")
        new = materialize(complete(batch).withColumn("cell", cell))
        touched = materialize(new.select(key, "cell").distinct())
        # days (or whatever a cell is) that the batch reaches: not more than time has
        cells = [r.cell for r in touched.select("cell").distinct().collect()]
        inside = new.withColumn("new", F.lit(True))
        before = filed(cells, number)
        if before is not None:
            again = before.join(broadcast_if_small(touched), [key, "cell"], "left_semi")
            inside = materialize(inside.unionByName(again.withColumn("new", F.lit(False))))
        everything = inside
        around = edges.read(before=number)
        if around is not None:
            users = broadcast_if_small(touched.select(key).distinct())
            others = around.join(users, key, "left_semi").join(broadcast_if_small(touched), [key, "cell"], "left_anti")
            everything = inside.unionByName(materialize(others.select(*names, "cell", F.lit(False).alias("new"))))
        part = with_inter_arrival(chunked(everything, key, halo=reach, target_rows=target_rows))
        changed = F.col("new")
        for earlier in lags(part, F.col("new"), reach):
            changed = changed | F.coalesce(earlier, F.lit(False))
        part = part.having(part.df.withColumn("changed", changed))
        # windows are much wider than flows: they are written once, with the mark, and only flow numbers read again
        made = f"{path}/windows/batch={number}"
        windows_of(part, agg, "new", "changed").filter("changed").drop("changed").write.mode("overwrite").parquet(made)
        again = spark.read.parquet(made).filter("not new").select("flow_id")
        again.write.mode("overwrite").parquet(f"{path}/retracted/batch={number}")
        ends = []
        for order in ((F.asc("te"), F.asc("flow_id")), (F.desc("te"), F.desc("flow_id"))):
            place = F.row_number().over(Window.partitionBy(key, "cell").orderBy(*order))
            ends.append(inside.drop("new").withColumn("place", place).filter(F.col("place") <= reach).drop("place"))
        edges.add(ends[0].unionByName(ends[1]).dropDuplicates(["flow_id"]).withColumn("batch", F.lit(number).cast("long")), number)
        (
            new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("cell", "batch").parquet(f"{path}/flows")
        )

    _run(flows.writeStream.foreachBatch(step), path)


def read_carried_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that no later batch retracted."""
    made = spark.read.parquet(f"{path}/windows")
    void = spark.read.schema("flow_id long, batch int").parquet(f"{path}/retracted")
    void = void.groupBy(F.col("flow_id").alias("f")).agg(F.max("batch").alias("again"))
    kept = made.join(broadcast_if_small(void), F.col("flow_id") == F.col("f"), "left").filter("again is null or batch >= again")
    return kept.drop("batch", "f", "again", "new")


def user_sink(flows: DataFrame, path: str) -> None:
    """Append each arriving flow to the clustered storage of its endpoints inside the internal net."""
    def write(batch: DataFrame, number: int) -> None:
        ends = by_endpoint(batch).filter(c.internal(F.col("user")))
        write_user_flows(ends, f"{path}/users", part=f"batch-{number}")

    _run(flows.writeStream.foreachBatch(write), path)


def read_user_sink(spark: SparkSession, path: str) -> DataFrame:
    return read_user_flows(spark, f"{path}/users")
