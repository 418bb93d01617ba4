"""Autocorrelation and regression scores of ordered series, one series per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom import config as cfg
from netloom.operators.chunks import TARGET_ROWS, Chunked, chunked, lags, with_running_sum
from netloom.operators.windows import with_inter_arrival


def _with_lags(part: Chunked, x: str, n: int) -> DataFrame:
    """Add ``{x}1`` .. ``{x}n``, the values of the 1st .. nth row before."""
    return part.having(part.df.withColumns({f"{x}{i}": lag for i, lag in enumerate(lags(part, F.col(x), n), 1)})).result()


def lag1(df: DataFrame, x: str, key: str = "dataset", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``{x}_prev``, the previous value; rows with a null go, each series' first among them."""
    part = chunked(df, key, halo=1, target_rows=target_rows)
    value, first = lags(part, F.col(x), 1)[0], F.row_number().over(part.window()) == 1
    rows = part.df.withColumns({f"{x}_prev": value, "_first": first})
    return part.having(rows).result().filter(~F.col("_first")).drop("_first").dropna()


def lead1(df: DataFrame, x: str, key: str = "dataset", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``{x}_next``, the next value; rows with a null go, each series' last among them.

    Every pair of neighbours is found at its later row, which carries the earlier one.
    """
    part = chunked(df.withColumn("_row", F.struct(*df.columns)), key, halo=1, target_rows=target_rows)
    pairs = part.having(part.df.withColumn("_before", lags(part, F.col("_row"), 1)[0])).result()
    earlier = pairs.filter(F.col("_before").isNotNull())
    return earlier.select("_before.*", F.col(x).alias(f"{x}_next")).dropna()


def acf(df: DataFrame, x: str, length: int = 10, key: str = "dataset", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Pearson correlation of the series with itself, shifted by 0 .. length-1 rows."""
    narrow = df.select(key, "te", "flow_id", F.col(x).cast("double").alias("x"))
    rows = _with_lags(chunked(narrow, key, halo=length - 1, target_rows=target_rows), "x", length - 1)
    wide = rows.groupBy(key).agg(F.lit(1.0).alias("r0"), *[F.corr("x", f"x{i}").alias(f"r{i}") for i in range(1, length)])
    stack = ", ".join(f"{i}, r{i}" for i in range(length))
    return wide.selectExpr(key, f"stack({length}, {stack}) AS (lag, acf)")


def autocorrelation(
    df: DataFrame, x: str, lag_count: int = 5, key: str = "dataset", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Mean lagged product of deviations from the series mean, over its variance.

    The lagged sums follow from pair covariances, so mean and products need one pass:
    mean((a - m)(b - m)) = cov(a, b) + (mean a - m)(mean b - m).
    """
    narrow = df.select(key, "te", "flow_id", F.col(x).cast("double").alias("x"))
    rows = _with_lags(chunked(narrow, key, halo=lag_count - 1, target_rows=target_rows), "x", lag_count - 1)
    pairs = []
    for i in range(1, lag_count):
        pairs += [
            F.covar_pop("x", f"x{i}").alias(f"c{i}"),
            F.avg(F.when(F.col(f"x{i}").isNotNull(), F.col("x"))).alias(f"a{i}"),
            F.avg(f"x{i}").alias(f"b{i}"),
        ]
    wide = rows.groupBy(key).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), *pairs)
    values = ["v / v"] + [f"(c{i} + (a{i} - m) * (b{i} - m)) / v" for i in range(1, lag_count)]
    stack = ", ".join(f"{i}, {v}" for i, v in enumerate(values))
    return wide.selectExpr(key, f"stack({lag_count}, {stack}) AS (lag, autocorrelation)")


def pearson(df: DataFrame, x: str, y: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Correlation of x with y and of x with its previous value, first row of each dataset dropped."""
    pairs = lag1(df.select("dataset", "te", "flow_id", x, y), x, target_rows=target_rows)
    return pairs.groupBy("dataset").agg(F.corr(x, y).alias("corr_xy"), F.corr(x, f"{x}_prev").alias("corr_xx1"))


def _of_real(name: str, real: str):
    """The real dataset's value of a column, on every row of a one-row-per-dataset table."""
    return F.max(F.when(F.col("dataset") == real, F.col(name))).over(Window.partitionBy())


def mse_same_row(df: DataFrame, x: str, y: str, real: str) -> DataFrame:
    """Fit y on x in each dataset, mean squared error of that line on the real one.

    Both the line and the error follow from first and second moments: one aggregate.
    """
    moments = df.groupBy("dataset").agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"),
    )
    m = {n: _of_real(n, real) for n in ("mx", "my", "vx", "vy", "cxy")}
    a, b = F.col("a"), F.col("b")
    bias = m["my"] - a - b * m["mx"]
    mse = m["vy"] - 2 * b * m["cxy"] + b * b * m["vx"] + bias * bias
    return moments.select("dataset", b.alias("slope"), a.alias("intercept"), mse.alias("mse"))


def mse_temporal(df: DataFrame, x: str, y: str, real: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Fit the next x on (x, y) in each dataset, mean squared error of that plane on the real one."""
    pairs = lead1(df.select("dataset", "te", "flow_id", x, y), x, target_rows=target_rows)
    z = f"{x}_next"
    moments = pairs.groupBy("dataset").agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.var_pop(z).alias("vz"),
        F.covar_pop(x, y).alias("cxy"), F.covar_pop(x, z).alias("cxz"), F.covar_pop(y, z).alias("cyz"),
    )
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    fitted = moments.withColumns({
        "bx": (F.col("cxz") * F.col("vy") - F.col("cyz") * F.col("cxy")) / det,
        "by": (F.col("cyz") * F.col("vx") - F.col("cxz") * F.col("cxy")) / det,
    }).withColumn("a", F.col("mz") - F.col("bx") * F.col("mx") - F.col("by") * F.col("my"))
    m = {n: _of_real(n, real) for n in ("mx", "my", "mz", "vx", "vy", "vz", "cxy", "cxz", "cyz")}
    a, bx, by = F.col("a"), F.col("bx"), F.col("by")
    bias = m["mz"] - a - bx * m["mx"] - by * m["my"]
    spread = (
        m["vz"] - 2 * bx * m["cxz"] - 2 * by * m["cyz"]
        + bx * bx * m["vx"] + by * by * m["vy"] + 2 * bx * by * m["cxy"]
    )
    return fitted.select("dataset", bx, by, a.alias("intercept"), (spread + bias * bias).alias("mse"))


def cumulative_clock(flows: DataFrame, key: str = "this_ip", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Running clock of whole seconds between flows, and the hour share it stands at.

    Both are taken before the row's own delta is added, as the generator does.
    """
    part = with_inter_arrival(chunked(flows, key, halo=1, target_rows=target_rows))
    clock = with_running_sum(part, "clock", F.floor("delta")).result()
    return clock.withColumn("clock_hour", F.floor(F.col("clock") / 3600) / 24.0)
