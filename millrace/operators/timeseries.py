"""Time series per entity: changes, rolling windows, resampling, anomalies.

A series is a DataFrame with a timestamp and a value; ``by`` names the columns
that tell entities apart. Series of different entities run in parallel; a
series itself is one window partition. Without ``by`` there is one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STEP = {"M": 1, "Q": 3, "A": 12}


def _window(by: Sequence[str], ts: str) -> WindowSpec:
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(ts)


def _filled(value: str, w: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def pct_change(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), periods: int = 1, out: str = "pct_change") -> DataFrame:
    """Change in percent to the row ``periods`` before; nulls repeat the last value, and a change from zero is null."""
    w = _window(by, ts)
    filled = df.withColumn("_filled", _filled(value, w))
    before = F.lag("_filled", periods).over(w)
    return filled.withColumn(out, F.when(before != 0, 100.0 * (F.col("_filled") / before - 1))).drop("_filled")


def yoy(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), periods: int = 4) -> DataFrame:
    return pct_change(df, ts, value, by, periods, "yoy")


def qoq(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), periods: int = 1) -> DataFrame:
    return pct_change(df, ts, value, by, periods, "qoq")


def rolling(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), window: int = 4, how: str = "mean", least: int | None = None, ddof: int = 1, out: str | None = None) -> DataFrame:
    """Mean or standard deviation of the last ``window`` rows, null below ``least`` values (1 for means, 2 for deviations)."""
    w = _window(by, ts).rowsBetween(-(max(1, window) - 1), 0)
    f = F.avg(value) if how == "mean" else F.stddev_samp(value) if ddof else F.stddev_pop(value)
    least = least if least is not None else (1 if how == "mean" else 2)
    return df.withColumn(out or f"rolling_{how}_{window}", F.when(F.count(value).over(w) >= min(least, window), f.over(w)))


def cumulative_return(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Change in percent to the first value of the series."""
    first = F.first(value, ignorenulls=True).over(_window(by, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("cumulative_return", F.when(first != 0, (F.col(value) / first - 1) * 100))


def log_return(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """ln(value / value before); null where that is not positive."""
    quotient = F.when(F.lag(value).over(_window(by, ts)) != 0, F.col(value) / F.lag(value).over(_window(by, ts)))
    return df.withColumn("log_return", F.when(quotient > 0, F.ln(quotient)))


def anomalies(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), window: int = 12, z: float = 3.0, least: int | None = None, ddof: int = 1) -> DataFrame:
    """``zscore`` against the last ``window`` rows, this one included, and ``anomaly``: abs(zscore) >= z, false where it is null."""
    w = _window(by, ts).rowsBetween(-(max(1, window) - 1), 0)
    least = min(max(3, window // 2) if least is None else least, window)
    spread = F.stddev_samp(value).over(w) if ddof else F.stddev_pop(value).over(w)
    score = F.when((F.count(value).over(w) >= least) & (spread > 0), (F.col(value) - F.avg(value).over(w)) / spread)
    return df.withColumn("zscore", score).withColumn("anomaly", F.coalesce(F.abs("zscore") >= z, F.lit(False)))


def resample(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), rule: str = "Q", how: str = "sum") -> DataFrame:
    """(by, period_end, value): calendar bins labelled by their last day; bins without rows are null.

    Bins are aggregated first (map-side), and only their table is joined with
    the spine of all bins between an entity's first and last.
    """
    step = STEP[rule]
    unit = {"M": "month", "Q": "quarter", "A": "year"}[rule]
    agg = {"sum": F.sum(value), "mean": F.avg(value), "last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts)))}[how]
    bins = df.where(F.col(ts).isNotNull()).groupBy(*by, F.trunc(ts, unit).alias("_bin")).agg(agg.alias(value))
    span = bins.groupBy(*by).agg(F.min("_bin").alias("_a"), F.max("_bin").alias("_b"))
    spine = span.where("_a is not null").select(*by, F.explode(F.expr(f"sequence(_a, _b, interval {step} months)")).alias("_bin"))
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_bin")]
    joined = spine.alias("s").join(bins.alias("b"), keys, "left")
    return joined.select(*(f"s.{c}" for c in by), F.last_day(F.add_months("s._bin", step - 1)).alias("period_end"), F.col(f"b.{value}").alias(value))


def align(left: DataFrame, right: DataFrame, ts: str = "ts", how: str = "outer") -> DataFrame:
    """(ts, left, right) of two series (ts, value), joined on the timestamp."""
    a, b = left.select(ts, F.col("value").alias("left")), right.select(ts, F.col("value").alias("right"))
    return a.join(b, ts, how)


def infer_frequency(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, median_gap, frequency): M, Q, Y or U by the median gap in days."""
    gaps = df.withColumn("_gap", F.datediff(ts, F.lag(ts).over(_window(by, ts))))
    gap = F.col("median_gap")
    return gaps.groupBy(*by).agg(F.median("_gap").alias("median_gap")).withColumn("frequency", F.when(gap.between(25, 35), "M").when(gap.between(80, 100), "Q").when(gap.between(350, 380), "Y").otherwise("U"))


def metrics_by_frequency(df: DataFrame, ts: str, value: str, frequency: str, by: Sequence[str] = (), z: float = 2.5) -> DataFrame:
    """Yearly change, moving average and anomalies with the windows of a frequency."""
    year, window = {"M": (12, 3), "Q": (4, 4), "Y": (1, 2)}.get(frequency, (1, 3))
    out = pct_change(df, ts, value, by, year, "yoy")
    out = rolling(out, ts, value, by, window, "mean", out="moving_average")
    return anomalies(out, ts, value, by, max(window, 2), z, least=2, ddof=0)


def tail(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), n: int = 8) -> DataFrame:
    """The last ``n`` rows with a value of each entity."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col(ts).desc_nulls_last())
    return df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def operations(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), n: int = 8) -> DataFrame:
    """The last ``n`` quarters of each entity: sum, quarterly and yearly change, rolling mean of four."""
    quarters = resample(df, ts, value, by, "Q", "sum")
    out = rolling(yoy(qoq(quarters, "period_end", value, by), "period_end", value, by), "period_end", value, by, 4, "mean")
    return tail(out, "period_end", value, by, n)
