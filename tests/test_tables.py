import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import tables as T
from millrace.operators import timeseries as S

QUARTERS = [820.0, 860.0, 905.0, 950.0, 1020.0, 1095.0, 1260.0]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(QUARTERS)], "ts int, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def near(a, b, places=4):
    return all((x is None and y is None) or math.isclose(x, y, abs_tol=10**-places) for x, y in zip(a, b, strict=True))


def test_ratios_of_one_row(spark):
    df = spark.createDataFrame([(1000.0, 600.0, 400.0, 150.0, 160.0, 120.0, 500.0, 300.0, 100.0, 1200.0, 600.0, 20.0)], "revenue double, cogs double, gross_profit double, operating_income double, ebit double, net_income double, current_assets double, current_liabilities double, inventory double, total_assets double, total_equity double, interest_expense double")
    r = T.ratios(df).first()
    assert (r.gross_margin, r.operating_margin, r.net_margin, r.ebitda_margin) == (0.40, 0.16, 0.12, None)
    assert near([r.current_ratio, r.quick_ratio], [1.6667, 1.3333])
    assert (r.debt_to_equity, r.debt_to_assets, r.roa, r.roe, r.interest_coverage, r.fcf, r.eps, r.pe) == (None, None, 0.1, 0.2, 8.0, None, None, None)


def test_ratio_modes_differ_on_fallbacks(spark):
    df = spark.createDataFrame([(100.0, 60.0, None, None, 10.0, 1e-13)], "revenue double, cogs double, gross_profit double, ebit double, operating_income double, total_assets double")
    row, table = T.ratios(df).first(), T.ratios(df, mode="table").first()
    assert (row.gross_margin, row.operating_margin) == (0.4, 0.1) and (table.gross_margin, table.operating_margin) == (None, None)
    assert row.roa is None


def test_common_size_and_kpi_table(spark):
    df = T.ratios(spark.createDataFrame([("a", 200.0, 50.0, 30.0)], "entity string, revenue double, cogs double, net_income double"))
    assert T.common_size(df).first().cogs_pct == 0.25
    out = T.kpi_table(df, "entity").first()
    assert out.gross_margin == 75.0 and out.net_margin == 15.0


def test_top_n_keeps_nulls_last_and_drops_null_groups(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, "a", 7.0), (4, None, 9.0), (5, "b", 1.0)], "id int, g string, v double")
    assert [r.id for r in T.top_n(df, "v", 2, tie=["id"]).collect()] == [4, 3]
    assert [r.id for r in T.top_n(df, "v", 4, descending=False, tie=["id"]).collect()] == [5, 1, 3, 4]
    assert sorted(r.id for r in T.top_n(df, "v", 1, group="g", tie=["id"]).collect()) == [3, 5]


def test_pivot_fills_the_cross_product(spark):
    df = spark.createDataFrame([("x", 1, "p", 2.0), ("y", 2, "q", 3.0)], "a string, b int, c string, v double")
    got = {(r.a, r.b): (r.p, r.q) for r in T.pivot_kpi(df, ["a", "b"], "c", "v", values=["p", "q"]).collect()}
    assert got == {("x", 1): (2.0, 0.0), ("x", 2): (0.0, 0.0), ("y", 1): (0.0, 0.0), ("y", 2): (0.0, 3.0)}
    assert T.pivot_kpi(df, ["a"], None, "v").count() == 2


def test_melt_and_percent_format(spark):
    df = spark.createDataFrame([("x", 0.1225, 2.0)], "k string, a double, b double")
    assert {(r.variable, r.value) for r in T.melt(df, ["k"]).collect()} == {("a", 0.1225), ("b", 2.0)}
    assert T.percent_format(df, ["a"], 1).first().a == 12.2


def test_profile_and_roles(spark):
    df = spark.createDataFrame([("Q1", 1.0, "2024-01-01"), ("Q2", 2.0, None), ("Q3", 4.0, "2024-01-03"), ("Q4", 3.0, "2024-01-04")], "quarter string, revenue_usd_m double, start_date string")
    rows = {r.name: r for r in T.profile(df, order="quarter").collect()}
    assert (rows["revenue_usd_m"].p25, rows["revenue_usd_m"].p50, rows["revenue_usd_m"].p75) == (1.75, 2.5, 3.25)
    assert rows["start_date"].nulls == 1 and rows["quarter"].example == "Q1"
    assert T.infer_roles(df) == {"date": "start_date", "value": "revenue_usd_m", "groups": ["quarter"]}


def test_normalize_table(spark):
    df = spark.createDataFrame([(" a ", "1,000", None), ("b", "(2)", ""), ("c", "–", " "), ("", None, None)], "` name ` string, amount string, nothing string")
    out = T.normalize_table(df)
    assert out.columns == ["name", "amount"] and sorted(r.amount for r in out.collect() if r.amount is not None) == [-2.0, 1000.0]
    assert out.count() == 3


def test_changes(series):
    assert near(column(S.qoq(series, "ts", "value"), "qoq"), [None, 4.8780, 5.2326, 4.9724, 7.3684, 7.3529, 15.0685])
    assert near(column(S.yoy(series, "ts", "value"), "yoy"), [None] * 4 + [24.3902, 27.3256, 39.2265])
    assert column(S.rolling(series, "ts", "value"), "rolling_mean_4")[-1] == 1081.25


def test_nulls_repeat_and_zero_bases_are_null(spark):
    df = spark.createDataFrame(list(enumerate([1.0, None, 2.0, 0.0, 3.0])), "ts int, value double")
    assert column(S.pct_change(df, "ts", "value"), "pct_change") == [None, 0.0, 100.0, -100.0, None]


def test_returns_and_deviation(spark):
    df = spark.createDataFrame(list(enumerate([None, 2.0, 4.0, -1.0])), "ts int, value double")
    assert column(S.cumulative_return(df, "ts", "value"), "cumulative_return") == [None, 0.0, 100.0, -150.0]
    assert near(column(S.log_return(df, "ts", "value"), "log_return"), [None, None, math.log(2), None])
    assert near(column(S.rolling(df, "ts", "value", how="std", window=3), "rolling_std_3"), [None, None, 1.41421, 2.51661])


def test_resample_fills_empty_quarters(spark):
    df = spark.sql("select * from values (date'2024-01-05', 1D), (date'2024-08-01', 2D), (date'2024-09-30', null) as t(ts, value)")
    rows = [(str(r.period_end), r.value) for r in S.resample(df, "ts", "value").orderBy("period_end").collect()]
    assert rows == [("2024-03-31", 1.0), ("2024-06-30", None), ("2024-09-30", 2.0)]
    assert [r.value for r in S.resample(df, "ts", "value", how="last").orderBy("period_end").collect()] == [1.0, None, 2.0]
    assert [str(r.period_end) for r in S.resample(df, "ts", "value", rule="A").collect()] == ["2024-12-31"]
    assert S.resample(df.limit(0), "ts", "value").count() == 0


def test_anomalies_guard_small_windows(spark):
    df = spark.createDataFrame([(i, 10.0 + i % 2) for i in range(20)] + [(20, 90.0)], "ts int, value double")
    flags = column(S.anomalies(df, "ts", "value", z=2.5), "anomaly")
    assert flags[-1] and not any(flags[:-1])
    assert column(S.anomalies(df, "ts", "value", window=2), "anomaly")[0] is False


def test_frequency_tail_and_alignment(spark):
    days = spark.sql("select explode(sequence(date'2023-01-31', date'2024-12-31', interval 1 month)) as ts").withColumn("value", F.lit(1.0))
    assert S.infer_frequency(days, "ts").first().frequency == "M"
    assert S.tail(days, "ts", "value", n=3).count() == 3
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ts int, value double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "ts int, value double")
    assert {(r.ts, r.left, r.right) for r in S.align(a, b).collect()} == {(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)}
    assert S.operations(days, "ts", "value").count() == 8
