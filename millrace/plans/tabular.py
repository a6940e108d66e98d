"""Queries of the tabular and time-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import tables as T
from millrace.operators import timeseries as S


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """A yearly statement for each nation from orders and their lines."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    orders = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    lines = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    base = lines.groupBy("o_orderpriority", "year").agg(
        F.sum(money).alias("revenue"), F.sum(F.col("l_quantity") * 900.0).alias("cogs"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("interest_expense"), F.count("*").cast("double").alias("shares_outstanding")
    )
    return base.select(
        F.col("o_orderpriority").alias("entity"), "year", "revenue", "cogs", "interest_expense", "shares_outstanding",
        F.expr("case when year % 2 = 0 then revenue * 0.2 end").alias("ebit"), (F.col("revenue") * 0.15).alias("operating_income"), (F.col("revenue") * 0.1).alias("net_income"),
        (F.col("revenue") * 2).alias("total_assets"), (F.col("revenue") * 0.8).alias("total_equity"), (F.col("revenue") * 1.2).alias("total_liabilities"),
        (F.col("revenue") * 0.5).alias("current_assets"), (F.col("revenue") * 0.25).alias("current_liabilities"), (F.col("revenue") * 0.1).alias("inventory"), F.lit(50.0).alias("price"),
    )


STATEMENTS = """
with b as (
  select o_orderpriority as entity, year(o_orderdate) as year, sum(l_extendedprice * (1 - l_discount)) as revenue, sum(l_quantity * 900.0) as cogs,
    sum(l_extendedprice * l_tax) as interest_expense, count(*)::double as shares_outstanding
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
s as (
  select *, case when year % 2 = 0 then revenue * 0.2 end as ebit, revenue * 0.15 as operating_income, revenue * 0.1 as net_income, revenue * 2 as total_assets, revenue * 0.8 as total_equity,
    revenue * 1.2 as total_liabilities, revenue * 0.5 as current_assets, revenue * 0.25 as current_liabilities, revenue * 0.1 as inventory, 50.0::double as price
  from b)
"""


def _rounded(df: DataFrame, cols, keep=(), n: int = 6) -> DataFrame:
    return df.select(*keep, *(F.round(c, n).alias(c) for c in cols))


SHOWN = ["gross_margin", "operating_margin", "net_margin", "current_ratio", "quick_ratio", "debt_to_equity", "debt_to_assets", "roa", "roe", "interest_coverage", "eps", "pe"]


def ratios_row(spark, d):
    return _rounded(T.ratios(_statements(spark, d)), SHOWN, ["entity", "year"])


def ratios_table(spark, d):
    return _rounded(T.ratios(_statements(spark, d), mode="table"), SHOWN, ["entity", "year"])


def _ratio_sql(base: str) -> str:
    return STATEMENTS + f"""
select entity, year, round((revenue - cogs) / revenue, 6) as gross_margin, round({base} / revenue, 6) as operating_margin, round(net_income / revenue, 6) as net_margin,
  round(current_assets / current_liabilities, 6) as current_ratio, round((current_assets - inventory) / current_liabilities, 6) as quick_ratio, round(total_liabilities / total_equity, 6) as debt_to_equity,
  round(total_liabilities / total_assets, 6) as debt_to_assets, round(net_income / total_assets, 6) as roa, round(net_income / total_equity, 6) as roe,
  round({base} / nullif(interest_expense, 0), 6) as interest_coverage, round(net_income / shares_outstanding, 6) as eps, round(price / (net_income / shares_outstanding), 6) as pe
from s"""


def common_size(spark, d):
    out = T.common_size(_statements(spark, d))
    return _rounded(out, ["cogs_pct", "operating_income_pct", "ebit_pct", "net_income_pct"], ["entity", "year"])


def kpi_table(spark, d):
    return T.kpi_table(T.ratios(_statements(spark, d)), "entity", "year").select("entity", "year", F.round("gross_margin", 1).alias("gross_margin"), F.round("roe", 6).alias("roe"))


def top_n_global(spark, d):
    return T.top_n(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, tie=["o_orderkey"])


def top_n_grouped(spark, d):
    return T.top_n(read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", 5, group="o_orderpriority", tie=["o_orderkey"])


def pivot_revenue(spark, d):
    li = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return T.pivot_kpi(li, ["l_returnflag"], "l_linestatus", "l_extendedprice", "sum", values=["F", "O"]).select("l_returnflag", F.round("F", 2).alias("f_price"), F.round("O", 2).alias("o_price"))


def pivot_count(spark, d):
    return T.pivot_kpi(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", "count", fill=0, values=["F", "O", "P"]).withColumnsRenamed({"F": "n_f", "O": "n_o", "P": "n_p"})


def melt_kpis(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return T.melt(li, ["l_returnflag"], ["quantity", "discount"], "kpi", "value")


def describe_numeric(spark, d):
    return T.describe_numeric(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"]).select("column", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


def profile_columns(spark, d):
    cols = ["c_custkey", "c_mktsegment", "c_acctbal"]
    return T.profile(read(spark, d, "customer").select(*cols), order="c_custkey").select("name", "non_null", "nulls", F.round("mean", 4).alias("mean"), *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")))


def bar_means(spark, d):
    return T.bar_means(read(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", F.round("c_acctbal", 4).alias("mean_balance"))


def rank_peers_rank(spark, d):
    from millrace.operators.reporting import competition_rank

    li = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 0).alias("quantity"))
    joined = li.join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return competition_rank(joined.select("s_nationkey", "s_suppkey", "quantity"), "quantity", by=["s_nationkey"])


# ------------------------------------------------------------------ series


def _orders(spark, d):
    return read(spark, d, "orders").select(F.to_date("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderpriority")


def _quarters(spark, d, by=()):
    return S.resample(_orders(spark, d), "ts", "value", by, "Q", "sum")


def resample_q(how: str):
    def query(spark, d):
        return S.resample(_orders(spark, d), "ts", "value", ["o_orderpriority"], "Q", how).select("o_orderpriority", "period_end", F.round("value", 2).alias("value"))

    return query


def resample_q_last(spark, d):
    daily = _orders(spark, d).groupBy("o_orderpriority", "ts").agg(F.max("value").alias("value"))
    return S.resample(daily, "ts", "value", ["o_orderpriority"], "Q", "last").select("o_orderpriority", "period_end", F.round("value", 2).alias("value"))


QUARTERS = """
with d as (select o_orderpriority, date_trunc('quarter', o_orderdate)::date as q, o_totalprice as v, o_orderdate::date as ts from orders),
b as (select o_orderpriority, q, {agg} as value from {src} group by 1, 2),
spine as (select o_orderpriority, unnest(generate_series(min(q)::timestamp, max(q)::timestamp, interval 3 month))::date as q from b group by 1),
series as (select s.o_orderpriority, last_day(s.q + interval 2 month) as period_end, b.value from spine s left join b on s.o_orderpriority = b.o_orderpriority and s.q = b.q)
"""
SUMS = QUARTERS.format(agg="sum(v)", src="d")
W = "(partition by o_orderpriority order by period_end)"


def _series(make, cols):
    def query(spark, d):
        out = make(_quarters(spark, d, ["o_orderpriority"]))
        return out.select("o_orderpriority", "period_end", *(F.round(c, 6).alias(c) for c in cols))

    return query


KEY = ("period_end", "value", ["o_orderpriority"])
CHANGE = "case when lag(value, {n}) over w <> 0 then round(100.0 * (value / lag(value, {n}) over w - 1), 6) end"


def _daily_events(spark, d):
    return read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))


def zscore_anomalies(spark, d):
    out = S.anomalies(_daily_events(spark, d), "day", "value", ["event_type"], window=12, z=2.0)
    return out.select("event_type", "day", F.round("zscore", 6).alias("zscore"), "anomaly")


def infer_frequency(spark, d):
    return S.infer_frequency(_quarters(spark, d, ["o_orderpriority"]), "period_end", ["o_orderpriority"])


def tail_8(spark, d):
    return S.tail(_quarters(spark, d, ["o_orderpriority"]), *KEY).select("o_orderpriority", "period_end", F.round("value", 2).alias("value"))


def align_series(how: str):
    def query(spark, d):
        a = read(spark, d, "orders").groupBy(F.expr("cast(date_format(o_orderdate, 'dd') as int)").alias("ts")).agg(F.count("*").alias("value"))
        b = read(spark, d, "events").groupBy(F.expr("cast(date_format(ts, 'dd') as int)").alias("ts")).agg(F.count("*").alias("value")).where("ts % 2 = 0")
        return S.align(a, b, "ts", how)

    return query


def timeseries_ops(spark, d):
    out = S.operations(_orders(spark, d), "ts", "value", ["o_orderpriority"])
    return out.select("o_orderpriority", "period_end", F.round("value", 2).alias("value"), F.round("qoq", 6).alias("qoq"), F.round("yoy", 6).alias("yoy"), F.round("rolling_mean_4", 2).alias("rolling_mean_4"))


def _align_sql(how: str) -> str:
    return f"""
with a as (select day(o_orderdate)::int as ts, count(*) as "left" from orders group by 1), b as (select day(e.ts)::int as ts, count(*) as "right" from events e where day(e.ts) % 2 = 0 group by day(e.ts))
select ts, "left", "right" from a {how} join b using (ts)"""


QUERIES = {
    "top_n_global": top_n_global,
    "top_n_grouped": top_n_grouped,
    "pivot_revenue": pivot_revenue,
    "pivot_count": pivot_count,
    "melt_kpis": melt_kpis,
    "describe_numeric": describe_numeric,
    "profile_columns": profile_columns,
    "bar_means": bar_means,
    "ratios_row": ratios_row,
    "ratios_table": ratios_table,
    "common_size": common_size,
    "kpi_table": kpi_table,
    "rank_peers_rank": rank_peers_rank,
    "resample_q_sum": resample_q("sum"),
    "resample_q_mean": resample_q("mean"),
    "resample_q_last": resample_q_last,
    "qoq": _series(lambda s: S.qoq(s, *KEY), ["qoq"]),
    "yoy": _series(lambda s: S.yoy(s, *KEY), ["yoy"]),
    "rolling_mean_4": _series(lambda s: S.rolling(s, *KEY), ["rolling_mean_4"]),
    "rolling_std": _series(lambda s: S.rolling(s, *KEY, how="std"), ["rolling_std_4"]),
    "cum_return": _series(lambda s: S.cumulative_return(s, *KEY), ["cumulative_return"]),
    "log_return": _series(lambda s: S.log_return(s, *KEY), ["log_return"]),
    "tail_8": tail_8,
    "timeseries_ops": timeseries_ops,
    "zscore_anomalies": zscore_anomalies,
    "infer_frequency": infer_frequency,
    "align_inner": align_series("inner"),
    "align_outer": align_series("outer"),
}

ORACLES = {
    "top_n_global": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25",
    "top_n_grouped": "select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderpriority is not null qualify row_number() over (partition by o_orderpriority order by o_totalprice desc nulls last, o_orderkey) <= 5",
    "pivot_revenue": "select l_returnflag, round(coalesce(sum(l_extendedprice) filter (l_linestatus = 'F'), 0), 2) as f_price, round(coalesce(sum(l_extendedprice) filter (l_linestatus = 'O'), 0), 2) as o_price from lineitem group by 1",
    "pivot_count": "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_orderstatus = 'O') as n_o, count(*) filter (o_orderstatus = 'P') as n_p from orders group by 1",
    "melt_kpis": "with k as (select l_returnflag, round(avg(l_quantity), 6) as quantity, round(avg(l_discount), 6) as discount from lineitem group by 1) select l_returnflag, 'quantity' as kpi, quantity as value from k union all select l_returnflag, 'discount', discount from k",
    "describe_numeric": " union all ".join(f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as min, max({c})::double as max from lineitem" for c in ("l_quantity", "l_extendedprice", "l_linenumber")),
    "profile_columns": " union all ".join(
        f"select '{c}' as name, count({c}) as non_null, count(*) - count({c}) as nulls, " + (f"round(avg({c}), 4) as mean, round(quantile_cont({c}::double, 0.25), 4) as p25, round(quantile_cont({c}::double, 0.5), 4) as p50, round(quantile_cont({c}::double, 0.75), 4) as p75" if n else "null::double as mean, null::double as p25, null::double as p50, null::double as p75") + " from customer"
        for c, n in (("c_custkey", 1), ("c_mktsegment", 0), ("c_acctbal", 1))
    ),
    "bar_means": "select c_mktsegment, round(avg(c_acctbal), 4) as mean_balance from customer where c_mktsegment is not null and c_acctbal is not null group by 1 order by avg(c_acctbal) desc, 1 limit 20",
    "ratios_row": _ratio_sql("coalesce(ebit, operating_income)"),
    "ratios_table": _ratio_sql("ebit"),
    "common_size": STATEMENTS + "select entity, year, round(cogs / revenue, 6) as cogs_pct, round(operating_income / revenue, 6) as operating_income_pct, round(ebit / revenue, 6) as ebit_pct, round(net_income / revenue, 6) as net_income_pct from s",
    "kpi_table": STATEMENTS + "select entity, year, round((revenue - cogs) / revenue * 100, 1) as gross_margin, round(net_income / total_equity, 6) as roe from s",
    "rank_peers_rank": "with q as (select l_suppkey as s_suppkey, round(sum(l_quantity), 0) as quantity from lineitem group by 1) select s_nationkey, s_suppkey, quantity, (rank() over (partition by s_nationkey order by quantity desc nulls last))::int as rank from q join supplier using (s_suppkey)",
    "resample_q_sum": SUMS + "select o_orderpriority, period_end, round(value, 2) as value from series",
    "resample_q_mean": QUARTERS.format(agg="avg(v)", src="d") + "select o_orderpriority, period_end, round(value, 2) as value from series",
    "resample_q_last": QUARTERS.format(agg="max_by(v, ts)", src="(select o_orderpriority, q, ts, max(v) as v from d group by all)") + "select o_orderpriority, period_end, round(value, 2) as value from series",
    "qoq": SUMS + f"select o_orderpriority, period_end, {CHANGE.format(n=1)} as qoq from series window w as {W}",
    "yoy": SUMS + f"select o_orderpriority, period_end, {CHANGE.format(n=4)} as yoy from series window w as {W}",
    "rolling_mean_4": SUMS + "select o_orderpriority, period_end, round(avg(value) over (partition by o_orderpriority order by period_end rows 3 preceding), 6) as rolling_mean_4 from series",
    "rolling_std": SUMS + "select o_orderpriority, period_end, round(stddev_samp(value) over (partition by o_orderpriority order by period_end rows 3 preceding), 6) as rolling_std_4 from series",
    "cum_return": SUMS + "select o_orderpriority, period_end, round((value / first_value(value) over (partition by o_orderpriority order by period_end) - 1) * 100, 6) as cumulative_return from series",
    "log_return": SUMS + f"select o_orderpriority, period_end, round(ln(value / lag(value) over w), 6) as log_return from series window w as {W}",
    "tail_8": SUMS + "select o_orderpriority, period_end, round(value, 2) as value from series where value is not null qualify row_number() over (partition by o_orderpriority order by period_end desc) <= 8",
    "timeseries_ops": SUMS + f"select o_orderpriority, period_end, round(value, 2) as value, {CHANGE.format(n=1)} as qoq, {CHANGE.format(n=4)} as yoy, round(avg(value) over (partition by o_orderpriority order by period_end rows 3 preceding), 2) as rolling_mean_4 from series window w as {W} qualify row_number() over (partition by o_orderpriority order by period_end desc) <= 8",
    "zscore_anomalies": """
with d as (select event_type, ts::date as day, sum(value) as value from events group by 1, 2),
z as (select event_type, day, case when count(value) over w >= 6 and stddev_samp(value) over w > 0 then (value - avg(value) over w) / stddev_samp(value) over w end as z from d window w as (partition by event_type order by day rows 11 preceding))
select event_type, day, round(z, 6) as zscore, coalesce(abs(z) >= 2, false) as anomaly from z""",
    "infer_frequency": SUMS + f", g as (select o_orderpriority, date_diff('day', lag(period_end) over w, period_end) as gap from series window w as {W}), m as (select o_orderpriority, median(gap)::double as median_gap from g group by 1) select o_orderpriority, median_gap, case when median_gap between 25 and 35 then 'M' when median_gap between 80 and 100 then 'Q' when median_gap between 350 and 380 then 'Y' else 'U' end as frequency from m",
    "align_inner": _align_sql("inner"),
    "align_outer": _align_sql("full outer"),
}
