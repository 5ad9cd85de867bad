"""Aggregates and windows."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cents
from ..operators import frames
from ..operators.settlement import latest, split_conflicts

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


def _money(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query("ag1_count", "select l_returnflag, count(*) as n, count(distinct l_orderkey) as n_orders from lineitem group by l_returnflag")
def count(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("ag2_sum", "select l_returnflag, l_linestatus, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by 1, 2")
def exact_sum(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(_money("l_extendedprice").alias("total"), _money("l_quantity").alias("quantity"))


@query("ag3_min_max", "select o_orderpriority, min(o_totalprice) as low, max(o_totalprice) as high, min(o_orderdate) as first from orders group by 1")
def min_max(t):
    return t("orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_orderdate").alias("first"))


@query("ag4_avg", "select p_brand, cast(sum(cast(p_retailprice as decimal(18,2))) as double) / count(*) as mean from part group by p_brand")
def avg(t):
    return t("part").groupBy("p_brand").agg((_money("p_retailprice") / F.count("*")).alias("mean"))


@query("ag5_all_any", "select o_custkey, bool_and(o_totalprice > 1000) as every_one, bool_or(o_orderstatus = 'P') as any_one from orders group by 1")
def all_any(t):
    return t("orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every_one"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_one"))


@query("ag6_distinct", "select event_type, count(distinct user_id) as users, count(distinct cast(ts as date)) as days from events group by 1")
def count_distinct(t):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("ts").cast("date")).alias("days"))


@query("ag7_topk", "select o_custkey, o_orderkey, cast(r as int) as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def topk(t):
    return frames.top(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("ag8_summarize", """select c_mktsegment, n_name, count(*) as n, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance
from customer join nation on c_nationkey = n_nationkey group by 1, 2""")
def summarize(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), _money("c_acctbal").alias("balance"))


@query("ag9_collect", "select n_regionkey, list(n_name order by n_name) as names from nation group by 1")
def collect(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("ag10_median", "select p_brand, median(p_retailprice) as mid from part group by 1")
def median(t):
    return t("part").groupBy("p_brand").agg(F.median("p_retailprice").alias("mid"))


@query("ag11_empty_extent", "select count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as total, median(l_quantity) as mid from lineitem where l_quantity < 0")
def empty_extent(t):
    return t("lineitem").filter("l_quantity < 0").agg(F.count("*").alias("n"), _money("l_quantity").alias("total"), F.median("l_quantity").alias("mid"))


@query("ag12_user_aggregate", """select user_id, sqrt(cast(sum(cast(value as decimal(18,4)) * cast(value as decimal(18,4))) as double) / count(*)) > 50 as loud, count(*) as n from events group by 1""")
def user_aggregate(t):
    """An aggregate of one's own as a composition of built-in ones, so that it combines before the shuffle."""
    square = F.sum(F.col("value").cast("decimal(18,4)") * F.col("value").cast("decimal(18,4)")).cast("double")
    return t("events").groupBy("user_id").agg((F.sqrt(square / F.count("*")) > 50).alias("loud"), F.count("*").alias("n"))


@query("ag13_approx_distinct")
def approx_distinct(t):
    """An estimate says so: value, relative error and method."""
    return t("events").groupBy("event_type").agg(F.struct(F.approx_count_distinct("user_id", 0.02).alias("value"), F.lit(0.02).alias("error"), F.lit("hll++").alias("method")).alias("users"))


@query("ag14_without_conflicts", """select l_returnflag, count(*) as n from (select l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag from lineitem group by 1, 2
having count(distinct (l_partkey, l_suppkey, l_returnflag)) = 1) group by 1""")
def without_conflicts(t):
    """Keys in conflict have no live row, so they don't count."""
    settled, _ = split_conflicts(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_returnflag"])
    return settled.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("ag16_rollup_ext", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("ag16_cube_ext", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ag16_grouping_sets_ext", "select c_mktsegment, c_nationkey, count(*) as n from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(t):
    sets = [["c_mktsegment"], ["c_nationkey"], []]
    return t("customer").groupingSets([[F.col(c) for c in s] for s in sets], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("ag17_work_units", "select o_custkey, case when count(*) = count(nullif(o_orderstatus, 'P')) then cast(sum(1) as bigint) end as work from orders group by 1")
def work_units(t):
    """One unknown cost makes the sum unknown, never zero."""
    cost = F.when(F.col("o_orderstatus") != "P", F.lit(1))
    return t("orders").groupBy("o_custkey").agg(F.when(F.count("*") == F.count(cost), F.sum(F.lit(1))).alias("work"))


@query("wn1_rows_frame", """select event_id, cast(sum(cast(round(value*100) as bigint)) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as bigint) as last3 from events""")
def rows_frame(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t("events").select("event_id", F.sum(cents(F.col("value"))).over(w).alias("last3"))


@query("wn1_range_frame", """select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as last_day from events""")
def range_frame(t):
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return t("events").select("event_id", F.count("*").over(w).alias("last_day"))


@query("wn2_latest_version", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_version(t):
    return latest(t("events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("wn3_lag_diff", """select event_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) over (partition by user_id order by ts, event_id) as gap from events""")
def lag_diff(t):
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", (s - F.lag(s).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))


@query("wn3_rolling", """select event_id, max(value) over (partition by user_id order by ts, event_id rows between 6 preceding and current row) as high7 from events""")
def rolling(t):
    return t("events").select("event_id", F.max("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-6, 0)).alias("high7"))


@query("wn4_feature_window", """select p.event_id, count(e.event_id) as n_before from events p left join events e on e.user_id = p.user_id and e.ts < p.ts and e.ts >= p.ts - interval 3 day
where p.event_type = 'purchase' group by 1""")
def feature_window(t):
    """Events of the three days before each purchase, strictly before it."""
    w = W.partitionBy("user_id").orderBy("_us").rangeBetween(-3 * 86_400_000_000, -1)
    e = t("events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("n_before", F.count("*").over(w)).filter("event_type = 'purchase'").select("event_id", "n_before")


@query("wn5_rank", """select o_orderkey, cast(rank() over w as int) as r, cast(dense_rank() over w as int) as d, cast(ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as q,
percent_rank() over w as p from orders window w as (partition by o_custkey order by o_orderpriority)""")
def rank(t):
    w, u = W.partitionBy("o_custkey").orderBy("o_orderpriority"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(u).alias("q"), F.percent_rank().over(w).alias("p"))


@query("uf3_udaf", "select event_type, quantile_cont(value, 0.9) as q90 from events group by 1")
def udaf(t):
    """An aggregate of one's own whose state is counts per range of values, and rows of the one range that matters."""
    return frames.quantile(t("events"), ["event_type"], "value", ["event_id"], 0.9, 1.0).withColumnRenamed("quantile", "q90")


@query("uf5_arrow_boundary", "select event_id, cast(round(value * 100) as bigint) % 97 as bucket from events")
def arrow_boundary(t):
    """Python at the border runs on Arrow batches, outside settlement."""

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"event_id": frame["event_id"], "bucket": frame["c"] % 97}), preserve_index=False)

    return t("events").select("event_id", cents(F.col("value")).alias("c")).mapInArrow(run, "event_id long, bucket long")
