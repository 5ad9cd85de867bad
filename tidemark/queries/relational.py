"""Scans, projections, filters, joins, sorting, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import cents, keyed_draw
from ..operators import frames
from ..operators.patterns import Pattern, Var
from ..sources.tables import dealt

V = Var
QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


@query("flagship_clients_at_risk", """
select c.c_custkey, count(*) as n_orders, cast(sum(cast(round(o.o_totalprice*100) as bigint)) as bigint) as total_cents,
       max(cast(round(o.o_totalprice*100) as bigint)) as max_cents
from orders o join customer c on o.o_custkey = c.c_custkey
where o.o_orderstatus <> 'F' and c.c_mktsegment = 'BUILDING'
  and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')
group by c.c_custkey""")
def clients_at_risk(t):
    """Open orders of one segment without a returned line, per client."""
    found = (
        Pattern().edge(t("orders"), o_orderkey=V("order"), o_custkey=V("client"), o_orderstatus=V("status"), o_totalprice=V("price"))
        .edge(t("customer"), c_custkey=V("client"), c_mktsegment="BUILDING")
        .without(t("lineitem"), l_orderkey=V("order"), l_returnflag="R")
        .when(F.col("status") != "F").let("cents", cents(F.col("price")))
    )
    return found.rows.groupBy(F.col("client").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("cents").alias("total_cents"), F.max("cents").alias("max_cents"))


@query("src3_scan_select", "select o_orderkey, o_orderstatus from orders where o_orderpriority = '1-URGENT'")
def scan(t):
    return t("orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_orderstatus")


@query("src4_history", "select user_id, count(*) as versions, count(distinct event_type) as n_values from events group by user_id")
def history(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("versions"), F.count_distinct("event_type").alias("n_values"))


@query("prj1_yield_distinct", "select distinct c_mktsegment as segment, c_nationkey as nation from customer")
def yield_distinct(t):
    return Pattern().edge(t("customer"), c_mktsegment=V("segment"), c_nationkey=V("nation")).yields("segment", "nation")


@query("prj2_rename", "select r_regionkey as id, r_name as name from region")
def rename(t):
    return t("region").withColumnsRenamed({"r_regionkey": "id", "r_name": "name"})


@query("prj3_let", "select o_orderkey, cast(round(o_totalprice*100) as bigint) as cents, cast(round(o_totalprice*100) as bigint) % 7 as rest from orders")
def let(t):
    return t("orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("cents")).withColumn("rest", F.col("cents") % 7)


@query("prj4_field", "select event_id, cast(props->>'$.k' as bigint) as k from events")
def field(t):
    return t("events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("fil1_when", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_quantity * 2 > 90 and l_discount < 0.05")
def when(t):
    return t("lineitem").filter((F.col("l_quantity") * 2 > 90) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("fil2_literal", "select distinct o_custkey as client from orders where o_orderstatus = 'P'")
def literal(t):
    return Pattern().edge(t("orders"), o_custkey=V("client"), o_orderstatus="P").yields("client")


@query("fil4_adm_allowlist", "select l_orderkey, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size <= 5) and l_returnflag = 'N'")
def allow_list(t):
    allowed = t("part").filter("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").filter("l_returnflag = 'N'").join(allowed, "l_partkey", "left_semi").select("l_orderkey", "l_partkey")


@query("fil5_any_union", "select distinct o_custkey as client from orders where o_orderstatus = 'P' union select c_custkey from customer where c_acctbal < 0")
def any_union(t):
    start = Pattern().edge(t("customer"), c_custkey=V("client"), c_acctbal=V("balance"))
    return start.any(lambda p: p.exists(t("orders"), o_custkey=V("client"), o_orderstatus="P"), lambda p: p.when(F.col("balance") < 0)).yields("client")


@query("fil6_attributes", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'P'")
def attributes(t):
    return (
        Pattern().edge(t("orders"), o_orderkey=V("o_orderkey"), o_custkey=V("c"), o_orderstatus="P")
        .edge(t("customer"), c_custkey=V("c"), c_name=V("c_name"), c_nationkey=V("n")).edge(t("nation"), n_nationkey=V("n"), n_name=V("n_name"))
        .rows.select("o_orderkey", "c_name", "n_name")
    )


@query("jn1_equi", """select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name""")
def equi(t):
    p = Pattern().edge(t("customer"), c_custkey=V("c"), c_nationkey=V("n")).edge(t("nation"), n_nationkey=V("n"), n_name=V("n_name")).edge(t("orders"), o_custkey=V("c"))
    return p.rows.groupBy("n_name").agg(F.count("*").alias("n"))


@query("jn2_theta", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join part on l_partkey = p_partkey where l_quantity > p_size and p_size > 40""")
def theta(t):
    p = Pattern().edge(t("lineitem"), l_orderkey=V("l_orderkey"), l_linenumber=V("l_linenumber"), l_partkey=V("l_partkey"), l_suppkey=V("l_suppkey"), l_quantity=V("q")).edge(t("part"), p_partkey=V("l_partkey"), p_size=V("size"))
    return p.when((F.col("q") > F.col("size")) & (F.col("size") > 40)).rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("jn3_cross", "select r_name, n_name from region, nation")
def cross(t):
    """Both relations have a fixed, small size: the one case that ``cross`` is for."""
    return Pattern().edge(t("region"), r_name=V("r_name")).cross(t("nation"), n_name=V("n_name")).rows


@query("jn4_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def exists(t):
    rich = t("orders").filter("o_totalprice > 300000")
    return Pattern().edge(t("customer"), c_custkey=V("c_custkey")).exists(rich, o_custkey=V("c_custkey")).rows


@query("jn5_without", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def without(t):
    return Pattern().edge(t("orders"), o_orderkey=V("o_orderkey")).without(t("lineitem"), l_orderkey=V("o_orderkey")).rows


@query("jn6_optional", "select o_orderkey, l_linenumber from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R'")
def optional(t):
    return Pattern().edge(t("orders"), o_orderkey=V("o_orderkey")).optional(t("lineitem"), l_orderkey=V("o_orderkey"), l_returnflag="R", l_linenumber=V("l_linenumber")).rows


@query("jn7_full", """select coalesce(a.k, b.k) as k, a.n as n_part, b.n as n_supp from (select p_size as k, count(*) as n from part group by 1) a
full join (select cast(s_nationkey + 10 as int) as k, count(*) as n from supplier group by 1) b on a.k = b.k""")
def full(t):
    a = t("part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("n_part"))
    b = t("supplier").groupBy((F.col("s_nationkey") + 10).cast("int").alias("k")).agg(F.count("*").alias("n_supp"))
    return a.join(b, "k", "full")


@query("jn8_asof", """
with p as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts),
     v as (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by user_id, ts)
select p.user_id, p.ts, p.event_id, v.view_id, v.ts as matched_at from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof(t):
    """The last view before each purchase of the same user."""
    e = t("events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    seen = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return frames.asof_join(bought, seen, ["user_id"], "ts", ["view_id"])


@query("jn9_interval", """
with s as (select user_id, epoch_us(ts) // 1000000 as a, epoch_us(ts) // 1000000 + 7200 as b, event_id as span_id from events where event_type = 'signup'),
     p as (select user_id, epoch_us(ts) // 1000000 as at, event_id from events where event_type = 'click')
select p.event_id, s.span_id from p join s on p.user_id = s.user_id and p.at >= s.a and p.at < s.b""")
def interval(t):
    """Clicks within two hours of a signup of the same user."""
    e = t("events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("at").alias("a"), (F.col("at") + 7200).alias("b"), F.col("event_id").alias("span_id"))
    points = e.filter("event_type = 'click'").select("user_id", "at", "event_id")
    return frames.interval_join(points, spans, ["user_id"], "at", "a", "b", 7200).select("event_id", "span_id")


@query("jn10_policy_history", """
with d as (select o_orderkey, o_custkey, o_orderpriority, o_orderstatus from orders)
select d.o_orderpriority as policy, d.o_orderstatus as outcome, n.n_name as region_of, count(*) as decisions, count(distinct l.l_partkey) as candidates
from d join customer c on d.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join lineitem l on l.l_orderkey = d.o_orderkey group by 1, 2, 3""")
def policy_history(t):
    """Lines meet their orders, and then those of one candidate, in tasks of bounded size: hardly two rows are alike, so grouping before the shuffle would hold them all."""
    by = ["policy", "outcome", "region_of"]
    made = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = made.select("o_orderkey", F.col("o_orderpriority").alias("policy"), F.col("o_orderstatus").alias("outcome"), F.col("n_name").alias("region_of"))
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    many = lines.count()
    joined = dealt(lines, many, "l_orderkey").join(dealt(made, many, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    each = dealt(joined.select(*by, "l_partkey"), many, *by, "l_partkey").groupBy(*by, "l_partkey").agg(F.count("*").alias("rows"))
    return each.groupBy(*by).agg(F.sum("rows").alias("decisions"), F.count("l_partkey").alias("candidates"))


@query("so1_order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def order_limit(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("so2_keyset_page", "select o_orderpriority, o_orderkey from orders where (o_orderpriority, o_orderkey) > ('3-MEDIUM', 100) order by 1, 2 limit 25")
def keyset_page(t):
    return frames.page(t("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], ("3-MEDIUM", 100), 25)


@query("so3_canonical_order", "select event_id, value, cast(rank() over (partition by event_type order by value, event_id) as int) as place from events")
def canonical_order(t):
    """Keys that aren't floats first, floats by their total order, the id last."""
    return frames.places(t("events"), ["event_type"], "value", ["event_id"], 1.0).select("event_id", "value", F.col("place").cast("int").alias("place"))


@query("so4_least_key", """select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderdate, o_orderkey) as r from orders) where r = 1""")
def least_key(t):
    least = F.min_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderpriority", "o_orderdate", "o_orderkey"))
    return t("orders").groupBy("o_custkey").agg(least.alias("x")).select("o_custkey", "x.*")


@query("st1_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("st2_intersect", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P'")
def intersect(t):
    o = t("orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("st3_difference", "select p_partkey as k from part except select l_partkey from lineitem where l_returnflag = 'R' and l_discount > 0.09")
def difference(t):
    """Parts that never came back after a high discount."""
    return t("part").select(F.col("p_partkey").alias("k")).subtract(t("lineitem").filter("l_returnflag = 'R' AND l_discount > 0.09").select(F.col("l_partkey").alias("k")))


@query("st4_distinct", "select distinct l_returnflag, l_linestatus from lineitem")
def distinct(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("st5_bag", "select k, count(*) as times from (select c_nationkey as k from customer union all select s_nationkey from supplier) group by k")
def bag(t):
    return frames.bag_union(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@query("st6_longer", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, name, value from lineitem unpivot (value for name in (l_discount, l_tax))""")
def longer(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    return frames.pivot_longer(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_discount", "l_tax"])


@query("st7_wider", "select o_custkey, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by o_custkey")
def wider(t):
    wide = frames.pivot_wider(t("orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return wide.select("o_custkey", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("st8_nest_unnest", "select n_regionkey, n_nationkey, n_name from nation")
def nest_unnest(t):
    return frames.unnest(frames.nest(t("nation"), ["n_regionkey"], ["n_nationkey", "n_name"]))


@query("st9_hash_sample", "select event_id from events where cast('0x' || substr(sha256(cast(event_id as varchar) || ':42'), 1, 8) as bigint) < 1073741824")
def hash_sample(t):
    return frames.keyed_sample(t("events"), F.col("event_id"), 0.25, 42).select("event_id")


@query("st10_diff", """
with b as (select o_custkey, o_orderpriority from orders where o_orderdate < timestamp '1998-01-01'), a as (select o_custkey, o_orderpriority from orders where o_orderdate >= timestamp '1998-01-01'),
n as (select o_custkey, o_orderpriority, sum(s) as n from (select *, 1 as s from a union all select *, -1 from b) group by 1, 2)
select o_custkey, o_orderpriority, cast(sign(n) as int) as op, cast(abs(n) as bigint) as times from n where n <> 0""")
def diff(t):
    o = t("orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    before, after = o.filter("o_orderdate < timestamp_ntz'1998-01-01'"), o.filter("o_orderdate >= timestamp_ntz'1998-01-01'")
    return frames.difference(before.drop("o_orderdate"), after.drop("o_orderdate"))


@query("st11_dedup_merge", "select distinct l_partkey as witness, l_suppkey as successor from lineitem")
def dedup_merge(t):
    lines = t("lineitem").select(F.col("l_partkey").alias("witness"), F.col("l_suppkey").alias("successor"))
    return lines.filter(keyed_draw(F.col("witness"), 1) % 2 == 0).unionByName(lines).distinct()
