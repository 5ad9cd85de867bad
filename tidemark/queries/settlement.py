"""Phases, masks, conflicts, errors, constraints; candidates, commits, journals, grades and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cents
from ..operators import settlement as S
from ..operators.patterns import Pattern, Var, first_empty_prefix
from ..plans.incremental import apply_delta, join_delta, regroup
from ..plans.phases import Rule, phases, touched

V = Var
QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


@query("ph1_stratified_unassigned", """with assigned as (select distinct l_orderkey from lineitem where l_returnflag = 'A'), waiting as (select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from assigned))
select o_custkey, count(*) as waiting from waiting group by 1""")
def unassigned(t):
    """Three rules in three phases: what is assigned, what isn't, and how much of that each client has."""
    order = phases([
        Rule("assign", "assigned", frozenset({"lineitem"})), Rule("wait", "waiting", frozenset({"orders"}), frozenset({"assigned"})),
        Rule("load", "load", strict=frozenset({"waiting"})),
    ])
    bodies = {
        "assign": lambda r: r | {"assigned": r["lineitem"].filter("l_returnflag = 'A'").select("l_orderkey").distinct()},
        "wait": lambda r: r | {"waiting": Pattern().edge(r["orders"], o_orderkey=V("o"), o_custkey=V("o_custkey")).without(r["assigned"], l_orderkey=V("o")).rows},
        "load": lambda r: r | {"load": r["waiting"].groupBy("o_custkey").agg(F.count("*").alias("waiting"))},
    }
    relations = {"lineitem": t("lineitem"), "orders": t("orders")}
    for name in sorted(order, key=order.get):
        relations = bodies[name](relations)
    return relations["load"]


@query("mk1_mask", "select o_orderkey, cast(round(o_totalprice*100) as bigint) as cents, 'computed' as source from orders where o_orderkey % 13 <> 0 union all select o_orderkey, cast(100000 as bigint), 'manual' from orders where o_orderkey % 13 = 0")
def mask(t):
    """A manual price defeats the computed one; history keeps both."""
    computed = t("orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("cents"), F.lit("computed").alias("source"))
    manual = t("orders").filter("o_orderkey % 13 = 0").select("o_orderkey", F.lit(100000).cast("long").alias("cents"), F.lit("manual").alias("source"))
    return S.live(computed, manual, ["o_orderkey"]).unionByName(manual)


@query("mk2_mask_of_mask", "select o_orderkey from orders where not (o_orderkey % 13 = 0 and o_orderkey % 26 <> 0)")
def mask_of_mask(t):
    orders = t("orders").select("o_orderkey")
    masks, unmask = orders.filter("o_orderkey % 13 = 0"), orders.filter("o_orderkey % 26 = 0")
    return S.live(orders, S.live(masks, unmask, ["o_orderkey"]), ["o_orderkey"])


@query("kc2_key_conflict", "select l_orderkey, l_linenumber, count(*) as supports from lineitem group by 1, 2 having count(distinct (l_partkey, l_suppkey)) > 1")
def key_conflict(t):
    _, conflicts = S.split_conflicts(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return conflicts.select("l_orderkey", "l_linenumber", "supports")


@query("kc2_settled", "select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, count(*) as supports from lineitem group by 1, 2 having count(distinct (l_partkey, l_suppkey)) = 1")
def settled(t):
    return S.split_conflicts(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])[0]


@query("kc3_event_idem", "select event_id, user_id, event_type, cast(1 + (event_id % 5 = 0)::int as bigint) as supports from events")
def event_idem(t):
    """Events told again with the same content are one event with two supports."""
    e = t("events").select("event_id", "user_id", "event_type")
    return S.split_conflicts(e.unionByName(e.filter("event_id % 5 = 0")), ["event_id"], ["user_id", "event_type"])[0]


@query("kc5_frontier_unique", "select o_orderpriority, o_orderdate, count(*) as supports from orders group by 1, 2 having count(distinct o_orderkey) > 1")
def frontier_unique(t):
    return S.split_conflicts(t("orders"), ["o_orderpriority", "o_orderdate"], ["o_orderkey"])[1].select("o_orderpriority", "o_orderdate", "supports")


@query("er1_error_edges", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'unit_price' as rule, 'per_discount' as site from lineitem where l_discount = 0")
def error_edges(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_extendedprice")
    _, errors = S.errors(lines, "unit_price", {"per_discount": (F.try_divide("l_extendedprice", "l_discount"), F.col("l_extendedprice").isNotNull())})
    return errors.drop("l_discount", "l_extendedprice")


@query("er2_faults", """select p_partkey, 'parse' as rule, 'size' as site, 'NotANumber' as fault from part where try_cast(regexp_extract(p_name, '([^ ]+)$', 1) as int) is null
union all select p_partkey, 'parse', 'ratio', 'DivisionByZero' from part where p_size % 7 = 0 union all select p_partkey, 'parse', 'total', 'Overflow' from part where p_retailprice * p_size > 32767""")
def faults(t):
    """Faults of three kinds of one rule's sites; the other sites of the row, and other rows, go on."""
    last = F.regexp_extract("p_name", "([^ ]+)$", 1)
    sites = {
        "size": (last.try_cast("int"), F.lit(True), "NotANumber"), "ratio": (F.try_divide("p_retailprice", F.col("p_size") % 7), F.lit(True), "DivisionByZero"),
        "total": (F.when(F.col("p_retailprice") * F.col("p_size") <= 32767, 1), F.lit(True), "Overflow"),
    }
    _, found = S.errors(t("part").select("p_partkey", "p_name", "p_retailprice", "p_size"), "parse", {name: site[:2] for name, site in sites.items()})
    kind = F.create_map(*[F.lit(x) for name, site in sites.items() for x in (name, site[2])])
    return found.select("p_partkey", "rule", "site", kind[F.col("site")].alias("fault"))


@query("cn1_violation", """select o_orderkey, 'priced' as "constraint" from orders where not o_totalprice >= 5000 union all select o_orderkey, 'settled' from orders where not (o_orderstatus <> 'P')""")
def violation(t):
    return S.violations(t("orders"), {"priced": F.col("o_totalprice") >= 5000, "settled": F.col("o_orderstatus") != "P"}).select("o_orderkey", "constraint")


@query("cn2_completeness", """with w as (select year(l_shipdate) as part, max(l_shipdate) as through from lineitem group by 1 having count(distinct month(l_shipdate)) = 12)
select o_orderkey, case when w.part is null then 'Unknown' else 'Absent' end as answer from orders o left join w on year(o_orderdate) = w.part and o_orderdate <= w.through where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def completeness(t):
    """Absence is read only in partitions that a table of witnesses declares complete: years with lines of all months."""
    witness = t("lineitem").groupBy(F.year("l_shipdate").alias("part")).agg(F.max("l_shipdate").alias("through"), F.count_distinct(F.month("l_shipdate")).alias("months"))
    orders = t("orders").select("o_orderkey", F.year("o_orderdate").alias("part"), F.col("o_orderdate").alias("at"))
    return S.absent(orders, t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], witness.filter("months = 12"), "part", "at", "through").select("o_orderkey", "answer")


@query("cn3_shape", """select p_partkey, 'brand' as "constraint" from part where not regexp_full_match(p_brand, 'Brand#[0-9]+') union all select p_partkey, 'size' from part where not p_size between 1 and 45""")
def shape(t):
    return S.violations(t("part"), {"brand": F.col("p_brand").rlike("^Brand#[0-9]+$"), "size": F.col("p_size").between(1, 45)}).select("p_partkey", "constraint")


# Candidates, commits and journals: events are an agenda per user.

AGENDA_SQL = "select user_id as world, event_id as witness, event_type as successor, cast(day(ts) as int) as phase, cast(floor(value) as bigint) as priority from events"


def _agenda(t):
    return t("events").select(F.col("user_id").alias("world"), F.col("event_id").alias("witness"), F.col("event_type").alias("successor"), F.dayofmonth("ts").alias("phase"), F.floor("value").alias("priority"))


@query("se1_candidates", f"with a as ({AGENDA_SQL}) select distinct world, successor from a where successor <> 'error'")
def candidates(t):
    return _agenda(t).filter("successor <> 'error'").select("world", "successor").distinct()


@query("se2_instrumented", f"with a as ({AGENDA_SQL}) select world, count(*) + 1 as work, count(*) filter (successor <> 'error') as admitted from a group by world")
def instrumented(t):
    """One unit for the provider and one for each raw candidate, admitted or not."""
    return _agenda(t).groupBy("world").agg((F.count("*") + 1).alias("work"), F.count_if(F.col("successor") != "error").alias("admitted"))


@query("se4_commit_least", f"with a as ({AGENDA_SQL}), r as (select *, row_number() over (partition by world order by phase, priority, witness) as k, count(*) over (partition by world) as work from a where successor <> 'error') select world, witness, successor, phase, priority, work from r where k = 1")
def commit_least(t):
    return S.commit_least(_agenda(t).filter("successor <> 'error'"), ["world"], "phase", "priority", "witness")


@query("se6_run", f"with a as ({AGENDA_SQL}), r as (select *, row_number() over (partition by world order by phase, priority, witness) as k from a where successor <> 'error') select world, cast(k as int) as tick, witness from r where k <= 5")
def run(t):
    """Five ticks of every world at once: what commits of the least remaining key would take in turn."""
    w = W.partitionBy("world").orderBy("phase", "priority", "witness")
    return _agenda(t).filter("successor <> 'error'").withColumn("tick", F.row_number().over(w)).filter("tick <= 5").select("world", "tick", "witness")


@query("se7_world_delta", "select user_id, event_id, cast(-1 as int) as op from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 2 union all select user_id, event_id, 1 from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def world_delta(t):
    """A commit's change of the world: the old state goes, the new one comes."""
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = t("events").withColumn("r", r).filter("r <= 2")
    return last.select("user_id", "event_id", F.when(F.col("r") == 1, 1).otherwise(-1).alias("op"))


@query("se8_incremental_step", "select user_id, event_type, count(*) as n from events where event_id % 10 <> 3 group by 1, 2")
def incremental_step(t):
    """A view of counts after a delta with removals and additions; equals the recomputation."""
    e = t("events")
    counted = lambda rows, sign: rows.groupBy("user_id", "event_type").agg((F.count("*") * sign).alias("n"))
    view = counted(e.filter("event_id % 10 <> 4"), 1)
    delta = counted(e.filter("event_id % 10 = 3"), -1).unionByName(counted(e.filter("event_id % 10 = 4"), 1))
    return apply_delta(view, delta)


@query("se9_naive", "select user_id, event_type, count(*) as n from events where event_id % 10 <> 3 group by 1, 2")
def naive(t):
    return t("events").filter("event_id % 10 <> 3").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("se10_journal_chain", """with recursive e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events),
c as (select distinct user_id, 0::bigint as k, sha256('') as h from events union all select c.user_id, e.k, sha256(c.h || e.event_id) from c join e on e.user_id = c.user_id and e.k = c.k + 1)
select user_id, max_by(h, k) as chain, max(k) as length from c group by 1""")
def journal_chain(t):
    return S.chain(t("events"), ["user_id"], "event_id", F.col("event_id"))


@query("se14_agenda", "select event_type, min(ts) as since, count(*) as n from events where event_type in ('signup', 'view', 'purchase') group by 1")
def agenda(t):
    """Rules that name earlier facts, committed in the order of their phases."""
    order = phases([Rule("purchase", "p", frozenset({"v"})), Rule("view", "v", frozenset({"s"})), Rule("signup", "s", frozenset({"events"}))])
    kinds = [k for k in sorted(order, key=order.get)]
    return t("events").filter(F.col("event_type").isin(kinds)).groupBy("event_type").agg(F.min("ts").alias("since"), F.count("*").alias("n"))


@query("se17_reflexive", "select distinct user_id as config, user_id as successor from events")
def reflexive(t):
    return t("events").select(F.col("user_id").alias("config"), F.col("user_id").alias("successor")).distinct()


#: Spine of the grades; Proven and Refuted are both above Audited and not comparable. Fixed values.
GRADES = {"Unknown": 0, "Measured": 1, "Derived": 2, "Audited": 3, "Proven": 4, "Refuted": 4}


@query("gr1_lattice", """with g(name, rank) as (values ('Unknown', 0), ('Measured', 1), ('Derived', 2), ('Audited', 3), ('Proven', 4), ('Refuted', 4))
select a.name as a, b.name as b, a.rank < b.rank or a.name = b.name as le from g a, g b""")
def lattice(t):
    """A table of 36 rows from a list of six: the only input is the list."""
    g = t("region").sparkSession.createDataFrame(list(GRADES.items()), "name string, rank int")
    a, b = (g.select(F.col("name").alias(n), F.col("rank").alias(f"r{n}")) for n in ("a", "b"))
    return a.crossJoin(b).select("a", "b", ((F.col("ra") < F.col("rb")) | (F.col("a") == F.col("b"))).alias("le"))


@query("gr3_routes", """with j as (select event_id, case event_type when 'purchase' then 'Derived' when 'view' then 'Measured' when 'error' then 'Proven' else 'Unknown' end as outcome, case when event_type in ('purchase', 'error') then 'settlement' else 'observer' end as authority from events)
select event_id, outcome, case when (authority, outcome) in (('settlement', 'Derived'), ('observer', 'Measured'), ('observer', 'Unknown'), ('audit', 'Audited')) then 'accepted' else 'refused' end as verdict from j""")
def routes(t):
    """A judgement is published only by a route that the table names; the table is small and fixed."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "Derived").when(kind == "view", "Measured").when(kind == "error", "Proven").otherwise("Unknown")
    judged = t("events").select("event_id", outcome.alias("outcome"), F.when(kind.isin("purchase", "error"), "settlement").otherwise("observer").alias("authority"))
    named = [("settlement", "Derived"), ("observer", "Measured"), ("observer", "Unknown"), ("audit", "Audited")]
    table = judged.sparkSession.createDataFrame(named, "authority string, outcome string").withColumn("verdict", F.lit("accepted"))
    return judged.join(F.broadcast(table), ["authority", "outcome"], "left").select("event_id", "outcome", F.coalesce("verdict", F.lit("refused")).alias("verdict"))


@query("gr5_assert", "select doc_id, 1 + quality >= 2 as ok from labels")
def grade_assert(t):
    grade = F.when(F.col("quality") == 1, "Derived").otherwise("Measured")
    rank = F.create_map(*[x for k, v in GRADES.items() for x in (F.lit(k), F.lit(v))])
    return t("labels").select("doc_id", (rank[grade] >= GRADES["Derived"]).alias("ok"))


@query("gr6_honest", "select user_id, case when bool_and(value < 99) then 'Derived' else 'Audited' end as outcome from events group by 1")
def honest(t):
    """A composition keeps its grade if all leaves are tight; one loose leaf caps it at Audited."""
    return t("events").groupBy("user_id").agg(F.when(F.bool_and(F.col("value") < 99), "Derived").otherwise("Audited").alias("outcome"))


@query("au1_audit", """with s as (select *, lag(event_type, 1, 'start') over (partition by user_id order by ts, event_id) as src from events), d as (select distinct src, event_type as dst from s where event_id % 3 = 0)
select s.event_id, d.src is not null as declared from s left join d on s.src = d.src and s.event_type = d.dst""")
def audit(t):
    """Whether each step's (source, target) is a row of the declared relation."""
    s = t("events").withColumn("src", F.lag("event_type", 1, "start").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    declared = s.filter("event_id % 3 = 0").select("src", F.col("event_type").alias("dst")).distinct().withColumn("declared", F.lit(True))
    return s.join(declared, (s["src"] == declared["src"]) & (s["event_type"] == F.col("dst")), "left").select("event_id", F.coalesce("declared", F.lit(False)).alias("declared"))


@query("au2_audit_journal", """with s as (select *, lag(event_type, 1, 'start') over (partition by user_id order by ts, event_id) as src from events), d as (select distinct src, event_type as dst from s where event_id % 3 = 0)
select user_id, case when bool_and(d.src is not null) then 'Audited' else 'Unknown' end as grade, count(*) as steps from s left join d on s.src = d.src and s.event_type = d.dst group by 1""")
def audit_journal(t):
    steps = audit(t).join(t("events").select("event_id", "user_id"), "event_id")
    return steps.groupBy("user_id").agg(F.when(F.bool_and("declared"), "Audited").otherwise("Unknown").alias("grade"), F.count("*").alias("steps"))


@query("sa1_labels", "select event_id, case when event_type in ('click', 'view') then 'Administrative' else 'Realizing' end as label from events")
def step_labels(t):
    return t("events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "Administrative").otherwise("Realizing").alias("label"))


@query("sm7_incremental_join", "select o_custkey, l_returnflag, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 5 <> 2 group by 1, 2")
def incremental_join(t):
    """A joined view kept by deltas: some orders go, some lines come."""
    o, l = t("orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), t("lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linenumber")
    n = lambda rows, s: rows.withColumn("n", F.lit(s).cast("long"))
    line = lambda rows, s: rows.groupBy("k", "l_returnflag").agg((F.count("*") * s).alias("n"))
    a, da = n(o, 1), n(o.filter("k % 5 = 2"), -1)
    b, db = line(l.filter("l_linenumber <> 2"), 1), line(l.filter("l_linenumber = 2"), 1)
    view = lambda rows: rows.groupBy("o_custkey", "l_returnflag").agg(F.sum("n").cast("long").alias("n"))
    before = view(a.join(b.withColumnRenamed("n", "m"), "k").withColumn("n", F.col("n") * F.col("m")))
    return apply_delta(before, view(join_delta(a, da, b, db, ["k"])))


@query("sm7_regroup", "select user_id, median(value) as mid from events where event_id % 10 <> 3 or user_id % 4 <> 0 group by 1")
def regroup_median(t):
    """A median can't be updated: the groups of the delta are computed anew, the others stay."""
    e = t("events")
    mid = lambda rows: rows.groupBy("user_id").agg(F.median("value").alias("mid"))
    gone = e.filter("event_id % 10 = 3 AND user_id % 4 = 0")
    return regroup(mid(e), e.filter("NOT (event_id % 10 = 3 AND user_id % 4 = 0)"), gone, ["user_id"], mid)


@query("sm8_footprints", "select * from (values ('load'), ('wait')) v(rule)")
def footprints(t):
    """The rules that a change of ``orders`` can reach; the others aren't planned."""
    rules = [Rule("assign", "assigned", frozenset({"lineitem"})), Rule("wait", "waiting", frozenset({"orders"}), frozenset({"assigned"})), Rule("load", "load", strict=frozenset({"waiting"}))]
    return t("region").sparkSession.createDataFrame([(r,) for r in touched(rules, {"orders"})], "rule string")


@query("pv1_support_count", "select c_nationkey, count(*) as supports, count(distinct c_mktsegment) as rules from customer group by 1")
def support_count(t):
    return t("customer").groupBy("c_nationkey").agg(F.count("*").alias("supports"), F.count_distinct("c_mktsegment").alias("rules"))


@query("pv2_why", "select o_custkey as fact, 'orders' as premise, cast(o_orderkey as varchar) as id from orders union all select o_custkey, 'lineitem', o_orderkey || ':' || l_linenumber from (select distinct o_custkey, o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R')")
def why(t):
    """The ground rows under each derived fact."""
    o = t("orders")
    lines = o.join(t("lineitem").filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = o.select(F.col("o_custkey").alias("fact"), F.lit("orders").alias("premise"), F.col("o_orderkey").cast("string").alias("id"))
    b = lines.select(F.col("o_custkey").alias("fact"), F.lit("lineitem").alias("premise"), F.concat("o_orderkey", F.lit(":"), "l_linenumber").alias("id")).distinct()
    return a.unionByName(b)


@query("pv3_whynot_prefix", """with a as (select * from orders where o_orderstatus = 'P'), b as (select * from a where o_totalprice > 1e12)
select cast(0 as int) as step, 'edge orders' as clause, (select count(*) from a) as left_rows union all select 1, 'when price', (select count(*) from b)""")
def whynot(t):
    """The first clause after which nothing is left."""
    steps = [
        ("edge orders", lambda p: p.edge(t("orders"), o_orderkey=V("o"), o_orderstatus="P", o_totalprice=V("price"))),
        ("when price", lambda p: p.when(F.col("price") > 1e12)), ("exists lines", lambda p: p.exists(t("lineitem"), l_orderkey=V("o"))),
    ]
    return t("region").sparkSession.createDataFrame(first_empty_prefix(Pattern(), steps), "step int, clause string, left_rows long")


@query("pv6_meta", "select * from (values ('assign', 0), ('wait', 1), ('load', 2)) v(rule, phase)")
def meta(t):
    rules = [Rule("assign", "assigned", frozenset({"lineitem"})), Rule("wait", "waiting", frozenset({"orders"}), frozenset({"assigned"})), Rule("load", "load", strict=frozenset({"waiting"}))]
    return t("region").sparkSession.createDataFrame(list(phases(rules).items()), "rule string, phase int")
