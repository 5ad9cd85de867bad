"""Claims, revisions, merges, frontiers, journals and policies."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import skolem
from ..operators import ledger as L
from ..operators.recursion import transitive_closure
from ..sources.tables import scratch_folder

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


def _folder(t, name: str) -> str:
    return f"{scratch_folder(t('region').sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"


KEYED = "sha256('{0}|' || {1})"


def _parts(*names: str) -> str:
    return " || '|' || ".join(f"length({n}::varchar) || ':' || {n}" for n in names)


@query("tx3_claim_ref", "select distinct " + KEYED.format("price", _parts("o_custkey", "o_orderkey", "o_orderstatus")) + " as claim, o_orderkey, o_orderstatus, o_custkey from orders")
def claim_ref(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return L.assert_claims(rows, "price", ["o_orderkey", "o_orderstatus"], "o_custkey").distinct()


@query("kc1_ground_conflict", """with k as (select l_suppkey, l_orderkey, l_linenumber, count(distinct l_partkey) > 1 as clash from lineitem group by 1, 2, 3)
select l_suppkey, count(*) as keys, count(*) filter (clash) as conflicts, case when bool_or(clash) then 'Refused' else 'Published' end as verdict from k group by 1""")
def ground_conflict(t):
    """Each supplier's lines as one revision: it is refused whole if a line has two parts."""
    return L.judge_revisions(t("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("tx7_expected_revision", "select event_id, case when row_number() over (partition by user_id, day(ts) order by ts, event_id) = 1 then 'Committed' else 'Stale' end as verdict from events")
def expected_revision(t):
    e = t("events").select("event_id", "user_id", "ts", F.dayofmonth("ts").alias("expected"))
    return L.expect_revision(e, ["user_id"], "expected", ["ts", "event_id"]).select("event_id", "verdict")


@query("tx7_snapshot", """with e as (select event_id, user_id, event_type, ts - cast(floor(value) as int) * interval 1 hour as began, ts as ended from events)
select event_id, case when lag(ended) over (partition by user_id, event_type order by ended, event_id) > began then 'Aborted' else 'Committed' end as verdict from e""")
def snapshot(t):
    """Writes of one key that overlap: the first committer wins."""
    e = t("events").withColumn("began", F.expr("ts - make_interval(0, 0, 0, 0, cast(floor(value) as int))"))
    return L.snapshot_conflicts(e, ["user_id", "event_type"], "began", "ts", ["event_id"]).select("event_id", "verdict")


@query("bd14_reject", "select user_id, any_value(event_type) as event_type, count(*) as n from events where event_type <> 'view' or event_id % 5 = 0 group by 1, day(ts) having count(distinct event_type) = 1")
def reject(t):
    e = t("events").filter("event_type <> 'view' OR event_id % 5 = 0").withColumn("day", F.dayofmonth("ts"))
    return L.merge(e, ["user_id", "day"], "event_type", "Reject").select("user_id", "event_type", "n")


@query("bd14_append", "select l_orderkey, l_linenumber, l_partkey, count(*) as n from lineitem group by all")
def append(t):
    return L.merge(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "Append")


@query("bd14_last_writer", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n from events group by 1")
def last_writer(t):
    return L.merge(t("events"), ["user_id"], "event_type", "LastWriterByDeclaredClock", ["ts", "event_id"])


@query("bd14_semilattice", "select l_orderkey, l_linenumber, max(l_shipdate) as l_shipdate, count(*) as n from lineitem group by 1, 2")
def semilattice(t):
    return L.merge(t("lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", "JoinSemilattice")


FRONTIER = """with f as (select distinct user_id, event_type from events where day(ts) <= 4), d as (select user_id, event_type, case when value < 30 then -1 else 1 end as op from events where day(ts) = 5),
w as (select user_id, event_type, count(*) filter (op < 0) as o, count(*) filter (op > 0) as i from d group by 1, 2), j as (select w.*, (f.user_id is not null)::int as h from w left join f using (user_id, event_type)),
v as (select user_id, count(*) filter (o > h or h - o + i > 1) as faults, count(*) as changes from j group by 1)"""


def _frontier(t):
    e = t("events").select("user_id", "event_type", "value", F.dayofmonth("ts").alias("day"))
    return L.frontier_delta(e.filter("day <= 4").select("user_id", "event_type").distinct(), e.filter("day = 5").withColumn("op", F.when(F.col("value") < 30, -1).otherwise(1)), ["user_id"], ["event_type"])


@query("kc6_verdicts", FRONTIER + " select user_id, faults, changes, case when faults > 0 then 'Refused' else 'Published' end as verdict from v")
def frontier_verdicts(t):
    return _frontier(t)[1]


@query("kc6_frontier", FRONTIER + """, g as (select j.* from j join v using (user_id) where faults = 0)
select user_id, event_type from f where (user_id, event_type) not in (select (user_id, event_type) from g where o > 0) union all select user_id, event_type from g where i > 0""")
def frontier_after(t):
    return _frontier(t)[0]


@query("snk1_journal", "select day(ts)::int as revision, event_id, user_id, event_type from events")
def journal(t):
    """Revisions appended one by one, the last of them twice, as after a lost acknowledgement."""
    folder = _folder(t, "journal")
    e = t("events").select(F.dayofmonth("ts").alias("day"), "event_id", "user_id", "event_type")
    for k in [*range(1, 32, 10), 31]:
        L.append_journal(e.filter(F.col("day").between(k, k + 9)), folder, k)
    return L.read_journal(e.sparkSession, folder).select(F.col("day").alias("revision"), "event_id", "user_id", "event_type")


@query("snk2_changes", """select event_id, user_id, event_type, ['inserted', 'retracted', 'masked', 'unmasked'][1 + event_id % 4] as op, nullif(value, 0) as value from events""")
def changes(t):
    folder = _folder(t, "changes")
    op = F.element_at(F.array(*map(F.lit, L.CHANGES)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = t("events").select("event_id", "user_id", "event_type", op.alias("op"), F.expr("nullif(value, 0)").alias("value"))
    L.write_changes(rows, folder)
    return L.read_changes(rows.sparkSession, folder, rows.schema)


@query("snk2_apply", """with o as (select distinct user_id, event_type from events where day(ts) <= 15), c as (select user_id, event_type, arg_max(['inserted', 'retracted', 'masked', 'unmasked'][1 + event_id % 4], (ts, event_id)) as op from events where day(ts) > 15 group by 1, 2)
select coalesce(o.user_id, c.user_id) as user_id, coalesce(o.event_type, c.event_type) as event_type from o full join c on o.user_id = c.user_id and o.event_type = c.event_type where coalesce(op in ('inserted', 'unmasked'), true)""")
def apply(t):
    op = F.element_at(F.array(*map(F.lit, L.CHANGES)), (F.col("event_id") % 4 + 1).cast("int"))
    e = t("events").withColumn("op", op).withColumn("day", F.dayofmonth("ts"))
    return L.apply_changes(e.filter("day <= 15"), e.filter("day > 15"), ["user_id", "event_type"], ["ts", "event_id"])


@query("fil7_edge_binding", "select " + KEYED.format("line", _parts("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) + " as edge, l_orderkey, count(*) as supports from lineitem where l_returnflag = 'R' group by all")
def edge_binding(t):
    """The edge itself as a value, by an id from the relation and its roles."""
    edge = skolem("line", *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    return t("lineitem").filter("l_returnflag = 'R'").groupBy(edge.alias("edge"), "l_orderkey").agg(F.count("*").alias("supports"))


@query("bd13_redact", "select sha256('s|' || c_custkey) as c_custkey, cast(null as varchar) as c_name, c_mktsegment from customer")
def redact(t):
    return L.redact(t("customer"), {"c_custkey": "pseudonym", "c_name": "hide", "c_nationkey": "drop", "c_acctbal": "drop"}, "s")


@query("pv7_scoped", "select c_custkey, c_nationkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def scoped(t):
    """A reader per region: it sees the clients of that region's nations."""
    grants = t("nation").select(F.concat(F.lit("desk-"), "n_regionkey").alias("reader"), F.col("n_nationkey").alias("c_nationkey"))
    return L.scoped(t("customer"), grants, ["c_nationkey"], "desk-2").select("c_custkey", "c_nationkey")


@query("bd11_outcomes", """with r as (select l_orderkey, min(l_linestatus) as a, max(l_linestatus) as b from lineitem group by 1) select o_orderkey, case when a = b then a else 'UnknownOutcome' end as outcome from orders left join r on l_orderkey = o_orderkey""")
def outcomes(t):
    """Orders as attempts, their lines as replies: no reply, and replies that differ, aren't known."""
    replies = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return L.outcomes(t("orders"), replies, ["o_orderkey"], "l_linestatus")


@query("bd2_satisfies", """with d as (select user_id, max(ts) as ts, count(*) as asked from events where event_type = 'view' group by 1), a as (select user_id, max(ts) as acted from events where event_type = 'purchase' group by 1)
select d.*, coalesce(acted >= ts, false) as satisfied from d left join a using (user_id)""")
def satisfies(t):
    e = t("events")
    done = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    return L.satisfied(e.filter("event_type = 'view'"), done, ["user_id"], "ts", "at")


@query("bd12_tier", """with recursive h as (select 'c' || c_custkey as a, 'n' || c_nationkey as b from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation), p as (select a, b from h union select p.a, h.b from p join h on p.b = h.a),
t as (select 'c' || c_custkey as node, (c_custkey % 4)::int as tier from customer union all select 'n' || n_nationkey, (n_nationkey % 4)::int from nation union all select 'r' || r_regionkey, (3 - r_regionkey % 2)::int from region)
select node, least(min(tier), min(low)) as tier from (select t.node, t.tier, coalesce(u.tier, t.tier) as low from t left join p on p.a = t.node left join t u on u.node = p.b) group by 1""")
def tier(t):
    """The reproducibility of a client's answer is that of the weakest thing it depends on."""
    name = lambda kind, key: F.concat(F.lit(kind), key)
    edges = t("customer").select(name("c", "c_custkey").alias("a"), name("n", "c_nationkey").alias("b")).unionByName(t("nation").select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b")))
    tiers = t("customer").select(name("c", "c_custkey").alias("node"), (F.col("c_custkey") % 4).cast("int").alias("tier"))
    tiers = tiers.unionByName(t("nation").select(name("n", "n_nationkey").alias("node"), (F.col("n_nationkey") % 4).cast("int").alias("tier")))
    tiers = tiers.unionByName(t("region").select(name("r", "r_regionkey").alias("node"), (3 - F.col("r_regionkey") % 2).cast("int").alias("tier")))
    return L.weakest(tiers, transitive_closure(edges, "a", "b"), "node", "tier", "a", "b")


@query("bd10_escalation", "select event_id, ((epoch(timestamp '2024-01-31') - epoch(ts) // 1 > 24 * 3600)::int + (epoch(timestamp '2024-01-31') - epoch(ts) // 1 > 240 * 3600)::int + (epoch(timestamp '2024-01-31') - epoch(ts) // 1 > 480 * 3600)::int)::int as level from events where event_type = 'error'")
def escalation(t):
    """Open tasks (errors) and the deadlines that each has passed."""
    return L.escalate(t("events").filter("event_type = 'error'"), F.expr("timestamp'2024-01-31 00:00:00'"), "ts", [24, 240, 480]).select("event_id", "level")


@query("bd3_propensity", """with p as (select event_type as action, count(*)::double / sum(count(*)) over () as share from events group by 1) select event_id, event_type as action, round(0.9::double * share + 0.02::double, 9) as propensity, round(1 / (0.9::double * share + 0.02::double), 6) as weight from events join p on action = event_type""")
def propensity(t):
    """Decisions with the probability at which the policy took them: the logged shares, a tenth of it explored evenly."""
    e = t("events")
    share = e.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"))
    share = share.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).drop("n")
    p = F.lit(0.9) * F.col("share") + F.lit(0.02)
    return e.join(share, F.col("event_type") == F.col("action")).select("event_id", "action", F.round(p, 9).alias("propensity"), F.round(1 / p, 6).alias("weight"))


@query("bd8_forall", "select o_custkey, bool_and(coalesce(o_orderstatus <> 'F' or o_totalprice > 20000, false)) as holds from orders group by 1")
def forall(t):
    """forall orders of a client: finished implies over 20,000."""
    implies = (F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 20000)
    return t("orders").groupBy("o_custkey").agg(F.bool_and(F.coalesce(implies, F.lit(False))).alias("holds"))


@query("tm4_clock", "with c as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as now) select now, (select count(*) from events where ts <= now) as known from c")
def clock(t):
    """A clock relation: what was known at each of its ticks. Events are counted per tick first, so none meets all ticks."""
    ticks = t("region").sparkSession.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-31', interval 1 day)) AS now")
    due = F.when(F.date_trunc("day", "ts") == F.col("ts"), F.col("ts")).otherwise(F.expr("date_trunc('day', ts) + interval 1 day")).cast("timestamp_ntz")
    per = t("events").groupBy(F.greatest(due, F.expr("timestamp_ntz'2024-01-01'")).alias("now")).agg(F.count("*").alias("n"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("now"))
    return ticks.join(per, "now", "left").select("now", upto.alias("known"))
