"""Receipts, generators, witnesses, saturated runs and the standing of judgements."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import assurance as A
from .ledger import KEYED, _parts

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


STEPS = "select event_id, user_id, event_type as dst, lag(event_type, 1, 'start') over (partition by user_id order by ts, event_id) as src, ts, value from events"


def _steps(t):
    before = F.lag("event_type", 1, "start").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("event_id", "user_id", F.col("event_type").alias("dst"), before.alias("src"), "ts", "value")


@query("au3_receipts", "select event_id, case when event_id % 11 = 0 then 'Missing' when event_id % 7 = 0 then 'Forged' else 'Bound' end as verdict from events")
def receipts(t):
    """Some receipts come from another oracle, some are missing."""
    steps = t("events").select("event_id", F.lit("spark").alias("oracle"), "user_id", "event_type")
    oracle = F.when(F.col("event_id") % 7 == 0, "other").otherwise("spark")
    claimed = steps.filter("event_id % 11 <> 0").select("event_id", A.receipt(oracle, F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("receipt"))
    return A.verify_receipts(steps, claimed, ["event_id"], "oracle", ["event_id", "user_id", "event_type"]).select("event_id", "verdict")


@query("au3_receipt_ids", "select event_id, " + KEYED.format("receipt", "length('spark') || ':spark|' || " + _parts("event_id", "user_id")) + " as receipt from events")
def receipt_ids(t):
    return t("events").select("event_id", A.receipt(F.lit("spark"), F.col("event_id"), F.col("user_id")).alias("receipt"))


@query("au4_generators", f"""with s as ({STEPS}), x as (select distinct user_id % 5 as g, src, dst from s where value > 60)
select s.event_id, case when x.g is not null then 'Exact' when s.user_id % 5 in (1, 3) and s.src = s.dst then 'Diagonal' else 'Undeclared' end as verdict from s left join x on x.g = s.user_id % 5 and x.src = s.src and x.dst = s.dst""")
def generators(t):
    steps = _steps(t).withColumn("generator", F.col("user_id") % 5)
    diagonal = steps.filter("generator IN (1, 3)")
    return A.generator_verdicts(steps, steps.filter("value > 60"), diagonal).select("event_id", "verdict")


@query("au6_compose", f"with s as ({STEPS}) select a.src, b.dst, count(*) as n from s a join s b on a.dst = b.src where day(a.ts) <= 10 and day(b.ts) > 20 group by 1, 2")
def compose(t):
    """Steps of one period followed by steps of another: ways are counted, not listed."""
    s = _steps(t).withColumn("n", F.lit(1).cast("long"))
    return A.compose(s.filter("day(ts) <= 10"), s.filter("day(ts) > 20"))


@query("au6_tensor", f"""with s as ({STEPS}), a as (select user_id, src, dst, count(*) as n from s where dst = 'purchase' group by all), b as (select user_id, src, dst, count(*) as n from s where dst = 'signup' group by all)
select user_id, a.src as src_a, b.src as src_b, a.dst as dst_a, b.dst as dst_b, a.n * b.n as n from a join b using (user_id)""")
def tensor(t):
    s = _steps(t).withColumn("n", F.lit(1).cast("long"))
    return A.tensor(s.filter("dst = 'purchase'"), s.filter("dst = 'signup'"), ["user_id"])


RUN = """with s as (select *, event_type not in ('click', 'view') as shown, row_number() over (partition by user_id order by ts desc, event_id desc) as back, first_value(event_id) over (partition by user_id order by ts desc, event_id desc) as last from events),
r as (select event_id, last, cast(sum(case when back > 1 then shown::int else 0 end) over (partition by user_id order by ts desc, event_id desc) as bigint) as steps from s)"""


@query("sa4_run_saturated", RUN + " select event_id, case when steps <= 40 then last end as terminal, steps, case when steps > 40 then 'OverBudget' else 'Quiescent' end as outcome from r")
def saturated(t):
    """Each event leads to its user's next; clicks and views are hidden steps, and forty others may be seen."""
    e = t("events").select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"), (~F.col("event_type").isin("click", "view")).cast("long").alias("shown"))
    return A.run_saturated(e, "event_id", "next", "shown", 40)


@query("sa7_adequacy", "select l_orderkey, l_linenumber, case when count(distinct l_suppkey) > 1 then 'Ambiguous' else 'Defined' end as verdict from lineitem group by 1, 2 union all select o_orderkey, 0, 'Terminal' from orders where o_orderkey not in (select l_orderkey from lineitem)")
def adequacy(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    none = t("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(None).cast("long").alias("l_suppkey"))
    return A.adequacy(lines.unionByName(none), ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("gr2_sole_authority", "select l_partkey, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end as authority, case when count(distinct l_suppkey) = 1 then 'Sole' else 'Disputed' end as verdict from lineitem where l_returnflag = 'A' group by 1")
def sole_authority(t):
    return A.sole_authority(t("lineitem").filter("l_returnflag = 'A'"), ["l_partkey"], "l_suppkey")


@query("gr4_durable", "select l_orderkey, count(*) as pieces, count(*) filter (p_size > 40) as lost, case when count(*) filter (p_size > 40) > 0 then 'Lost' else 'Durable' end as verdict from lineitem join part on p_partkey = l_partkey group by 1")
def durable(t):
    """Parts as evidence of orders; those above a size were thrown away."""
    kept = t("part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return A.durable(t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi"), kept, ["l_orderkey"], ["l_partkey"])


@query("gr7_dependencies", "select distinct l_orderkey as judgement, o_custkey as rests_on, least(case when o_orderstatus = 'F' then 3 else 1 end, case when l_returnflag = 'R' then 1 else 2 end) as grade from lineitem join orders on o_orderkey = l_orderkey")
def dependencies(t):
    """A judgement on a line rests on that on its order; it has the lower of both grades."""
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("rests_on"), F.when(F.col("o_orderstatus") == "F", 3).otherwise(1).alias("below"))
    own = t("lineitem").select(F.col("l_orderkey").alias("judgement"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("own"))
    return own.join(o, F.col("judgement") == F.col("o_orderkey")).select("judgement", "rests_on", F.least("own", "below").alias("grade")).distinct()


@query("pv8_named_proofs", "select " + KEYED.format("serves", _parts("s_suppkey", "n_nationkey")) + " as proof, 'serves' as rule, 's_suppkey=' || s_suppkey || ',n_nationkey=' || n_nationkey as bindings, ['supplier:' || s_suppkey, 'nation:' || n_nationkey] as premises from supplier join nation on s_nationkey = n_nationkey")
def named_proofs(t):
    m = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return A.proofs(m, "serves", ["s_suppkey", "n_nationkey"], {"supplier": F.col("s_suppkey"), "nation": F.col("n_nationkey")})


@query("se3_successors", "select user_id as config, event_type as successor, count(*) as ways, min(event_id) as witness from events where value >= 10 group by 1, 2")
def successors(t):
    """succ(e): what the admissible candidates of a configuration lead to, each successor once with its least witness."""
    return t("events").filter("value >= 10").groupBy(F.col("user_id").alias("config"), F.col("event_type").alias("successor")).agg(F.count("*").alias("ways"), F.min("event_id").alias("witness"))


@query("ph2_pure_rule", "select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1")
def pure_rule(t):
    """A rule that is planned only because nothing in it depends on the clock, on chance or on partitions."""
    return A.pure(t("orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n")))
