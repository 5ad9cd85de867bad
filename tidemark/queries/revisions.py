"""Claims, state and revisions; batch forms of the stream operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import skolem
from ..operators import settlement as S
from ..operators.frames import difference
from ..plans.incremental import apply_delta
from ..streaming import watch

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


def _log(t):
    """Events as a log: a claim per event, revisions by day; errors retract."""
    e = t("events")
    return e.select("event_id", "user_id", "event_type", "ts", F.dayofmonth("ts").alias("rev"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("sign"))


@query("tx1_ensure", "select distinct s_nationkey as id from supplier union select n_nationkey from nation where n_regionkey = 1")
def ensure(t):
    """Return or create: ids that aren't there yet are added once."""
    there = t("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    new = t("supplier").select(F.col("s_nationkey").alias("id")).distinct().join(there, "id", "left_anti")
    return there.unionByName(new)


@query("tx2_fresh", "select event_id, sha256('fresh|' || length(user_id::varchar) || ':' || user_id || '|' || length(event_id::varchar) || ':' || event_id) as id from events")
def fresh(t):
    return t("events").select("event_id", skolem("fresh", F.col("user_id"), F.col("event_id")).alias("id"))


@query("tx4_state_latest", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type <> 'error') where r = 1")
def state_latest(t):
    return S.latest(_log(t).filter("sign > 0"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("tx5_retract_support", "select user_id, cast(sum(case when event_type = 'error' then -1 else 1 end) as bigint) as supports from events group by 1 having sum(case when event_type = 'error' then -1 else 1 end) > 0")
def retract_support(t):
    return S.supported(_log(t), ["user_id"])


@query("tx6_supersede", "select event_id as new_id, lag(event_id) over (partition by user_id order by ts, event_id) as old_id from events qualify old_id is not null")
def supersede(t):
    """Lineage: which version each one replaced."""
    old = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select(F.col("event_id").alias("new_id"), old.alias("old_id")).filter("old_id IS NOT NULL")


@query("tm1_asof_revision", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where day(ts) <= 10) where r = 1")
def asof_revision(t):
    return S.as_of(_log(t), "rev", 10, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("tm2_bitemporal", """select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders join (select l_orderkey, max(l_shipdate) as known from lineitem group by 1) on l_orderkey = o_orderkey where known <= timestamp '1999-12-31' and o_orderdate <= timestamp '1999-06-30') where r = 1""")
def bitemporal(t):
    """Known by one day, valid on another: an order is known once its last line has been shipped."""
    shipped = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("known"))
    log = t("orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "known")
    known_at, valid_at = (F.expr(f"timestamp_ntz'{day}'") for day in ("1999-12-31", "1999-06-30"))
    return S.bitemporal(log, ["o_custkey"], "known", "o_orderdate", known_at, valid_at, ["o_orderkey"]).select("o_custkey", "o_orderkey")


FORK = "select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where day(ts) <= {0}) where r = 1"


@query("tm3_fork_diff", f"""with a as ({FORK.format(10)}), b as ({FORK.format(20)})
select user_id, event_type, cast(-1 as int) as op, cast(1 as bigint) as times from (select * from a except select * from b) union all select user_id, event_type, 1, 1 from (select * from b except select * from a)""")
def fork_diff(t):
    at = lambda rev: S.as_of(_log(t), "rev", rev, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")
    return difference(at(10), at(20))


@query("tm5_compaction", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def compaction(t):
    """Below a horizon only the newest version of each key is kept; later answers don't change."""
    log = _log(t)
    sealed = S.as_of(log, "rev", 15, ["user_id"], ["ts", "event_id"]).select(log.columns)
    return S.latest(sealed.unionByName(log.filter("rev > 15")), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("bd4_validity", "select event_id, lead(ts) over (partition by user_id order by ts, event_id) as valid_to from events")
def validity(t):
    return S.validity(t("events"), ["user_id"], "ts", ["event_id"]).select("event_id", "valid_to")


@query("sm1_watch_fold", "select user_id, event_type, count(*) as n from events group by 1, 2")
def watch_fold(t):
    """The snapshot half way, and the net change of the revisions after it, put together."""
    log = _log(t).select("rev", "user_id", "event_type")
    count = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return apply_delta(count(log.filter("rev <= 15")), count(log.filter("rev > 15")))


@query("sm3_tumbling", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1, 2")
def tumbling(t):
    return watch.windowed(t("events"), "ts", "1 day", None, "event_type")


@query("sm3_sliding", """select start, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from (select value, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as start from events) group by 1""")
def sliding(t):
    return watch.windowed(t("events"), "ts", "12 hours", "6 hours")


@query("sm4_session_ext", """with g as (select *, coalesce(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) >= 43200, true) as opens from events), s as (select *, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session(t):
    w = F.session_window("ts", "12 hours")
    return t("events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("sm5_late", "select event_id from events where ts < timestamp '2024-01-05'")
def late(t):
    return watch.on_time(t("events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", datetime(2024, 1, 5))[1].select("event_id")


@query("sm6_dedup", "select event_id from events")
def dedup(t):
    e = t("events")
    return watch.once_per_event(e.unionByName(e.filter("event_id % 3 = 0"))).select("event_id")


@query("sm9_coalesce", "select user_id, event_type, count(*) as n from events where day(ts) between 5 and 9 group by 1, 2")
def coalesce(t):
    """The net change over a range of revisions."""
    return _log(t).filter("rev BETWEEN 5 AND 9").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("sm10_sync", "select event_id, case when event_type = 'error' then 'retracted' else 'inserted' end as op, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def sync(t):
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t("events").select("event_id", F.when(F.col("event_type") == "error", "retracted").otherwise("inserted").alias("op"), seq.alias("seq"))


@query("bd1_lifecycle", """select o_custkey, o_orderkey, lag(o_orderstatus, 1, 'new') over w as was, o_orderstatus as becomes, (lag(o_orderstatus, 1, 'new') over w, o_orderstatus) in (('new', 'O'), ('O', 'P'), ('P', 'F'), ('O', 'F'), ('F', 'O')) as legal
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def lifecycle(t):
    was = F.lag("o_orderstatus", 1, "new").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    move = F.concat_ws(">", "was", "becomes")
    return t("orders").select("o_custkey", "o_orderkey", was.alias("was"), F.col("o_orderstatus").alias("becomes")).withColumn("legal", move.isin("new>O", "O>P", "P>F", "O>F", "F>O"))


@query("bd6_decision", """select o_custkey, case when sum(case when o_orderstatus = 'P' then 1 else 0 end) > 3 then 'call' when count(*) > 12 then 'thank' else 'wait' end as decision, count(*) as evidence from orders group by 1""")
def decision(t):
    partial = F.count_if(F.col("o_orderstatus") == "P")
    return t("orders").groupBy("o_custkey").agg(F.when(partial > 3, "call").when(F.count("*") > 12, "thank").otherwise("wait").alias("decision"), F.count("*").alias("evidence"))
