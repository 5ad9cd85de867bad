"""Metrics, drift, splits, leakage, features, domains, effects and the life of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import keyed_draw
from ..operators import evaluation as E
from .evaluation import SCORED, _scored

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


def _draw(key: str, seed: int) -> str:
    return f"cast('0x' || substr(sha256(cast({key} as varchar) || ':{seed}'), 1, 8) as bigint)"


@query("ml5_pr_auc", f"""with s as ({SCORED}), g as (select score, sum(quality) as p, count(*) as n from s group by 1), u as (select p, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as seen from g)
select round(sum(p * tp::double / seen) / sum(p), 9) as pr_auc from u""")
def pr_auc(t):
    return E.pr_auc(_scored(t), "score", "quality").select(F.round("pr_auc", 9).alias("pr_auc"))


@query("ml5_log_loss", f"with s as (select quality, least(greatest(score, 1e-6::double), 1 - 1e-6::double) as p from ({SCORED})) select round(avg(-case when quality = 1 then ln(p) else ln(1 - p) end), 8) as log_loss from s")
def log_loss(t):
    return E.log_loss(_scored(t), "score", "quality").select(F.round("log_loss", 8).alias("log_loss"))


@query("ml5_confusion", f"""with s as ({SCORED}), h as (select unnest([0.2, 0.4, 0.6, 0.8]::double[]) as threshold)
select threshold, count(*) filter (score >= threshold and quality = 1) as tp, count(*) filter (score >= threshold and quality = 0) as fp, count(*) filter (score < threshold and quality = 1) as fn, count(*) filter (score < threshold and quality = 0) as tn from h, s group by 1""")
def confusion(t):
    return E.confusion(_scored(t), "score", "quality", [0.2, 0.4, 0.6, 0.8])


@query("ml5_costs", f"""with s as ({SCORED}), h as (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]::double[]) as threshold)
select threshold, count(*) filter (score >= threshold and quality = 0) * 2.5::double + count(*) filter (score < threshold and quality = 1) * 0.5::double as cost from h, s group by 1""")
def costs(t):
    return E.costs(_scored(t), "score", "quality", [0.1, 0.3, 0.5, 0.7, 0.9], 2.5, 0.5)


@query("ml4_grid", f"""with s as ({SCORED}), h as (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]::double[]) as threshold), c as (select threshold, {_draw("doc_id", 3)} % 3 as fold, count(*) filter (score >= threshold and quality = 0) + count(*) filter (score < threshold and quality = 1) as wrong, count(*) as n from h, s group by 1, 2)
select threshold, round(sum(wrong)::double / sum(n), 9) as error, rank() over (order by sum(wrong), threshold) as place from c group by 1""")
def grid(t):
    """A grid of one parameter, judged over three folds and ranked; the window runs over the grid."""
    from pyspark.sql import Window as W

    s = _scored(t).withColumn("fold", E.fold_of(F.col("doc_id"), 3, 3)).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))))
    wrong = F.count_if((F.col("score") >= F.col("threshold")) != (F.col("quality") == 1))
    folds = s.groupBy("threshold", "fold").agg(wrong.alias("wrong"), F.count("*").alias("n"))
    every = folds.groupBy("threshold").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))
    place = F.rank().over(W.orderBy("wrong", "threshold")).cast("long")
    return every.select("threshold", F.round(F.col("wrong") / F.col("n"), 9).alias("error"), place.alias("place"))


@query("ml8_drift_relations", """with l as (select day(ts) // 10 as period, value, (event_type = 'purchase')::int as label, least(value / 200, 1) as prediction from events),
m as (select period, unnest(['feature', 'label', 'prediction', 'calibration']) as measure, unnest([value, label, prediction, prediction - label]) as v from l),
p as (select period, measure, count(v) as n, cast(sum(cast(v as decimal(30, 9))) as double) / count(v) as mean from m group by 1, 2)
select cast(p.period as int) as period, p.measure, p.n, round(p.mean, 8) as mean, round(p.mean - b.mean, 8) as shift from p join p b on b.measure = p.measure and b.period = 0""")
def drift(t):
    prediction, label = F.least(F.col("value") / 200, F.lit(1.0)), (F.col("event_type") == "purchase").cast("double")
    period = F.expr("day(ts) div 10").cast("int")
    out = E.drift(t("events"), period, {"feature": F.col("value"), "label": label, "prediction": prediction, "calibration": prediction - label}, period == 0)
    return out.select("period", "measure", "n", F.round("mean", 8).alias("mean"), F.round("shift", 8).alias("shift"))


@query("ds2_stratified", f"""with d as (select doc_id, row_number() over (partition by lang order by {_draw("doc_id", 5)}, doc_id) as k, count(*) over (partition by lang) as n from documents)
select doc_id, case when k <= round(0.8::double * n) then 'train' when k <= round(0.9::double * n) then 'valid' else 'test' end as part from d""")
def stratified(t):
    return E.stratified(t("documents").select("doc_id", "lang"), "doc_id", ["lang"], 5, {"train": 0.8, "valid": 0.1, "test": 0.1}).select("doc_id", "part")


@query("ds2_grouped_folds", f"select event_id, user_id, {_draw('user_id', 4)} % 5 as fold from events")
def grouped_folds(t):
    """Five folds by user: all rows of a user are in one."""
    return t("events").select("event_id", "user_id", E.fold_of(F.col("user_id"), 4, 5).alias("fold"))


@query("ds2_k_folds", f"select doc_id, {_draw('doc_id', 6)} % 10 as fold from documents")
def k_folds(t):
    return t("documents").select("doc_id", E.fold_of(F.col("doc_id"), 6, 10).alias("fold"))


@query("ds2_temporal", "select o_orderkey, case when o_orderdate < timestamp '1999-01-01' then 'train' when o_orderdate < timestamp '2000-01-01' then 'valid' else 'test' end as part from orders")
def temporal(t):
    at = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.when(at < F.expr("timestamp_ntz'1999-01-01'"), "train").when(at < F.expr("timestamp_ntz'2000-01-01'"), "valid").otherwise("test").alias("part"))


@query("ds2_rolling_origin", """with o as (select unnest([timestamp '2024-01-10', timestamp '2024-01-15', timestamp '2024-01-20']) as origin) select origin, event_id, case when ts < origin then 'train' else 'test' end as part from events, o where ts < origin + interval 5 day""")
def rolling_origin(t):
    origins = [F.expr(f"timestamp_ntz'2024-01-{d}'") for d in (10, 15, 20)]
    return E.rolling_origins(t("events").select("event_id", "ts"), F.col("ts"), origins, F.expr("interval 5 days")).select("origin", "event_id", "part")


@query("ds2_bootstrap", f"""with b as (select doc_id, draw, {_draw("doc_id || '#' || draw", 9)} / 4294967296.0::double as u from documents, (select unnest([0, 1, 2]) as draw)),
c as (select *, (u >= 0.36787944117144233::double)::int + (u >= 0.7357588823428847::double)::int + (u >= 0.9196986029286058::double)::int + (u >= 0.9810118431238462::double)::int + (u >= 0.9963401531726563::double)::int + (u >= 0.9994058151824183::double)::int + (u >= 0.999916758850712::double)::int as times from b) select doc_id, draw::int as draw, times::int as times from c where times > 0""")
def bootstrap(t):
    return E.bootstrap(t("documents").select("doc_id"), "doc_id", 9, 3).select("doc_id", "draw", "times")


LEAK = f"""with r as (select event_id, user_id, ts, event_type, props, value, case when {_draw("event_id", 8)} % 10 < 7 then 'train' when {_draw("event_id", 8)} % 10 < 9 then 'test' end as part, case when event_id % 50 = 0 then ts + interval 1 hour else ts - interval 1 hour end as known, case when event_id % 40 = 0 then value else 0.5::double end as feature from events)"""


@query("ds3_leakage_kinds", LEAK + """, h as (select bool_or(part = 'train') as a, bool_or(part <> 'train') as b from r where part is not null group by user_id, value, props), c as (select bool_or(part = 'train') as a, bool_or(part <> 'train') as b from r where part is not null group by props), g as (select bool_or(part = 'train') as a, bool_or(part <> 'train') as b from r where part is not null group by user_id)
select 'duplicate_row' as kind, count(*) filter (a and b) as n from h union all select 'duplicate_content', count(*) filter (a and b) from c union all select 'shared_group', count(*) filter (a and b) from g
union all select 'future_train', count(*) from r where part = 'train' and ts >= (select min(ts) from r where part <> 'train') union all select 'late_feature', count(*) from r where known > ts
union all select 'target_copy', count(*) from r where feature = value union all select 'unassigned', count(*) from r where part is null union all select 'repeated_key', 0""")
def leakage_kinds(t):
    draw = keyed_draw(F.col("event_id"), 8) % 10
    r = t("events").select("event_id", "user_id", "ts", "props", "value", F.when(draw < 7, "train").when(draw < 9, "test").alias("part"))
    known = F.when(F.col("event_id") % 50 == 0, F.expr("ts + interval 1 hour")).otherwise(F.expr("ts - interval 1 hour"))
    r = r.withColumn("known", known).withColumn("feature", F.when(F.col("event_id") % 40 == 0, F.col("value")).otherwise(0.5))
    return E.leakage(r, "part", "event_id", "user_id", F.col("props"), "ts", "known", "value", "feature")


@query("fe2_feature_values", """with f as (select user_id, ts, unnest(['value', 'hour', 'is_error']) as feature, unnest([value, hour(ts)::double, (event_type = 'error')::int::double]) as value from events) select feature, 'v1' as version, user_id as entity, ts as observed_at, value from f""")
def feature_values(t):
    features = {"value": F.col("value"), "hour": F.hour("ts"), "is_error": (F.col("event_type") == "error").cast("int")}
    return E.feature_values(t("events"), "user_id", "ts", features, "v1").select("feature", "version", "entity", "observed_at", "value")


@query("bd4_domain", """with f as (select min(l_quantity) as a, max(l_quantity) as b, min(l_extendedprice) as c, max(l_extendedprice) as d from lineitem where l_returnflag = 'N' and l_quantity < 40)
select l_orderkey, l_linenumber, l_partkey, case when l_quantity between a - 0.05::double * (b - a) and b + 0.05::double * (b - a) and l_extendedprice between c - 0.05::double * (d - c) and d + 0.05::double * (d - c) then 'InDomain' else 'OutOfDomain' end as status from lineitem, f""")
def domain(t):
    lines = t("lineitem")
    return E.domain_status(lines.filter("l_returnflag = 'N' AND l_quantity < 40"), lines, ["l_quantity", "l_extendedprice"], 0.05).select("l_orderkey", "l_linenumber", "l_partkey", "status")


@query("bd5_health", """with d as (select day(ts)::int as day, count(*) as n, avg((event_type = 'error')::int) as rate from events group by 1), b as (select avg((event_type = 'error')::int) as base from events where day(ts) <= 5)
select day, n, case when abs(rate - base) > 0.05 then 'Degraded' else 'Healthy' end as health from d, b""")
def health(t):
    """A model is healthy on the days on which its rate stays near that of the first days."""
    e, bad = t("events").withColumn("day", F.dayofmonth("ts")), (F.col("event_type") == "error").cast("int")
    base = e.filter("day <= 5").agg(F.avg(bad).alias("base"))
    per = e.groupBy("day").agg(F.count("*").alias("n"), F.avg(bad).alias("rate"))
    return per.crossJoin(F.broadcast(base)).select("day", "n", F.when(F.abs(F.col("rate") - F.col("base")) > 0.05, "Degraded").otherwise("Healthy").alias("health"))


@query("bd7_do_effect", """with a as (select l_linestatus, l_linenumber, count(*) as n, count(*) filter (l_discount > 0.05) as n1, cast(sum(cast(l_extendedprice as decimal(20, 4))) filter (l_discount > 0.05) as double) as y1, cast(sum(cast(l_extendedprice as decimal(20, 4))) filter (not l_discount > 0.05) as double) as y0 from lineitem group by 1, 2),
d as (select *, case when n1 > 0 and n1 < n then y1 / n1 - y0 / (n - n1) end as diff from a) select round(sum(n * diff) / sum(n) filter (diff is not null), 4) as effect, round(sum(case when diff is null then n else 0 end)::double / sum(n), 9) as unidentified from d""")
def do_effect(t):
    """What a discount above 0.05 does to the price, within lines of like status and place."""
    rows = t("lineitem").withColumn("treated", F.col("l_discount") > 0.05)
    out = E.adjusted_effect(rows, "treated", "l_extendedprice", ["l_linestatus", "l_linenumber"])
    return out.select(F.round("effect", 4).alias("effect"), F.round("unidentified", 9).alias("unidentified"))


@query("ml10_lifecycle", """with m as (select user_id, event_id, ts, case event_type when 'signup' then 'registered' when 'view' then 'shadow' when 'purchase' then 'live' else 'retired' end as stage from events), w as (select *, lag(stage) over (partition by user_id order by ts, event_id) as was from m)
select event_id, stage, was, case when was is null then stage = 'registered' else (was || '>' || stage) in ('registered>shadow', 'registered>retired', 'shadow>live', 'shadow>retired', 'live>shadow', 'live>retired') end as legal from w""")
def lifecycle(t):
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "registered").when(kind == "view", "shadow").when(kind == "purchase", "live").otherwise("retired")
    return E.lifecycle(t("events").withColumn("stage", stage), ["user_id"], ["ts", "event_id"], "stage").select("event_id", "stage", "was", "legal")


@query("ml10_predictions", """with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem where l_returnflag <> 'R')
select l_orderkey, l_linenumber, l_partkey, 'price-1' as model, sha256('price-1|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey) as prediction, round(a * l_quantity + b, 2) as value from lineitem, f where l_returnflag = 'R'""")
def predictions(t):
    """A prediction as a record: which model, of which row, under an id that a second run repeats."""
    x = ("l_extendedprice", "l_quantity")
    fitted = t("lineitem").filter("l_returnflag <> 'R'").agg(F.regr_slope(*x).alias("a"), F.regr_intercept(*x).alias("b"))
    rows = t("lineitem").filter("l_returnflag = 'R'").crossJoin(F.broadcast(fitted))
    name = F.sha2(F.concat_ws("|", F.lit("price-1"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]), 256)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("price-1").alias("model"), name.alias("prediction"), F.round(F.col("a") * F.col("l_quantity") + F.col("b"), 2).alias("value"))
