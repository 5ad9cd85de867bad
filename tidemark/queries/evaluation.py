"""Data quality, recipes, features, splits, evaluation and simulation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import keyed_draw
from ..operators import evaluation as E
from ..operators.frames import asof_join
from ..sources.tables import ingest

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


PROFILE = "select '{0}' as \"column\", count(*) as n, count(*) - count({0}) as n_null, count(distinct {0}) as n_distinct, min({0})::double as low, max({0})::double as high, round(cast(sum(cast({0} as decimal(20,4))) as double) / count({0}), 4) as mean from lineitem"


@query("dq1_profile", " union all ".join(PROFILE.format(c) for c in ("l_quantity", "l_discount", "l_tax")))
def profile(t):
    rows = E.profile(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])
    total = t("lineitem").agg(*[F.sum(F.col(c).cast("decimal(20,4)")).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    exact = total.unpivot([], ["l_quantity", "l_discount", "l_tax"], "column", "total")
    return rows.drop("mean").join(F.broadcast(exact), "column").select("*", F.round(F.col("total") / (F.col("n") - F.col("n_null")), 4).alias("mean")).drop("total")


@query("dq2_missing", "select case when value < 5 then 'Invalid' when value < 10 then 'NotObserved' else 'Present' end as state, count(*) as n from events group by 1")
def missing(t):
    v = F.col("value")
    return t("events").groupBy(F.when(v < 5, "Invalid").when(v < 10, "NotObserved").otherwise("Present").alias("state")).agg(F.count("*").alias("n"))


@query("dq3_hist", "select case when value < 0 then 0 when value >= 100 then 11 else floor(value * 10 / 100)::bigint + 1 end as bin, count(*) as n from events where value is not null group by 1")
def hist(t):
    return E.histogram(t("events"), "value", 0.0, 100.0, 10)


@query("dq4_outlier", """with m as (select event_type, avg(value) as a, stddev_samp(value) as s from events group by 1) select event_id, e.event_type, value from events e join m using (event_type) where abs(value - a) > 2.5 * s""")
def outlier(t):
    return E.outliers(t("events"), ["event_type"], "value", 2.5).select("event_id", "event_type", "value")


@query("dq5_exact_dup", "select min(doc_id) as first_id, count(*) as copies from documents where text is not null group by text having count(*) > 1")
def exact_dup(t):
    """Texts are compared by a 256-bit hash, so that only hashes are shuffled."""
    digest = F.sha2("text", 256)
    return t("documents").filter("text IS NOT NULL").groupBy(digest.alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("h")


@query("dq6_coverage", """with s as (select distinct source from documents), l as (select distinct lang from documents), d as (select source, lang, count(*) as n, count(*) filter (n_chars > 2000) as long from documents group by all)
select s.source, l.lang, coalesce(n, 0) as n, coalesce(long, 0) as long, n is not null as seen from s cross join l left join d on d.source is not distinct from s.source and d.lang is not distinct from l.lang""")
def coverage(t):
    """Every pair of a source and a language, those without a document too. Both lists are short."""
    seen = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"))
    pairs = seen.select("source").distinct().crossJoin(seen.select("lang").distinct())
    held = seen.withColumnsRenamed({"source": "_s", "lang": "_l"})
    both = pairs.join(held, F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")), "left")
    return both.select("source", "lang", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("long", F.lit(0)).alias("long"), F.col("n").isNotNull().alias("seen"))


@query("dq6_psi", """with a as (select event_type as k, count(*) as na from events where day(ts) <= 15 group by 1), b as (select event_type as k, count(*) as nb from events where day(ts) > 15 group by 1),
j as (select coalesce(a.k, b.k) as k, coalesce(na, 0) as na, coalesce(nb, 0) as nb from a full join b on a.k = b.k),
s as (select k, (na + 0.5::double) / (sum(na) over () + 0.5::double * count(*) over ()) as a, (nb + 0.5::double) / (sum(nb) over () + 0.5::double * count(*) over ()) as b from j)
select k as event_type, round(a, 9) as a, round(b, 9) as b, round((b - a) * ln(b / a), 9) as psi from s""")
def psi(t):
    e = t("events")
    found = E.stability_index(e.filter("day(ts) <= 15"), e.filter("day(ts) > 15"), "event_type")
    return found.select("event_type", *[F.round(c, 9).alias(c) for c in ("a", "b", "psi")])


@query("re1_clean", r"select page_id, lower(trim(regexp_replace(coalesce(url, ''), '[?#].*', ''))) as url, length(coalesce(html, '')) as n from pages")
def clean(t):
    return t("pages").select("page_id", F.lower(F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*", ""))).alias("url"), F.char_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))


@query("re2_quarantine", """select o_orderkey, case when o_totalprice >= 5000 then '' else 'price' end || case when o_orderstatus <> 'P' then '' else 'status' end as findings from orders where not (o_totalprice >= 5000 and o_orderstatus <> 'P')""")
def quarantine(t):
    _, held = ingest(t("orders"), ["o_orderkey"], {"price": F.col("o_totalprice") >= 5000, "status": F.col("o_orderstatus") != "P"})
    return held.select("o_orderkey", F.array_join("findings", "").alias("findings"))


@query("re3_scale_clip_bin", """with f as (select min(p_size) as lo, max(p_size) as hi, quantile_cont(p_size, 0.1) as a, quantile_cont(p_size, 0.9) as b from part where p_partkey % 3 <> 0)
select p_partkey, least(greatest(p_size, a), b)::double as clipped, round((p_size - lo)::double / (hi - lo), 9) as scaled, least(greatest(floor((p_size - lo)::double * 5 / (hi - lo)), 0), 4)::bigint as bin from part, f""")
def scale_clip_bin(t):
    """Range, quantiles and bins fitted on the training rows, applied to all."""
    p = t("part")
    out = E.apply_scaling(E.fit_scaling(p.filter("p_partkey % 3 <> 0"), "p_size", 0.1, 0.9), p, "p_size", 5)
    return out.select("p_partkey", "clipped", F.round("scaled", 9).alias("scaled"), "bin")


@query("re4_fit_apply", """with f as (select avg(value) as a, stddev_pop(value) as s from events where day(ts) <= 20) select event_id, round((value - a) / s, 6) as z from events, f where day(ts) > 20""")
def fit_apply(t):
    e = t("events")
    return E.standardise(e.filter("day(ts) <= 20"), e.filter("day(ts) > 20"), "value", "z").select("event_id", F.round("z", 6).alias("z"))


@query("re5_reconcile", """select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and abs(cast(round(c_acctbal) as bigint) - cast(round(s_acctbal) as bigint)) <= 5""")
def reconcile(t):
    """Candidates within a block, by nearness of a value; buckets two wide, so the join has an equality."""
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.round("c_acctbal").cast("long").alias("x"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.round("s_acctbal").cast("long").alias("y"))
    c = c.withColumn("cell", F.floor(F.col("x") / 10))
    s = s.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("y") - 5) / 10), F.floor((F.col("y") + 5) / 10)))))
    return c.join(s, ["n", "cell"]).filter(F.abs(F.col("x") - F.col("y")) <= 5).select("c_custkey", "s_suppkey")


@query("fe1_point_in_time", """with l as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2), f as (select user_id, ts, max(value) as last_value from events where event_type = 'click' group by 1, 2)
select l.event_id, f.last_value from l asof left join f on l.user_id = f.user_id and l.ts >= f.ts""")
def point_in_time(t):
    """The feature as it was known at the time of the label, never later."""
    e = t("events")
    label = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    feature = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return asof_join(label, feature, ["user_id"], "ts", ["last_value"]).select("event_id", "last_value")


@query("ds1_identity", """with r as (select lang, sha256(cast(doc_id as varchar) || ':' || coalesce(text, '')) as h from documents), p as (select *, hash_part from (select *, substr(h, 1, 3) as hash_part from r)),
b as (select lang, hash_part, count(*) as n, sum(cast('0x' || substr(h, 1, 12) as bigint)) as s1, sum(cast('0x' || substr(h, 13, 12) as bigint)) as s2, sum(cast('0x' || substr(h, 25, 12) as bigint)) as s3 from p group by 1, 2)
select lang, cast(sum(n) as bigint) as n, sha256(string_agg(hash_part || ':' || n || ':' || s1 || ':' || s2 || ':' || s3, ',' order by hash_part)) as digest from b group by 1""")
def identity(t):
    return E.dataset_digest(t("documents"), ["lang"], F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))))


@query("ds2_splits", """with d as (select doc_id, cast('0x' || substr(sha256(cast(doc_id as varchar) || ':11'), 1, 8) as bigint) as x from documents) select doc_id, case when x < 3435973836 then 'train' when x < 3865470566 then 'valid' else 'test' end as part from d""")
def splits(t):
    return t("documents").select("doc_id", E.split_of(F.col("doc_id"), 11, {"train": 0.8, "valid": 0.1, "test": 0.1}).alias("part"))


@query("ds3_leakage", """with d as (select text, cast('0x' || substr(sha256(cast(doc_id as varchar) || ':11'), 1, 8) as bigint) < 3435973836 as train from documents where text is not null) select sha256(text) as digest, count(*) as copies from d group by 1 having bool_or(train) and bool_or(not train)""")
def leakage(t):
    """Texts that stand in the training part and in another."""
    train = keyed_draw(F.col("doc_id"), 11) < 3435973836
    d = t("documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), train.alias("train"))
    return d.groupBy("digest").agg(F.count("*").alias("copies"), F.bool_or("train").alias("a"), F.bool_or(~F.col("train")).alias("b")).filter("a AND b").select("digest", "copies")


@query("fc1_factor_levels", "select event_id, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as level, event_type not in ('view', 'click', 'purchase') as unknown from events")
def factor_levels(t):
    """Declared levels; a value outside them is a finding, not a new level."""
    levels = F.create_map(F.lit("view"), F.lit(1), F.lit("click"), F.lit(2), F.lit("purchase"), F.lit(3))
    return t("events").select("event_id", levels[F.col("event_type")].alias("level")).withColumn("unknown", F.col("level").isNull())


SCORED = "select doc_id, quality, toxic, round(least(n_chars, 4000) / 4000.0::double, 2) as score, lang from labels join documents using (doc_id)"


def _scored(t):
    score = F.round(F.least(F.col("n_chars"), F.lit(4000)) / F.lit(4000.0), 2)
    return t("labels").join(t("documents"), "doc_id").select("doc_id", "quality", "toxic", score.alias("score"), "lang")


AUC = "select {0} round((sum(r) filter (quality = 1) - count(*) filter (quality = 1) * (count(*) filter (quality = 1) + 1) / 2.0::double) / (count(*) filter (quality = 1) * count(*) filter (quality = 0)), 9) as auc from (select *, rank() over (partition by {1} order by score) + (count(*) over (partition by {1}, score) - 1) / 2.0::double as r from s) {2}"


@query("ml5_auc", f"with s as ({SCORED}) " + AUC.format("", "1", ""))
def auc(t):
    return E.roc_auc(_scored(t), "score", "quality").select(F.round("auc", 9).alias("auc"))


@query("ml7_subgroup", f"with s as ({SCORED}) select * from (" + AUC.format("lang,", "lang", "group by lang") + ") where auc is not null and not isnan(auc)")
def subgroup(t):
    return E.roc_auc(_scored(t), "score", "quality", ["lang"]).filter("auc IS NOT NULL").select("lang", F.round("auc", 9).alias("auc"))


@query("ml5_brier", f"with s as ({SCORED}) select round(avg((score - quality) * (score - quality)), 9) as brier, count(*) as n from s")
def brier(t):
    d = F.col("score") - F.col("quality")
    return _scored(t).agg(F.round(F.avg(d * d), 9).alias("brier"), F.count("*").alias("n"))


@query("ml5_ece", f"with s as ({SCORED}), b as (select least(floor(score * 10), 9)::bigint as bin, count(*) as n, avg(score) as m, avg(quality) as q from s group by 1) select round(sum(n * abs(m - q)) / sum(n), 9) as ece from b")
def ece(t):
    bins = E.calibration(_scored(t), "score", "quality", 10)
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("score") - F.col("share"))) / F.sum("n"), 9).alias("ece"))


@query("ml6_threshold", f"with s as ({SCORED}), h as (select unnest([0.2, 0.4, 0.6, 0.8]::double[]) as threshold) select threshold, count(*) filter (score >= threshold and quality = 0) * 5 + count(*) filter (score < threshold and quality = 1) as cost from h, s group by 1")
def threshold(t):
    """Costs at declared thresholds: each row is counted under all of them in one pass."""
    s = _scored(t).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])))
    wrong = F.when((F.col("score") >= F.col("threshold")) & (F.col("quality") == 0), 5).when((F.col("score") < F.col("threshold")) & (F.col("quality") == 1), 1).otherwise(0)
    return s.groupBy("threshold").agg(F.sum(wrong).alias("cost"))


@query("ml8_drift", "select cast(day(ts) // 10 as int) as period, cast(sum(cast(value as decimal(18,4))) as double) / count(*) as mean, count(*) as n from events group by 1")
def drift(t):
    return t("events").groupBy(F.expr("day(ts) div 10").cast("int").alias("period")).agg((F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))


@query("ml9_ips", "with p as (select event_type, count(*) / (select count(*) from events)::double as propensity from events group by 1) select round(avg(case when e.event_type = 'view' then value / propensity else 0 end), 6) as estimate from events e join p using (event_type)")
def ips(t):
    """The value of always taking one action, by inverse propensities of the logged ones."""
    e = t("events")
    p = e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(e.agg(F.count("*").alias("all")))).select("event_type", (F.col("n") / F.col("all")).alias("propensity"))
    return e.join(p, "event_type").agg(F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value") / F.col("propensity")).otherwise(0.0)), 6).alias("estimate"))


@query("ml1_linear", "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")
def linear(t):
    x = ("l_extendedprice", "l_quantity")
    return t("lineitem").agg(F.round(F.regr_slope(*x), 4).alias("slope"), F.round(F.regr_intercept(*x), 3).alias("intercept"), F.round(F.regr_r2(*x), 6).alias("r2"))


@query("ml2_cluster")
def cluster(t):
    """k-means with fixed seeds over two columns; the model comes from the library that Spark brings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="features").transform(t("part"))
    return KMeans(k=4, seed=5, maxIter=10).fit(rows).transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query("si4_euler", """with recursive s as (select c_custkey, 0 as k, 100.0::double as x from customer union all select c_custkey, k + 1, x + 0.1::double * (0.5::double * (c_custkey % 7) - 0.3::double * x) from s where k < 40) select c_custkey, round(x, 6) as x from s where k = 40""")
def euler(t):
    """Stocks and flows of every client: forty steps of one expression, inside the row."""
    flow = F.lit(0.5) * (F.col("c_custkey") % 7)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(100.0), lambda x, _: x + F.lit(0.1) * (flow - F.lit(0.3) * x))
    return t("customer").select("c_custkey", F.round(x, 6).alias("x"))


@query("si7_queue", """with recursive e as (select user_id, epoch_us(ts) // 1000000 as came, cast(floor(value) as bigint) * 600 as work, row_number() over (partition by user_id order by ts, event_id) as k from events),
q as (select user_id, k, came, work, 0::bigint as wait from e where k = 1 union all select e.user_id, e.k, e.came, e.work, greatest(0, q.wait + q.work - (e.came - q.came))::bigint from q join e on e.user_id = q.user_id and e.k = q.k + 1)
select user_id, max(wait) as longest, cast(sum(wait) as bigint) as total from q group by 1""")
def queue(t):
    """Waiting times in a queue per user: with the sums of work less gaps, a wait is the height above the lowest sum so far."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").select("user_id", "ts", "event_id", at.alias("at"), (F.floor("value") * 600).alias("work"))
    step = F.coalesce(F.lag("work").over(w) - (F.col("at") - F.lag("at").over(w)), F.lit(0))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    walk = e.withColumn("step", step).withColumn("sum", F.sum("step").over(upto)).withColumn("wait", F.col("sum") - F.min("sum").over(upto))
    return walk.groupBy("user_id").agg(F.max("wait").alias("longest"), F.sum("wait").alias("total"))


@query("contamination", r"""with b as (select item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' as x from benchmark where regexp_matches(lower(text), '[a-z0-9]')),
d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' as y from documents) select d.doc_id, b.item_id from d join b on contains(d.y, b.x)""")
def contamination(t):
    """Documents that hold all words of a benchmark item in a row, found by the hash of its first words."""
    return E.contains_item(t("documents"), t("benchmark"))
