"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cents, checked, clamp, converted, keyed_draw, missing, one_of, skolem, with_unit

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


@query("sc1_checked_arith", """select event_id, case when event_id % 10 = 0 then null else event_id + 1 end as ok, case when event_id % 10 = 0 then 'Overflow' end as err from events""")
def checked_arith(t):
    a = F.when(F.col("event_id") % 10 == 0, F.lit(9223372036854775807)).otherwise(F.col("event_id"))
    return t("events").select("event_id", checked("add", a, F.lit(1)).alias("x")).select("event_id", "x.*")


@query("sc2_divide", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_discount, 0) as q, case when l_discount = 0 then 'DivisionByZero' end as err from lineitem")
def divide(t):
    x = checked("divide", F.col("l_extendedprice"), F.col("l_discount"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("x.ok").alias("q"), "x.err")


@query("sc4_structural_equality", "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where (a.l_partkey, a.l_suppkey) = (b.l_partkey, b.l_suppkey)")
def structural_equality(t):
    a, b = t("lineitem").alias("a"), t("lineitem").alias("b")
    same = F.struct("a.l_partkey", "a.l_suppkey").eqNullSafe(F.struct("b.l_partkey", "b.l_suppkey"))
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") == F.col("b.l_linenumber")) & same).agg(F.count("*").alias("n"))


@query("sc5_logic", "select o_orderkey, (o_orderstatus = 'F' and not o_totalprice > 100000) or o_custkey % 2 = 0 as x, -o_totalprice as negative from orders")
def logic(t):
    c = F.col
    return t("orders").select("o_orderkey", (((c("o_orderstatus") == "F") & ~(c("o_totalprice") > 100000)) | (c("o_custkey") % 2 == 0)).alias("x"), (-c("o_totalprice")).alias("negative"))


@query("sc6_match", "select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' when 'P' then 'partial' end as status from orders")
def match(t):
    return t("orders").select("o_orderkey", one_of(F.col("o_orderstatus"), {"F": F.lit("finished"), "O": F.lit("open"), "P": F.lit("partial")}).alias("status"))


@query("sc7_if", "select p_partkey, case when p_size > 25 then 'large' else 'small' end as kind from part")
def if_else(t):
    return t("part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"))


@query("sc8_option", "select event_id, case when value < 10 then 'Unknown' else 'Present' end as state, case when value >= 10 then value end as held from events")
def option(t):
    state = F.when(F.col("value") < 10, "Unknown").otherwise("Present")
    return t("events").select("event_id", missing(F.col("value"), state).alias("m")).select("event_id", "m.state", F.col("m.value").alias("held"))


@query("sc9_maths", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_quantity, 10.0), 40.0) as q, round(ln(l_extendedprice), 6) as l, floor(sqrt(l_quantity))::bigint as s from lineitem")
def maths(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clamp(F.col("l_quantity"), 10.0, 40.0).alias("q"), F.round(F.ln("l_extendedprice"), 6).alias("l"), F.floor(F.sqrt("l_quantity")).alias("s"))


@query("sc10_units", "select p_partkey, round(p_size / 1000.0::double, 9) as metres, round(p_size / 25.4::double, 9) as inches from part")
def units(t):
    """Sizes in millimetres by their metadata; converted by the table of units, which refuses other dimensions."""
    p = t("part").select("p_partkey", with_unit(F.col("p_size"), "size", "mm"))
    both = p.select("p_partkey", converted(p, "size", "m").alias("metres"), converted(p, "size", "in").alias("inches"))
    return both.select("p_partkey", F.round("metres", 9).alias("metres"), F.round("inches", 9).alias("inches"))


@query("sc11_money_alloc", """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_quantity) as bigint) as w from lineitem),
o as (select o_orderkey, cast(round(o_totalprice*100) as bigint) as total from orders),
j as (select l.*, total, sum(w) over (partition by l_orderkey) as all_w, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, w) as k from l join o on l_orderkey = o_orderkey),
c as (select *, cast(sum(w) over (partition by l_orderkey order by k rows unbounded preceding) as bigint) as upto from j)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast((total * upto) // all_w - (total * (upto - w)) // all_w as bigint) as share from c""")
def money_alloc(t):
    """An order's cents dealt to its lines by quantity; running shares, so that the parts add up exactly."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_quantity").cast("long").alias("w"))
    order = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), cents(F.col("o_totalprice")).alias("total"))
    within = W.partitionBy("l_orderkey")
    upto = F.sum("w").over(within.orderBy("l_linenumber", "l_partkey", "l_suppkey", "w").rowsBetween(W.unboundedPreceding, 0))
    j = lines.join(order, "l_orderkey").withColumns({"all_w": F.sum("w").over(within), "upto": upto})
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.expr("total * upto div all_w") - F.expr("total * (upto - w) div all_w")).alias("share"))


@query("sc12_regex", r"select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, len(regexp_extract_all(html, '<a ')) as links from pages")
def regex(t):
    return t("pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"))


@query("sc13_dates", "select o_orderkey, date_trunc('month', o_orderdate)::timestamp as month, year(o_orderdate)::int as y, (isodow(o_orderdate))::int as dow, (o_orderdate + interval 30 day)::timestamp as due from orders")
def dates(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), F.year(d).alias("y"), (F.weekday(d) + 1).alias("dow"), (d + F.expr("INTERVAL 30 DAY")).alias("due"))


@query("sc14_json", "select event_id, cast(props->>'$.k' as int) as k from events")
def json(t):
    return t("events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("sc15_arrays", "select doc_id, len(list_distinct(string_split(lower(text), ' '))) as distinct_words, list_max(list_transform(string_split(text, ' '), lambda x: length(x))) as longest from documents where text is not null")
def arrays(t):
    words = F.split("text", " ")
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), " "))).cast("long").alias("distinct_words"), F.array_max(F.transform(words, F.char_length)).cast("long").alias("longest"))


@query("sc16_sha256", "select page_id, sha256(coalesce(html, '')) as digest, md5(coalesce(url, '')) as url_md5 from pages")
def sha256(t):
    return t("pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.md5(F.coalesce("url", F.lit(""))).alias("url_md5"))


@query("sc17_durations", "select event_id, epoch_us(ts) // 1000000 - 1704067200 as since, (epoch_us(ts) // 1000000 - 1704067200) / 86400.0::double as days from events")
def durations(t):
    since = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return t("events").select("event_id", since.alias("since"), (since / F.lit(86400.0)).alias("days"))


@query("sc18_try_cast", "select o_orderkey, try_cast(left(o_orderpriority, 1) as int) as level, try_cast(o_orderpriority as int) as whole from orders")
def try_cast(t):
    return t("orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).try_cast("int").alias("level"), F.col("o_orderpriority").try_cast("int").alias("whole"))


@query("rc6_skolem", "select distinct sha256('visit|' || length(user_id::varchar) || ':' || user_id || '|' || length(event_type) || ':' || event_type) as node, user_id, event_type from events")
def skolem_nodes(t):
    return t("events").select(skolem("visit", F.col("user_id"), F.col("event_type")).alias("node"), "user_id", "event_type").distinct()


@query("si6_keyed_draw", "select event_id, cast('0x' || substr(sha256(cast(event_id as varchar) || ':7'), 1, 8) as bigint) as draw from events")
def draw(t):
    return t("events").select("event_id", keyed_draw(F.col("event_id"), 7).alias("draw"))


@query("uf1_pure_function", "select o_orderkey, cast(round(o_totalprice*100) as bigint) * 119 // 100 as gross from orders")
def pure_function(t):
    gross = lambda c: F.expr(f"{c} * 119 div 100")
    return t("orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("c")).select("o_orderkey", gross("c").alias("gross"))


@query("uf2_partial", "select event_id, case when value >= 20 then floor(value / 20)::bigint end as ok, case when value < 20 then 'too small' end as err from events")
def partial(t):
    return t("events").select("event_id", F.when(F.col("value") >= 20, F.floor(F.col("value") / 20)).alias("ok"), F.when(F.col("value") < 20, "too small").alias("err"))


@query("uf4_table_function", "select doc_id, unnest(string_split(coalesce(text, ''), ' ')) as word from documents")
def table_function(t):
    split = lambda rows: rows.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    return t("documents").transform(split)
