"""Recursion, paths and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.recursion import bounded_paths, least_fixpoint, terminal_states, transitive_closure

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = (build, sql)
        return build

    return add


#: What leads from an order to its lines' suppliers, and from a supplier to its nation and region: acyclic, over whole tables.
SUPPLY_SQL = "select distinct 'o' || l_orderkey as a, 's' || l_suppkey as b from lineitem union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation"


def _supply(t):
    lines = t("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    homes = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    return lines.unionByName(homes).unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")))


def _places(t):
    """region -> nation -> customer, as one edge relation of names."""
    top = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return top.unionByName(t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b")))


PLACES_SQL = "select 'r' || n_regionkey as a, 'n' || n_nationkey as b from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer"


@query("rc1_reach", f"with recursive h as ({SUPPLY_SQL}), p as (select a, b from h union select p.a, h.b from p join h on p.b = h.a) select * from p")
def reach(t):
    """Everything that each order, supplier and nation leads to."""
    return transitive_closure(_supply(t), "a", "b")


@query("rc2_path_plus", f"with recursive h as ({PLACES_SQL}), p as (select a, b from h union select p.a, h.b from p join h on p.b = h.a) select * from p")
def path_plus(t):
    return transitive_closure(_places(t), "a", "b")


@query("rc3_star", f"with recursive h as ({PLACES_SQL}), p as (select a, b from h union select p.a, h.b from p join h on p.b = h.a) select * from p union select a, a from h union select b, b from h")
def star(t):
    h = _places(t)
    ends = h.select("a").unionByName(h.select(F.col("b").alias("a"))).distinct()
    return transitive_closure(h, "a", "b").unionByName(ends.select("a", F.col("a").alias("b"))).distinct()


@query("rc4_bounded", f"with h as ({PLACES_SQL}) select distinct x.a, y.b, cast(2 as int) as hops from h x join h y on x.b = y.a")
def bounded(t):
    return bounded_paths(_places(t), "a", "b", 2, 2)


@query("rc5_alternation", """with recursive h as (select 'c' || o_custkey as a, 'o' || o_orderkey as b from orders where o_orderstatus = 'P' union select 'o' || l_orderkey, 'p' || l_partkey from lineitem where l_returnflag = 'R'),
p as (select a, b from h where a[1] = 'c' union select p.a, h.b from p join h on p.b = h.a) select * from p""")
def alternation(t):
    """placed or holds, once or more, from clients."""
    placed = t("orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"))
    holds = t("lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return transitive_closure(placed.unionByName(holds), "a", "b", placed.select("a"))


SUCC_SQL = "select user_id as s, case when user_id % 9 = 0 then null else (user_id * 7 + 3) % 150 + 1 end as t from (select distinct user_id from events)"


def _successors(t):
    s = F.col("s")
    return t("events").select(F.col("user_id").alias("s")).distinct().withColumn("t", F.when(s % 9 != 0, (s * 7 + 3) % 150 + 1))


@query("rc7_successors", f"with recursive g as ({SUCC_SQL}), p as (select s, t from g where t is not null union select p.s, g.t from p join g on p.t = g.s where g.t is not null) select * from p")
def successors(t):
    return transitive_closure(_successors(t).filter("t IS NOT NULL"), "s", "t")


@query("rc8_subclass", """with recursive sub as (select distinct p_type as a, split_part(p_type, ' ', 1) as b from part union select distinct split_part(p_type, ' ', 1), 'Thing' from part),
c as (select a, b from sub where a <> b union select c.a, s.b from c join sub s on c.b = s.a where s.a <> s.b),
inst as (select 'p' || p_partkey as x, p_type as a from part)
select x, a as class from inst union select x, c.b from inst join c on inst.a = c.a""")
def subclass(t):
    """Types of the closure of subclasses: the type chain is small, the instances join it once."""
    kind = F.substring_index("p_type", " ", 1)
    sub = t("part").select(F.col("p_type").alias("a"), kind.alias("b")).unionByName(t("part").select(kind.alias("a"), F.lit("Thing").alias("b"))).filter("a <> b")
    above = transitive_closure(sub, "a", "b")
    inst = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("x"), F.col("p_type").alias("a"))
    return inst.select("x", F.col("a").alias("class")).unionByName(inst.join(above, "a").select("x", F.col("b").alias("class"))).distinct()


@query("rc9_knn", """with q as (select vec_id as q, embedding::double[] as x from embeddings where vec_id % 100 = 0),
s as (select q, vec_id, round(list_cosine_similarity(x, embedding::double[]), 6) as cosine, row_number() over (partition by q order by round(list_cosine_similarity(x, embedding::double[]), 6) desc, vec_id) as r
from q, embeddings where vec_id <> q) select q, vec_id, cosine, cast(r as int) as rank from s where r <= 5""")
def knn(t):
    """The five nearest of each query vector. Queries are every hundredth row against all, a stated set."""
    from ..operators.neighbours import nearest

    e = t("embeddings")
    return nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@query("rc10_budget", f"with recursive h as ({PLACES_SQL}), p as (select a, b, 1 as k from h union select p.a, h.b, k + 1 from p join h on p.b = h.a) select cast(max(k) as int) as depth, count(*) as pairs from p")
def budget(t):
    """A recursion with a budget of rounds that suffices; a smaller one raises."""
    h = _places(t)
    step = lambda new: new.join(h.withColumnsRenamed({"a": "x", "b": "y"}), F.col("b") == F.col("x")).select("a", F.col("y").alias("b"), (F.col("k") + 1).alias("k"))
    return least_fixpoint(h.withColumn("k", F.lit(1)), step, rounds=4).agg(F.max("k").alias("depth"), F.count("*").alias("pairs"))


@query("sa2_hide_tau", f"""with recursive g as ({SUCC_SQL}), p as (select s, s as at, 0 as k from g union all select p.s, g.t, k + 1 from p join g on p.at = g.s where g.t is not null and k < 200)
select g.s, e.at as terminal, cast(e.k as bigint) as steps, (e.at is null) as cyclic from g left join (select p.s, p.at, p.k from p join g h on h.s = p.at where h.t is null) e on e.s = g.s""")
def hide_tau(t):
    """Administrative steps hidden: where each state settles, after how many; cyclic ones never do."""
    return terminal_states(_successors(t), "s", "t")


@query("sa3_lasso", f"""with recursive g as ({SUCC_SQL}), p as (select s, t from g where t is not null union select p.s, g.t from p join g on p.t = g.s where g.t is not null) select s from p where s = t""")
def lasso(t):
    """States that lie on a cycle."""
    return transitive_closure(_successors(t).filter("t IS NOT NULL"), "s", "t").filter("s = t").select("s")


@query("sa5_refines", f"""with recursive g as ({SUCC_SQL}), w as (select g.s as a, (g.s + 9) as b from g join g h on h.s = g.s + 9 union select x.t, y.t from w join g x on x.s = w.a join g y on y.s = w.b where x.t is not null and y.t is not null)
select w.a, w.b from w join g x on x.s = w.a join g y on y.s = w.b where (x.t is null) <> (y.t is null)""")
def refines(t):
    """Counterexamples of a product walk: pairs reached together of which only one can go on."""
    g = _successors(t)
    x, y = (g.select(F.col("s").alias(n), F.col("t").alias(f"{n}_next")) for n in ("a", "b"))
    seed = x.join(y, F.col("b") == F.col("a") + 9).select("a", "b")
    step = lambda new: new.join(x, "a").join(y, "b").filter("a_next IS NOT NULL AND b_next IS NOT NULL").select(F.col("a_next").alias("a"), F.col("b_next").alias("b"))
    walked = least_fixpoint(seed, step)
    return walked.join(x, "a").join(y, "b").filter("(a_next IS NULL) <> (b_next IS NULL)").select("a", "b")


@query("sa6_closure", f"""with recursive g as ({SUCC_SQL}), p as (select s, s as here from g union select p.s, g.t from p join g on p.here = g.s where g.t is not null) select s, bool_and(here % 11 <> 5) as safe from p group by s""")
def closure_safety(t):
    """Whether a predicate holds in every state that can be visited."""
    g = _successors(t)
    visited = transitive_closure(g.filter("t IS NOT NULL"), "s", "t").unionByName(g.select("s", F.col("s").alias("t")))
    return visited.groupBy("s").agg(F.bool_and(F.col("t") % 11 != 5).alias("safe"))
