from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import checked, one_of, same_unit, skolem
from tidemark.operators import evaluation, frames, settlement
from tidemark.operators.patterns import Pattern, Var
from tidemark.operators.recursion import BudgetExceeded, terminal_states, transitive_closure
from tidemark.plans.incremental import apply_delta
from tidemark.plans.phases import NotStratified, Rule, phases, touched
from tidemark.sources.tables import ingest, read_files
from tidemark.streaming.watch import event_time, once_per_event, watch, windowed


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_patterns_refuse_what_has_no_meaning(spark):
    a, b = spark.range(3).withColumnRenamed("id", "x"), spark.range(3).withColumnRenamed("id", "y")
    with pytest.raises(ValueError, match="disconnected"):
        Pattern().edge(a, x=Var("x")).edge(b, y=Var("y"))
    with pytest.raises(ValueError, match="completeness"):
        Pattern().edge(a, x=Var("x")).without(a, complete=False, x=Var("x"))


def test_absence_keeps_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "x int")
    assert rows(Pattern().edge(a, x=Var("x")).without(b, x=Var("x")).rows) == [(2,), (None,)]


def test_asof_equals_brute_force(spark):
    rnd = random.Random(3)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(200))
    left = [(rnd.randrange(3), at(), k) for k in range(60)]
    right = [(rnd.randrange(3), at(), rnd.choice([None, k])) for k in range(40)]
    a, b = spark.createDataFrame(left, "g int, ts timestamp_ntz, k int"), spark.createDataFrame(right, "g int, ts timestamp_ntz, v int")
    got = {r["k"]: (r["v"], r["matched_at"]) for r in frames.asof_join(a, b, ["g"], "ts", ["v"]).collect()}
    for g, ts, k in left:
        near = [(t, -1 if v is None else v) for h, t, v in right if h == g and t <= ts]
        want = max(near, default=None)
        assert got[k] == ((None, None) if want is None else (None if want[1] == -1 else want[1], want[0]))


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(4)
    spans = [(s := rnd.randrange(1000), s + rnd.randrange(0, 400), k) for k in range(30)]
    points = [(rnd.randrange(1400), k) for k in range(80)]
    a = spark.createDataFrame(points, "at long, p int").withColumn("g", F.lit(1))
    b = spark.createDataFrame(spans, "s long, e long, q int").withColumn("g", F.lit(1))
    got = rows(frames.interval_join(a, b, ["g"], "at", "s", "e", 50).select("p", "q"))
    assert got == sorted(((p, q) for at, p in points for s, e, q in spans if s <= at < e), key=str)


def test_closure_of_a_cycle_and_its_budget(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)], "a int, b int")
    assert transitive_closure(ring, "a", "b").count() == 36
    with pytest.raises(BudgetExceeded):
        transitive_closure(ring, "a", "b", rounds=2)
    empty = ring.filter("false")
    assert transitive_closure(empty, "a", "b").count() == 0


def test_terminal_states(spark):
    g = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 6)], "s int, t int")
    assert rows(terminal_states(g, "s", "t")) == sorted([(1, 3, 2, False), (2, 3, 1, False), (3, 3, 0, False), (4, None, None, True), (5, None, None, True), (6, None, None, True)], key=str)


def test_phases():
    order = phases([Rule("r", "p", frozenset({"p", "q"})), Rule("s", "z", frozenset(), frozenset({"p"})), Rule("m", "mask", frozenset({"q"}), masks="q"), Rule("q", "q")])
    assert order["q"] < order["m"] < order["r"] < order["s"]
    with pytest.raises(NotStratified):
        phases([Rule("a", "p", strict=frozenset({"q"})), Rule("b", "q", strict=frozenset({"p"}))])
    rules = [Rule("a", "x", frozenset({"base"})), Rule("b", "y", frozenset({"x"})), *[Rule(f"i{k}", f"o{k}", frozenset({f"inert{k}"})) for k in range(64)]]
    assert touched(rules, {"base"}) == ["a", "b"]


def test_conflicts_have_no_live_row(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (4, None), (4, "c")], "k int, v string")
    good, bad = settlement.split_conflicts(e, ["k"], ["v"])
    assert [r["k"] for r in good.orderBy("k").collect()] == [1, 3] and [r["k"] for r in bad.orderBy("k").collect()] == [2, 4]


def test_strict_constraints_and_ingestion(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (3, 8), (4, 4), (4, 4)], "k int, v int")
    with pytest.raises(settlement.Rejected, match="positive: 1"):
        settlement.strict(df, {"positive": F.col("v") > 0})
    good, held = ingest(df, ["k"], {"positive": F.col("v") > 0})
    assert rows(good) == [(1, 5), (4, 4)]
    assert sorted((r["k"], r["findings"]) for r in held.collect()) == [(2, ["positive"]), (3, ["key_conflict"]), (3, ["key_conflict"])]


def test_scalars(spark):
    df = spark.createDataFrame([(9223372036854775807, 1), (1, 2), (None, 1)], "a long, b long")
    assert [tuple(r[0]) for r in df.select(checked("add", F.col("a"), F.col("b"))).collect()] == [(None, "Overflow"), (3, None), (None, None)]
    with pytest.raises(Exception, match="NoMatchingArm"):
        df.select(one_of(F.col("b").cast("string"), {"1": F.lit(0)})).collect()
    with pytest.raises(Exception, match="unbound key"):
        df.select(skolem("r", F.col("a"))).collect()
    with pytest.raises(TypeError):
        same_unit({"dimension": "length"}, {"dimension": "mass"})


def test_journal_chain_shows_a_changed_step(spark):
    steps = spark.createDataFrame([(1, k, f"s{k}") for k in range(5)], "j int, k int, p string")
    chain = lambda d: settlement.chain(d, ["j"], "k", F.col("p")).first()["chain"]
    assert chain(steps) == chain(steps.orderBy(F.desc("k")))
    assert chain(steps) != chain(steps.withColumn("p", F.when(F.col("k") == 2, "x").otherwise(F.col("p"))))


def test_auc_ties_and_one_label(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert evaluation.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(3.5 / 4)
    assert evaluation.roc_auc(df.filter("y = 1"), "s", "y").first()["auc"] is None


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    windows = windowed(once_per_event(event_time(stream, "ts", "60 days")), "ts", "1 day")
    query = windows.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    want = windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day")
    assert rows(spark.table("daily")) == rows(want)


def test_watch_folds_to_the_view(spark, tmp_path):
    changes = spark.createDataFrame([("a", 1), ("b", 1), ("a", -1), ("c", 2)], "x string, n long")
    for k in range(2):
        changes.filter(F.col("x") == "a" if k else F.col("x") != "a").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    initial = spark.createDataFrame([("z", 1)], "x string, n long")
    seen = []
    watch(stream, f"{tmp_path}/w", lambda rev, delta, view: seen.append((rev, rows(delta), rows(view))), initial).awaitTermination()
    assert len(seen) == 2 and seen[-1][2] == [("b", 1), ("c", 2), ("z", 1)]
    folded = initial
    for rev, _, view in seen:
        folded = apply_delta(folded, spark.read.parquet(f"{tmp_path}/w/delta-{rev}"))
        assert rows(folded) == view


def test_watch_goes_on_from_compacted_views(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([("a", 1), (f"x{k}", k)], "x string, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    watch(stream, f"{tmp_path}/w", lambda rev, delta, view: seen.append((rev, rows(view))), spark.createDataFrame([("z", 1)], "x string, n long"), every=2).awaitTermination()
    assert seen[-1] == (4, [("a", 5), ("x1", 1), ("x2", 2), ("x3", 3), ("x4", 4), ("z", 1)])
    assert sorted(p.name for p in (tmp_path / "w").glob("view-*")) == ["view-2", "view-4"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in ("json", "csv", "orc", "parquet"):
        df.write.format(kind).save(f"{tmp_path}/{kind}")
        assert rows(read_files(spark, f"{tmp_path}/{kind}", kind, df.schema)) == rows(df)
    with pytest.raises(ValueError):
        read_files(spark, f"{tmp_path}/csv", "csv")


def test_a_closure_deals_more_rows_to_more_tasks_and_meets_few_ends_by_broadcast(spark, monkeypatch):
    """Splits of the rounds' tables were grouped whole, and all rows with one end sorted in one task."""
    from tidemark.operators import recursion
    from tidemark.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)
    plans, write = [], recursion.materialize
    monkeypatch.setattr(recursion, "materialize", lambda df, name="rows": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    edges = spark.range(3000).selectExpr("id AS a", "-1 - id % 3 AS b").unionByName(spark.createDataFrame([(-1, -9), (-2, -9), (-3, -9)], "a long, b long"))
    got = transitive_closure(edges, "a", "b")
    assert got.count() == 6003 and got.filter("b = -9").count() == 3003
    dealt_out = [p for name, p in plans if name == "fixpoint" and "REPARTITION_BY_NUM" in p]
    assert dealt_out and all("hashpartitioning(a" in p and ", 7)" in p or ", 13)" in p for p in dealt_out)
    assert all("BroadcastHashJoin [b" in p for p in dealt_out)


def test_rounds_of_jumps_follow_the_longest_path_and_not_the_number_of_states(spark, monkeypatch):
    """4,000 states in runs of four took 12 rounds over all of them; three settle them, and one more shows that only cycles are left."""
    from tidemark.operators import recursion

    written, write = [], recursion.materialize
    monkeypatch.setattr(recursion, "materialize", lambda df, name="rows": written.append(name) or write(df, name))
    runs = spark.range(4000).selectExpr("id AS s", "IF(id % 4 = 3, NULL, id + 1) AS t")
    loop = spark.createDataFrame([(-1, -2), (-2, -1), (-3, -2)], "s long, t long")
    got = {r["s"]: (r["terminal"], r["steps"], r["cyclic"]) for r in terminal_states(runs.unionByName(loop), "s", "t").collect()}
    assert got == {k: (k | 3, 3 - k % 4, False) for k in range(4000)} | {k: (None, None, True) for k in (-1, -2, -3)}
    assert len(written) <= 5


def test_policy_history_groups_in_tasks_of_bounded_size(spark, monkeypatch):
    from conftest import DATA
    from tidemark import queries
    from tidemark.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)
    found = queries.queries()["jn10_policy_history"](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    tasks = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 3
