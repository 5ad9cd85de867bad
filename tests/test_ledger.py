from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import converted, skolem, with_unit
from tidemark.operators import assurance, evaluation, frames, ledger, settlement
from tidemark.operators.recursion import BudgetExceeded, least_fixpoint, terminal_states


def test_ground_conflict_refuses_the_revision(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, ledger.ground(rows, ["k"], ["v"]).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(settlement.Rejected):
        ledger.ground(rows.unionByName(spark.createDataFrame([(2, "c")], "k int, v string")), ["k"], ["v"])


def test_frontier_delta_is_whole_or_nothing(spark):
    frontier = spark.createDataFrame([("w", 1), ("w", 2), ("x", 1)], "w string, k int")
    delta = spark.createDataFrame([("w", 1, -1), ("w", 3, 1), ("x", 2, 1), ("x", 9, -1), ("y", 5, 1), ("y", 5, 1)], "w string, k int, op int")
    after, verdicts = ledger.frontier_delta(frontier, delta, ["w"], ["k"])
    assert sorted(map(tuple, after.collect())) == [("w", 2), ("w", 3), ("x", 1)]
    assert {r["w"]: r["verdict"] for r in verdicts.collect()} == {"w": "Published", "x": "Refused", "y": "Refused"}


def test_merge_policies(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 4, 1), (2, 4, 3)], "k int, v int, at int")
    got = {p: sorted(map(tuple, ledger.merge(rows, ["k"], "v", p, ["at"]).collect())) for p in ledger.POLICIES}
    assert got == {"Reject": [(2, 4, 2)], "Append": [(1, 5, 1), (1, 7, 1), (2, 4, 2)], "LastWriterByDeclaredClock": [(1, 7, 2), (2, 4, 2)], "JoinSemilattice": [(1, 7, 2), (2, 4, 2)]}
    with pytest.raises(ValueError):
        ledger.merge(rows, ["k"], "v", "Guess")


def test_journal_revisions_replace_only_themselves(spark, tmp_path):
    for revision, value in ((1, "a"), (2, "b"), (2, "c")):
        ledger.append_journal(spark.createDataFrame([(value,)], "v string"), str(tmp_path / "j"), revision)
    assert sorted((r["revision"], r["v"]) for r in ledger.read_journal(spark, str(tmp_path / "j")).collect()) == [(1, "a"), (2, "c")]


def test_changes_keep_nulls_and_refuse_unknown_kinds(spark, tmp_path):
    rows = spark.createDataFrame([("inserted", 1, None), ("masked", 2, "x")], "op string, k int, v string")
    ledger.write_changes(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, ledger.read_changes(spark, str(tmp_path / "c"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="no such change"):
        ledger.write_changes(rows.withColumn("op", F.lit("moved")), str(tmp_path / "d"))


def test_impure_rules_are_refused(spark):
    rows = spark.range(3)
    assert assurance.pure(rows.filter("id > 0")).count() == 2
    for bad in (rows.withColumn("x", F.rand()), rows.withColumn("x", F.current_timestamp()), rows.withColumn("x", F.monotonically_increasing_id()), rows.withColumn("x", F.uuid())):
        with pytest.raises(assurance.NotAdmissible):
            assurance.pure(bad)


def test_saturated_runs(spark):
    graph = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (3, None, 1), (4, 5, 1), (5, 4, 0), (6, 7, 0), (7, 7, 0)], "s int, t int, seen int")
    got = {r["s"]: (r["terminal"], r["outcome"]) for r in assurance.run_saturated(graph, "s", "t", "seen", 1).collect()}
    assert got[1] == (3, "Quiescent") and got[3] == (3, "Quiescent") and got[4][1] in ("Cyclic", "OverBudget") and got[7] == (None, "Cyclic")
    assert {r["s"]: r["steps"] for r in terminal_states(graph, "s", "t").collect()}[1] == 2


def test_ids_and_units(spark):
    row = spark.createDataFrame([("a|b", "c", "a", "b|c")], "p string, q string, r string, s string").select(skolem("x", F.col("p"), F.col("q")).alias("i"), skolem("x", F.col("r"), F.col("s")).alias("j")).first()
    assert row["i"] != row["j"]
    lengths = spark.range(3).select(with_unit(F.col("id"), "size", "mm"))
    assert [r[0] for r in lengths.select(converted(lengths, "size", "m")).collect()] == [0.0, 0.001, 0.002]
    with pytest.raises(TypeError):
        converted(lengths, "size", "kg")
    with pytest.raises(TypeError):
        converted(spark.range(1), "id", "m")


def test_places_and_quantiles_of_odd_values(spark):
    rows = spark.createDataFrame([("a", v, k) for k, v in enumerate([5.0, -3.2, None, 5.0, 0.0, 17.9])] + [("b", 1.0, 9), (None, 2.0, 10), (None, 3.0, 11)], "g string, v double, k int")
    got = {r["k"]: r["place"] for r in frames.places(rows, ["g"], "v", ["k"], 2.0).collect()}
    assert got == {2: 1, 1: 2, 4: 3, 0: 4, 3: 5, 5: 6, 9: 1, 10: 1, 11: 2}
    held = rows.filter("g IS NOT NULL")
    assert dict(map(tuple, frames.quantile(held, ["g"], "v", ["k"], 0.5, 2.0).collect())) == {"a": 5.0, "b": 1.0}


def test_cursors_walk_all_pages_of_one_snapshot(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 3), ("a", 1), ("c", 1), ("b", 1)], "x string, k int")
    seen, cursor = [], None
    while True:
        held, cursor = frames.next_page(rows, ["x", "k"], 2, "v1", cursor)
        seen += [tuple(r) for r in held]
        if cursor is None:
            break
    assert seen == [("a", 1), ("a", 3), ("b", 1), ("b", 2), ("c", 1)]
    first = frames.next_page(rows, ["x", "k"], 2, "v1")[1]
    for other, snapshot in ((rows, "v2"), (rows.withColumn("z", F.lit(1)), "v1")):
        with pytest.raises(frames.StaleCursor):
            frames.next_page(other, ["x", "k"], 2, snapshot, first)


def test_items_in_documents(spark):
    docs = spark.createDataFrame([(1, "One two, THREE four."), (2, "two three"), (3, None), (4, ""), (1, "again one two three four")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "Two"), (3, None), (4, "..."), (5, "three four")], "item_id int, text string")
    assert sorted(map(tuple, evaluation.contains_item(docs, items).collect())) == [(1, 1), (1, 2), (1, 5), (2, 2)]
    assert evaluation.contains_item(docs, items.filter("false")).count() == 0


def test_splits_are_exact_and_whole(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("s"))
    parts = evaluation.stratified(rows, "id", ["s"], 1, {"train": 0.7, "test": 0.3})
    assert {(r["s"], r["part"]): r["count"] for r in parts.groupBy("s", "part").count().collect()}[0, "train"] == 234
    assert parts.count() == 1000
    drawn = evaluation.bootstrap(rows, "id", 2, 20)
    assert abs(drawn.agg(F.sum("times")).first()[0] / 20_000 - 1) < 0.05


def test_fixpoint_budget(spark):
    with pytest.raises(BudgetExceeded):
        least_fixpoint(spark.createDataFrame([(0,)], "n long"), lambda new: new.select((F.col("n") + 1).alias("n")), 3)
