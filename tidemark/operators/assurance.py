"""Receipts, declared generators, witnesses, saturated runs and the standing of judgements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import skolem
from .recursion import terminal_states


class NotAdmissible(ValueError):
    """A rule reads the clock, draws at random or depends on how rows are dealt."""


#: Functions that a rule may not use. Fixed values.
EFFECTS = "rand randn random shuffle uuid current_timestamp current_date localtimestamp now monotonically_increasing_id spark_partition_id input_file_name".split()


def pure(rows: DataFrame) -> DataFrame:
    """``rows``, if what they are derived by gives the same in every run; otherwise the rule is refused."""
    plan = rows._jdf.queryExecution().analyzed()
    used = sorted(set(re.findall(r"\b(" + "|".join(EFFECTS) + r")\(", plan.toString())))
    if used or not plan.deterministic():
        raise NotAdmissible(f"a rule may not use {', '.join(used) or 'functions without a fixed result'}")
    return rows


def receipt(oracle: Column, *step: Column) -> Column:
    """The receipt of a step by one oracle: another oracle, or a changed step, has another one."""
    return skolem("receipt", oracle, *step)


def verify_receipts(steps: DataFrame, claimed: DataFrame, key: list[str], oracle: str, content: list[str]) -> DataFrame:
    """Steps with ``verdict``: Bound, Forged (a receipt of something else) or Missing."""
    own = steps.withColumn("_own", receipt(F.col(oracle), *map(F.col, content)))
    joined = own.join(claimed.select(*key, F.col("receipt").alias("_told")), key, "left")
    return joined.withColumn("verdict", F.when(F.col("_told").isNull(), "Missing").when(F.col("_told") == F.col("_own"), "Bound").otherwise("Forged")).drop("_own", "_told")


def generator_verdicts(steps: DataFrame, exact: DataFrame, diagonal: DataFrame) -> DataFrame:
    """Steps (generator, src, dst) with ``verdict``: Exact if a declared row says so, Diagonal if the
    generator is declared to change nothing and does, else Undeclared."""
    rows = exact.select("generator", "src", "dst").distinct().withColumn("_exact", F.lit(True))
    still = diagonal.select("generator").distinct().withColumn("_still", F.lit(True))
    joined = steps.join(rows, ["generator", "src", "dst"], "left").join(still, "generator", "left")
    verdict = F.when(F.col("_exact"), "Exact").when(F.col("_still") & F.col("src").eqNullSafe(F.col("dst")), "Diagonal").otherwise("Undeclared")
    return joined.withColumn("verdict", verdict).drop("_exact", "_still")


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Witnesses (src, dst, n) of a then b: n counts the ways; both are summed before they meet."""
    x = a.groupBy("src", F.col("dst").alias("_mid")).agg(F.sum("n").alias("_x"))
    y = b.groupBy(F.col("src").alias("_mid"), "dst").agg(F.sum("n").alias("_y"))
    return x.join(y, "_mid").groupBy("src", "dst").agg(F.sum(F.col("_x") * F.col("_y")).alias("n"))


def tensor(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Witnesses side by side, within ``on``: (on, src_a, src_b, dst_a, dst_b, n)."""
    x, y = (r.groupBy(*on, "src", "dst").agg(F.sum("n").alias("n")).select(*on, *[F.col(c).alias(f"{c}_{s}") for c in ("src", "dst", "n")]) for r, s in ((a, "a"), (b, "b")))
    return x.join(y, on).select(*on, "src_a", "src_b", "dst_a", "dst_b", (F.col("n_a") * F.col("n_b")).alias("n"))


def run_saturated(graph: DataFrame, state: str, succ: str, visible: str, budget: int) -> DataFrame:
    """(state, terminal, steps, outcome): runs in which hidden steps cost nothing.

    ``visible`` tells whether the step out of a state counts. The budget of visible steps is looked
    at first: OverBudget, then Cyclic, else Quiescent.
    """
    ends = terminal_states(graph, state, succ, weight=visible)
    outcome = F.when(F.col("steps") > budget, "OverBudget").when(F.col("cyclic"), "Cyclic").otherwise("Quiescent")
    return ends.withColumn("outcome", outcome).select(state, F.when(F.col("outcome") == "Quiescent", F.col("terminal")).alias("terminal"), "steps", "outcome")


def adequacy(graph: DataFrame, state: list[str], succ: str) -> DataFrame:
    """(state, successors, verdict): Defined with one successor, Terminal with none, Ambiguous with several."""
    seen = graph.groupBy(*state).agg(F.min(succ).alias("_a"), F.max(succ).alias("_b"))
    return seen.select(*state, F.when(F.col("_a").isNull(), "Terminal").when(F.col("_a") == F.col("_b"), "Defined").otherwise("Ambiguous").alias("verdict"))


def sole_authority(judgements: DataFrame, outcome: list[str], authority: str) -> DataFrame:
    """(outcome, authority, verdict): Sole with one authority, which is named, else Disputed."""
    seen = judgements.groupBy(*outcome).agg(F.min(authority).alias("_a"), F.max(authority).alias("_b"))
    sole = F.col("_a") == F.col("_b")
    return seen.select(*outcome, F.when(sole, F.col("_a")).alias("authority"), F.when(sole, "Sole").otherwise("Disputed").alias("verdict"))


def durable(judgements: DataFrame, evidence: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """(key, pieces, lost, verdict): Durable if every piece of evidence that a judgement names is still held."""
    held = evidence.select(*on).distinct().withColumn("_held", F.lit(1))
    seen = judgements.join(held, on, "left").groupBy(*key).agg(F.count("*").alias("pieces"), F.sum(F.when(F.col("_held").isNull(), 1).otherwise(0)).alias("lost"))
    return seen.withColumn("verdict", F.when(F.col("lost") > 0, "Lost").otherwise("Durable"))


def proofs(matches: DataFrame, rule: str, bindings: list[str], premises: dict[str, Column]) -> DataFrame:
    """(proof, rule, bindings, premises): one named proof for each match of a rule."""
    named = F.array(*[F.concat(F.lit(f"{relation}:"), key.cast("string")) for relation, key in premises.items()])
    bound = F.concat_ws(",", *[F.concat(F.lit(f"{b}="), F.col(b).cast("string")) for b in bindings])
    return matches.select(skolem(rule, *map(F.col, bindings)).alias("proof"), F.lit(rule).alias("rule"), bound.alias("bindings"), named.alias("premises"))
