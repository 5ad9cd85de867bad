"""Positive recursion: closures as semi-naive rounds, each a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt, materialize


class BudgetExceeded(RuntimeError):
    """A recursion went past its declared number of rounds."""


def least_fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 64) -> DataFrame:
    """All rows that ``seed`` and repeated ``step`` of the newest rows give. Order-free: sets only.

    Each round steps from what the last one added and writes only that; what is known is the union of
    the rounds' tables. A lost executor repeats one round and not all of them.
    """
    return _grown(_distinct(seed, "fixpoint"), step, rounds)


def _distinct(rows: DataFrame, name: str) -> DataFrame:
    """A table of the distinct rows."""
    rows = materialize(rows, name)
    return materialize(dealt(rows, rows.count(), *rows.columns).distinct(), name)


def _grown(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    fresh = known = seed
    total = known.count()
    for _ in range(rounds):
        found = dealt(step(fresh).select(*known.columns), total, *known.columns)
        fresh = materialize(found.distinct().join(known, known.columns, "left_anti"), "fixpoint")
        more = fresh.count()
        if not more:
            return known
        known, total = known.unionByName(fresh), total + more
    raise BudgetExceeded(f"no fixpoint after {rounds} rounds")


def transitive_closure(edges: DataFrame, a: str, b: str, starts: DataFrame | None = None, rounds: int = 64) -> DataFrame:
    """(a, b) for every path of one edge or more; from the rows of ``starts`` (column ``a``) if given.

    A round looks first where its rows end, and which edges leave from there. Where paths run into a
    few ends those edges are a small table, which is broadcast; the rows that share an end, which may
    be most of the table, aren't brought together in one task. Rows without an edge ahead go no further.
    """
    edges = _distinct(edges.select(a, b), "edges")
    hops = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    seed = edges
    if starts is not None:
        seed = materialize(seed.join(starts.select(a).distinct(), a, "left_semi").select(a, b), "fixpoint")

    def step(new: DataFrame) -> DataFrame:
        ends = materialize(new.select(b).distinct(), "ends")
        ahead = materialize(hops.join(ends, F.col("_from") == F.col(b), "left_semi"), "ahead")
        return new.join(ahead, F.col(b) == F.col("_from")).select(a, F.col("_to").alias(b))

    return _grown(seed, step, rounds)


def bounded_paths(edges: DataFrame, a: str, b: str, least: int, most: int) -> DataFrame:
    """(a, b, hops) for paths of ``least`` to ``most`` edges, by self-joins of distinct pairs."""
    hops = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
    at = hops.select(F.col("_from").alias(a), F.col("_to").alias(b))
    found = [at.withColumn("hops", F.lit(1))] if least <= 1 else []
    for k in range(2, most + 1):
        at = at.join(hops, F.col(b) == F.col("_from")).select(a, F.col("_to").alias(b)).distinct()
        if k >= least:
            found.append(at.withColumn("hops", F.lit(k)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def terminal_states(graph: DataFrame, state: str, succ: str, rounds: int = 40, weight: str | None = None) -> DataFrame:
    """(state, terminal, steps, cyclic) of a functional graph, by pointer jumping.

    A state without a successor is terminal. States that never reach one are cyclic; their terminal
    is null. A step counts 1, or the ``weight`` of the state that it leaves. A state that has found
    its terminal jumps no more. A round in which none finds it is the last: the next farther ones
    would have, so those left are on cycles or lead to them. Rounds follow the longest path thus, not the number of states.
    """
    state_, next_ = F.col(state), F.col(succ)
    weight_ = (F.col(weight) if weight else F.lit(1)).cast("long")
    start = graph.select(state_.alias("s"), F.coalesce(next_, state_).alias("t"), F.when(next_.isNull(), 0).otherwise(weight_).cast("long").alias("steps"), (next_.isNull() & state_.isNotNull()).alias("ended"))
    at = materialize(start, "jump")
    left, going, ended = None, at.filter("NOT ended"), at.filter("ended")
    for _ in range(rounds):
        before, left = left, going.count()
        if left in (0, before):
            break
        ahead = going.unionByName(ended).select(F.col("s").alias("t"), F.col("t").alias("u"), F.col("steps").alias("more"), F.col("ended").alias("there"))
        new = going.drop("ended").join(ahead, "t", "left").select("s", F.coalesce("u", "t").alias("t"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("there", F.lit(False)).alias("ended"))
        at = materialize(new, "jump")
        going, ended = at.filter("NOT ended"), ended.unionByName(at.filter("ended"))
    else:
        raise BudgetExceeded(f"paths longer than 2^{rounds}")
    return going.unionByName(ended).select(F.col("s").alias(state), F.when(F.col("ended"), F.col("t")).alias("terminal"), F.when(F.col("ended"), F.col("steps")).alias("steps"), (~F.col("ended")).alias("cyclic"))
