"""Live views: masks, key conflicts, error rows, constraints, support counts, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Rejected(ValueError):
    """A strict constraint or a ground key conflict refuses the revision."""


def live(edges: DataFrame, masks: DataFrame, key: list[str]) -> DataFrame:
    """Edges that no live mask names. History keeps the others."""
    return edges.join(masks.select(*key).distinct(), key, "left_anti")


def split_conflicts(edges: DataFrame, key: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(settled, conflicts): keys with one distinct payload, and keys with several, which have no live row.

    One aggregation by key; least and greatest payload tell whether all agree, so no group is ever
    collected.
    """
    value = F.struct(*payload)
    seen = edges.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("supports"))
    one = F.col("low").eqNullSafe(F.col("high"))
    return seen.filter(one).select(*key, "low.*", "supports"), seen.filter(~one).select(*key, "supports", "low", "high")


def errors(rows: DataFrame, rule: str, sites: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows without faults and with the results, error rows): a fault stops one match and no other.

    ``sites`` names each result with its expression, which is null on a fault, and the condition
    under which null is a fault.
    """
    tried = rows.withColumns({name: value for name, (value, _) in sites.items()})
    bad = F.array_compact(F.array(*[F.when(F.col(name).isNull() & due, F.lit(name)) for name, (_, due) in sites.items()]))
    tried = tried.withColumn("_bad", bad)
    good = tried.filter(F.size("_bad") == 0).drop("_bad")
    return good, tried.filter(F.size("_bad") > 0).select(*rows.columns, F.lit(rule).alias("rule"), F.explode("_bad").alias("site"))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(row columns, constraint): one row for each check that a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumn("constraint", F.explode(broken))


def strict(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows``, if they break nothing; otherwise the revision is refused before it is published."""
    found = violations(rows, checks).groupBy("constraint").count().collect()
    if found:
        raise Rejected("; ".join(f"{r['constraint']}: {r['count']} rows" for r in sorted(found)))
    return rows


def absent(wanted: DataFrame, held: DataFrame, key: list[str], witness: DataFrame, part: str, at: str, through: str) -> DataFrame:
    """Rows of ``wanted`` that ``held`` lacks, with ``answer``: Absent where a witness covers them, else Unknown.

    ``witness`` has a row (``part``, ``through``) for each partition of ``held`` that is complete up
    to a moment; without such a row nothing follows from a row's not being there.
    """
    missing = wanted.join(held.select(*key).distinct(), key, "left_anti")
    covered = witness.select(F.col(part).alias("_part"), F.col(through).alias("_through")).groupBy("_part").agg(F.max("_through").alias("_through"))
    judged = missing.join(covered, (F.col(part) == F.col("_part")) & (F.col(at) <= F.col("_through")), "left")
    return judged.withColumn("answer", F.when(F.col("_part").isNull(), "Unknown").otherwise("Absent")).drop("_part", "_through")


def supported(log: DataFrame, content: list[str]) -> DataFrame:
    """Contents with more claims than retractions. A content lives while any source still claims it."""
    return log.groupBy(*content).agg(F.sum("sign").cast("long").alias("supports")).filter("supports > 0")


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest version of each key, without a sort: the row with the greatest ``order``."""
    rest = [c for c in log.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*key).agg(newest.alias("_row")).select(*key, "_row.*")


def as_of(log: DataFrame, revision: str, at, key: list[str], order: list[str]) -> DataFrame:
    """The state as it was known at a revision."""
    return latest(log.filter(F.col(revision) <= F.lit(at)), key, order)


def bitemporal(log: DataFrame, key: list[str], known: str, valid: str, known_at: Column, valid_at: Column, tie: list[str] = ()) -> DataFrame:
    """What was believed at ``known_at`` to hold at ``valid_at``: newest valid time, then the tie, then newest knowledge."""
    return latest(log.filter((F.col(known) <= known_at) & (F.col(valid) <= valid_at)), key, [valid, *tie, known])


def validity(log: DataFrame, key: list[str], since: str, tie: list[str]) -> DataFrame:
    """Each version with the moment at which the next one replaces it (null: still valid)."""
    return log.withColumn("valid_to", F.lead(since).over(W.partitionBy(*key).orderBy(since, *tie)))


def chain(steps: DataFrame, by: list[str], order: str, payload: Column) -> DataFrame:
    """The last link of each journal's hash chain h' = sha256(h || payload), and its length.

    A chain can't be combined from parts, so a journal is folded by one task: journals are short
    (a settlement run), and many journals fold at once.
    """
    row = F.struct(F.col(order).alias("_o"), payload.cast("string").alias("_p"))
    fold = F.aggregate(F.array_sort("_steps"), F.sha2(F.lit(""), 256), lambda h, x: F.sha2(F.concat(h, x["_p"]), 256))
    return steps.groupBy(*by).agg(F.collect_list(row).alias("_steps")).select(*by, fold.alias("chain"), F.size("_steps").cast("long").alias("length"))


def commit_least(candidates: DataFrame, world: list[str], phase: str, priority: str, tiebreak: str) -> DataFrame:
    """The admissible candidate with the least (phase, priority, tiebreak) of each world, in one aggregation."""
    rest = [c for c in candidates.columns if c not in world]
    return candidates.groupBy(*world).agg(F.min_by(F.struct(*rest), F.struct(phase, priority, tiebreak)).alias("_c"), F.count("*").alias("work")).select(*world, "_c.*", "work")
