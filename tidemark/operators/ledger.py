"""Claims, revisions and what is decided about them: conflicts, merges, frontiers, journals, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import skolem
from .settlement import Rejected, split_conflicts


def assert_claims(rows: DataFrame, relation: str, content: list[str], source: str) -> DataFrame:
    """Adds ``claim``: a reference to one source's assertion of one content, the same in every run."""
    return rows.withColumn("claim", skolem(relation, F.col(source), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]))


def ground(rows: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """The settled rows of a ground relation; a key with several payloads refuses the whole revision."""
    settled, conflicts = split_conflicts(rows, key, payload)
    n = conflicts.count()
    if n:
        raise Rejected(f"{n} keys of {', '.join(key)} have several values")
    return settled.drop("supports")


def judge_revisions(rows: DataFrame, revision: list[str], key: list[str], payload: list[str]) -> DataFrame:
    """(revision, keys, conflicts, verdict) for many revisions at once: each is refused whole or published whole."""
    value = F.struct(*payload)
    by_key = rows.groupBy(*revision, *key).agg((~F.min(value).eqNullSafe(F.max(value))).cast("long").alias("_clash"))
    return by_key.groupBy(*revision).agg(F.count("*").alias("keys"), F.sum("_clash").alias("conflicts")).withColumn("verdict", F.when(F.col("conflicts") > 0, "Refused").otherwise("Published"))


def expect_revision(commits: DataFrame, world: list[str], expected: str, order: list[str]) -> DataFrame:
    """Adds ``verdict``: of the commits that expect one revision of a world the first is Committed, the others are Stale.

    The first is found by an aggregation and joined back, so a world with many commits isn't sorted in one task.
    """
    first = commits.groupBy(*world, expected).agg(F.min(F.struct(*order)).alias("_first"))
    return commits.join(first, [*world, expected]).withColumn("verdict", F.when(F.struct(*order) == F.col("_first"), "Committed").otherwise("Stale")).drop("_first")


def snapshot_conflicts(writes: DataFrame, key: list[str], began: str, ended: str, order: list[str]) -> DataFrame:
    """Adds ``verdict``: Aborted where another write of the key was committed between a write's begin and its end."""
    before = F.lag(ended).over(W.partitionBy(*key).orderBy(ended, *order))
    return writes.withColumn("_before", before).withColumn("verdict", F.when(F.col("_before") > F.col(began), "Aborted").otherwise("Committed")).drop("_before")


#: Ways to merge several values of a key. Fixed values.
POLICIES = ("Reject", "Append", "LastWriterByDeclaredClock", "JoinSemilattice")


def merge(rows: DataFrame, key: list[str], value: str, policy: str, clock: list[str] = (), join=F.max) -> DataFrame:
    """(key, value or values, n) under a policy; one aggregation, combined before the shuffle.

    Reject leaves out keys with several values. Append counts each distinct value. The last writer
    is the one with the greatest declared clock. A semilattice joins by ``join``, which must not
    depend on order or repeats.
    """
    if policy == "Reject":
        return split_conflicts(rows, key, [value])[0].withColumnRenamed("supports", "n")
    if policy == "Append":
        return rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    if policy == "LastWriterByDeclaredClock":
        return rows.groupBy(*key).agg(F.max_by(value, F.struct(*clock)).alias(value), F.count("*").alias("n"))
    if policy == "JoinSemilattice":
        return rows.groupBy(*key).agg(join(value).alias(value), F.count("*").alias("n"))
    raise ValueError(f"no policy {policy}")


def frontier_delta(frontier: DataFrame, delta: DataFrame, world: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(frontier after, verdicts): each world's delta (``op`` -1 or +1) is applied whole, or not at all.

    A removal must find its key, an addition must not find one that stays, and no key may come
    twice. All is checked first; a world with one fault keeps its frontier.
    """
    held = frontier.select(*world, *key).withColumn("_held", F.lit(1))
    wanted = delta.groupBy(*world, *key).agg(F.sum((F.col("op") < 0).cast("long")).alias("_out"), F.sum((F.col("op") > 0).cast("long")).alias("_in"))
    tried = wanted.join(held, [*world, *key], "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    bad = (F.col("_out") > F.col("_held")) | (F.col("_held") - F.col("_out") + F.col("_in") > 1)
    verdicts = tried.groupBy(*world).agg(F.sum(bad.cast("long")).alias("faults"), F.count("*").alias("changes"))
    verdicts = verdicts.withColumn("verdict", F.when(F.col("faults") > 0, "Refused").otherwise("Published"))
    good = tried.join(verdicts.filter("faults = 0").select(*world), world, "left_semi")
    kept = frontier.select(*world, *key).join(good.filter("_out > 0").select(*world, *key), [*world, *key], "left_anti")
    return kept.unionByName(good.filter("_in > 0").select(*world, *key)), verdicts


def append_journal(rows: DataFrame, folder: str, revision: int) -> None:
    """Write one revision of an append-only journal. A revision that is written again replaces itself only."""
    rows.write.mode("overwrite").parquet(f"{folder}/revision={revision}")


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


#: Kinds of change in an interchange file. Fixed values.
CHANGES = ("inserted", "retracted", "masked", "unmasked")


def write_changes(rows: DataFrame, folder: str) -> None:
    """Changes (``op`` one of CHANGES, then the row's columns) as lines of JSON; nulls are written."""
    known = F.when(F.col("op").isin(*CHANGES), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce("op", F.lit("null")))))
    rows.withColumn("op", known).write.option("ignoreNullFields", "false").json(folder)


def read_changes(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)


def apply_changes(rows: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What is visible after the changes, the newest of each key deciding: retracted and masked rows are not."""
    newest = changes.groupBy(*key).agg(F.max_by("op", F.struct(*order)).alias("_op"))
    joined = rows.select(*key).distinct().withColumn("_old", F.lit(True)).join(newest, key, "full")
    seen = F.coalesce(F.col("_op").isin("inserted", "unmasked"), F.col("_old"))
    return joined.filter(seen).select(*key)


def redact(rows: DataFrame, rules: dict[str, str], salt: str = "") -> DataFrame:
    """Columns by rule: ``drop``, ``hide`` (null), ``pseudonym`` (a keyed hash, equal for equal values)."""
    for name, rule in rules.items():
        if rule == "drop":
            rows = rows.drop(name)
        elif rule == "hide":
            rows = rows.withColumn(name, F.lit(None).cast(rows.schema[name].dataType))
        elif rule == "pseudonym":
            rows = rows.withColumn(name, F.sha2(F.concat(F.lit(f"{salt}|"), F.col(name).cast("string")), 256))
        else:
            raise ValueError(f"no rule {rule}")
    return rows


def scoped(rows: DataFrame, grants: DataFrame, on: list[str], reader: str) -> DataFrame:
    """Rows that ``reader`` may see: those whose scope columns a grant names."""
    return rows.join(grants.filter(F.col("reader") == reader).select(*on).distinct(), on, "left_semi")


def outcomes(attempts: DataFrame, replies: DataFrame, key: list[str], status: str) -> DataFrame:
    """(key, outcome): the reply of each attempt; none, or several that disagree, is UnknownOutcome."""
    told = replies.groupBy(*key).agg(F.min(status).alias("_a"), F.max(status).alias("_b"))
    known = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("UnknownOutcome")
    return attempts.select(*key).distinct().join(told, key, "left").withColumn("outcome", F.coalesce(known, F.lit("UnknownOutcome"))).drop("_a", "_b")


def satisfied(desired: DataFrame, done: DataFrame, key: list[str], since: str, at: str) -> DataFrame:
    """(key, since, satisfied): a desire is satisfied by an act at or after it; repeated desires coalesce to the latest."""
    latest = desired.groupBy(*key).agg(F.max(since).alias(since), F.count("*").alias("asked"))
    acts = done.groupBy(*key).agg(F.max(at).alias("_at"))
    return latest.join(acts, key, "left").withColumn("satisfied", F.coalesce(F.col("_at") >= F.col(since), F.lit(False))).drop("_at")


def weakest(tiers: DataFrame, closure: DataFrame, node: str, tier: str, a: str, b: str) -> DataFrame:
    """(node, tier): the least tier of a node and of all that it depends on (``closure``: a depends on b)."""
    own = tiers.select(F.col(node), F.col(tier))
    below = closure.join(own, F.col(b) == F.col(node)).select(F.col(a).alias(node), tier)
    return own.unionByName(below).groupBy(node).agg(F.min(tier).alias(tier))


def escalate(tasks: DataFrame, now: Column, opened: str, hours: list[int]) -> DataFrame:
    """Adds ``level``: how many of the rising deadlines (hours after opening) an open task has passed."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(opened).cast("timestamp"))
    return tasks.withColumn("level", sum(F.when(age > h * 3600, 1).otherwise(0) for h in hours).cast("int"))
