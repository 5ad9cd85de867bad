"""Frame verbs that are more than one DataFrame call."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import keyed_draw


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k per task before it shuffles (a group limit)."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def page(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The page after a cursor, by keyset: keys must be unique together. One top-k, no offset."""
    if after is not None:
        rows = rows.filter(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)]))
    return rows.orderBy(*keys).limit(size)


def pivot_longer(rows: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, columns, name, value)


def pivot_wider(rows: DataFrame, by: list[str], name: str, levels: list, cell: Column) -> DataFrame:
    """Levels are declared, so the plan needs no pass to find them."""
    return rows.groupBy(*by).pivot(name, levels).agg(cell)


def nest(rows: DataFrame, by: list[str], columns: list[str], out: str = "rows") -> DataFrame:
    """Groups as sorted arrays of structs. For groups known to be small: an array is one value."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(out))


def unnest(rows: DataFrame, column: str = "rows") -> DataFrame:
    return rows.select("*", F.inline(column)).drop(column)


def keyed_sample(rows: DataFrame, key: Column, share: float, seed: int) -> DataFrame:
    """A sample that depends on key and seed, not on how rows are dealt."""
    return rows.filter(keyed_draw(key, seed) < int(share * (1 << 32)))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with op -1 that went and +1 that came, by multiplicity; one shuffle for both sides."""
    both = before.withColumn("_n", F.lit(-1)).unionByName(after.withColumn("_n", F.lit(1)))
    net = both.groupBy(*before.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return net.withColumn("op", F.signum("_n").cast("int")).withColumn("times", F.abs("_n").cast("long")).drop("_n")


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with their multiplicities over both sides."""
    return a.unionByName(b).groupBy(*a.columns).agg(F.count("*").alias("times"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, carry: list[str], bucket: str = "day") -> DataFrame:
    """Each left row with the columns ``carry`` of the newest right row of its group that isn't later.

    A hot group doesn't stay in one task: rows meet within (group, bucket of time), and the last
    right row of each bucket is carried on to later buckets in a second window, over one row per
    group and bucket. Right rows of equal time: the greatest ``carry`` wins. The right row travels
    as one struct, so null values are carried like others; rows without a match get nulls.
    """
    row = F.struct(F.col(time).alias("_at"), *carry)
    start = F.date_trunc(bucket, F.col(time))
    a = left.select(*by, time, F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"), F.lit(1).alias("_side"))
    b = right.select(*by, time, F.lit(None).alias("_left"), row.alias("_right"), F.lit(0).alias("_side"))
    both = _union_sides(a, b).withColumn("_bucket", start)
    inside = W.partitionBy(*by, "_bucket").orderBy(time, "_side", "_right").rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    ends = both.groupBy(*by, "_bucket").agg(F.max("_right").alias("_end"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    found = F.coalesce("_near", "_before")
    return near.join(ends, [*by, "_bucket"], "left").select("_left.*", *[found[c].alias(c) for c in carry], found["_at"].alias("matched_at"))


def _union_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("_right", F.lit(None).cast(b.schema["_right"].dataType)).unionByName(
        b.withColumn("_left", F.lit(None).cast(a.schema["_left"].dataType))
    )


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the spans [start, end) of their group that hold them; times are whole seconds.

    Spans are dealt to all cells of ``width`` that they touch and points to one, so the join has an
    equality to shuffle on; it is exact for spans of any length.
    """
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    dealt = spans.filter(F.col(end) > F.col(start)).withColumn("_cell", F.explode(cells))
    placed = points.withColumn("_cell", F.floor(F.col(at) / width))
    return placed.join(dealt, [*by, "_cell"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")


def places(rows: DataFrame, by: list[str], value: str, tie: list[str], width: float) -> DataFrame:
    """Adds ``place`` (from 1) of each row in its group by (value, tie), without sorting a group in one task.

    Rows are counted per range of values of ``width``; a row's place is the count of the ranges
    before its own and its place within it. Nulls come first. The window over ranges has one row for
    each range of a group.
    """
    cell = F.floor(F.col(value) / F.lit(width))
    counts = rows.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_cell").alias("_c"), before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, "_cell").orderBy(value, *tie))
    ranked = rows.withColumn("_cell", cell).withColumn("_at", inside)
    same = [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by] + [F.col("_cell").eqNullSafe(F.col("_c"))]
    return ranked.join(counts, same).withColumn("place", F.col("_before") + F.col("_at")).select(*rows.columns, "place")


def quantile(rows: DataFrame, by: list[str], value: str, tie: list[str], share: float, width: float) -> DataFrame:
    """(by, quantile): the exact quantile of each group's values, between the two rows next to it; nulls don't count."""
    held = rows.filter(F.col(value).isNotNull())
    at = F.lit(share) * (F.col("_n") - 1)
    total = held.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.floor(at).alias("_low"), (at - F.floor(at)).alias("_part"))
    placed = places(held.select(*by, value, *tie), by, value, tie, width).join(total, by)
    ends = placed.filter(F.col("place").between(F.col("_low") + 1, F.col("_low") + 2))
    low, high = (F.max(F.when(F.col("place") == F.col("_low") + k, F.col(value))) for k in (1, 2))
    out = ends.groupBy(*by, "_part").agg(low.alias("_a"), high.alias("_b"))
    return out.select(*by, F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("quantile"))


class StaleCursor(ValueError):
    """A cursor of another query, or of another snapshot of its tables."""


def cursor_of(rows: DataFrame, order: list[str], snapshot: str, after: tuple) -> str:
    """Where a page ended: the order keys of its last row, bound to the query's shape and to a snapshot."""
    shape = hashlib.sha256(json.dumps([rows.schema.jsonValue(), order]).encode()).hexdigest()
    return json.dumps({"query": shape, "snapshot": snapshot, "after": list(after)})


def next_page(rows: DataFrame, order: list[str], limit: int, snapshot: str, cursor: str | None = None) -> tuple[list, str | None]:
    """(rows of one page, cursor of the next or None); a page has at most ``limit`` rows and is small by contract.

    A cursor that another query or snapshot gave is refused, so a page never goes on in changed rows.
    """
    if cursor is not None:
        told = json.loads(cursor)
        if cursor_of(rows, order, snapshot, tuple(told["after"])) != cursor:
            raise StaleCursor("the cursor belongs to another query or snapshot")
        found = page(rows, order, tuple(told["after"]), limit)
    else:
        found = rows.orderBy(*order).limit(limit)
    held = found.orderBy(*order).collect()
    return held, cursor_of(rows, order, snapshot, tuple(held[-1][c] for c in order)) if len(held) == limit else None
