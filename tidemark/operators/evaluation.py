"""Data quality, recipes, splits and evaluation of scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import keyed_draw


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_null, n_distinct, low, high, mean) of numeric columns, in one pass and one shuffle."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    return long.groupBy("column").agg(
        F.count("*").alias("n"), F.sum(F.col("v").isNull().cast("long")).alias("n_null"), F.count_distinct("v").alias("n_distinct"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg(F.col("v").cast("decimal(20,4)")).cast("double"), 4).alias("mean"),
    )


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal bin; values outside go to bins 0 and bins + 1."""
    bin_ = F.when(F.col(value) < low, 0).when(F.col(value) >= high, bins + 1).otherwise(F.floor((F.col(value) - low) * bins / (high - low)) + 1)
    return rows.filter(F.col(value).isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def outliers(rows: DataFrame, by: list[str], value: str, spread: float) -> DataFrame:
    """Rows further than ``spread`` standard deviations from their group's mean. Reported, never changed.

    Moments per group are combined before the shuffle and joined back, so hot groups do no harm.
    """
    moments = rows.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    return rows.join(moments, by).filter(F.abs(F.col(value) - F.col("_mean")) > F.lit(spread) * F.col("_sd")).drop("_mean", "_sd")


def standardise(train: DataFrame, rows: DataFrame, value: str, out: str) -> DataFrame:
    """Fit on ``train`` only, apply to ``rows``; the fitted table has one row."""
    fitted = train.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return rows.crossJoin(F.broadcast(fitted)).withColumn(out, (F.col(value) - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")


def split_of(key: Column, seed: int, shares: dict[str, float]) -> Column:
    """A split by the key's draw: all rows of a key fall into one part, whatever the partitions."""
    draw, out, upto = keyed_draw(key, seed), None, 0.0
    for name, share in list(shares.items())[:-1]:
        upto += share
        out = F.when(draw < int(upto * (1 << 32)), F.lit(name)) if out is None else out.when(draw < int(upto * (1 << 32)), F.lit(name))
    return out.otherwise(F.lit(list(shares)[-1]))


def roc_auc(rows: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """AUC by ranks, from counts per distinct score: ties count half. No sort of single rows in one task.

    The running sum goes over distinct scores; round scores first if there are many.
    """
    at = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    total = won.groupBy(*by) if by else won.groupBy()
    return total.agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))


def calibration(rows: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """(bin, n, mean score, share of label 1): the table behind the expected calibration error."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("score"), F.avg(F.col(label).cast("double")).alias("share"))


def stability_index(before: DataFrame, after: DataFrame, level: str) -> DataFrame:
    """(level, a, b, psi) with the shares of a level before and after, smoothed by half a row."""
    sides = [d.groupBy(level).agg(F.count("*").alias(n)) for d, n in ((before, "na"), (after, "nb"))]
    both = sides[0].join(sides[1], level, "full").fillna(0, ["na", "nb"])
    total = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("k"))
    a, b = ((F.col(n) + 0.5) / (F.col(t) + 0.5 * F.col("k")) for n, t in (("na", "ta"), ("nb", "tb")))
    return both.crossJoin(F.broadcast(total)).select(level, a.alias("a"), b.alias("b"), ((b - a) * F.ln(b / a)).alias("psi"))


def dataset_digest(rows: DataFrame, by: list[str], content: Column, digits: int = 3) -> DataFrame:
    """(by, n, digest): the identity of a set of rows, whatever their order and partitions.

    Rows are hashed and added up in 16^digits parts by the first digits of their hash, combined
    before the shuffle; the digest is that of the parts' sums in order, a list of fixed length.
    """
    h = F.sha2(content, 256)
    number = lambda at: F.conv(F.substring("_h", at, 12), 16, 10).cast("decimal(38,0)")
    parts = rows.select(*by, h.alias("_h")).groupBy(*by, F.substring("_h", 1, digits).alias("_part")).agg(
        F.count("*").alias("_n"), *[F.sum(number(at)).alias(f"_s{k}") for k, at in enumerate((1, 13, 25))]
    )
    line = F.concat_ws(":", "_part", F.col("_n").cast("string"), *[F.col(f"_s{k}").cast("string") for k in range(3)])
    return parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"))


def fit_scaling(train: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row: least, greatest and two quantiles of the training rows."""
    return train.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.percentile(value, F.lit(low)).alias("_a"), F.percentile(value, F.lit(high)).alias("_b"))


def apply_scaling(fitted: DataFrame, rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds clipped (to the fitted quantiles), scaled (to the fitted range) and bin; unseen values may scale past 0 and 1."""
    v, width = F.col(value), F.col("_hi") - F.col("_lo")
    out = rows.crossJoin(F.broadcast(fitted)).withColumns({
        "clipped": F.least(F.greatest(v, F.col("_a")), F.col("_b")).cast("double"), "scaled": F.try_divide((v - F.col("_lo")).cast("double"), width),
        "bin": F.least(F.greatest(F.floor(F.try_divide((v - F.col("_lo")).cast("double") * bins, width)), F.lit(0)), F.lit(bins - 1)).cast("long"),
    })
    return out.drop("_lo", "_hi", "_a", "_b")


def contains_item(docs: DataFrame, items: DataFrame, grams: int = 3) -> DataFrame:
    """(doc_id, item_id) where a document has all the item's words (a-z, 0-9, lower-cased) one after another.

    Items meet documents by the hash of their first ``grams`` words, or of all if they have fewer,
    so work follows the places that could match and not documents times items; each is then verified.
    """

    def words(text: str) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)

    def line(w: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

    held = items.filter(F.lower("text").rlike("[a-z0-9]")).select("item_id", words("text").alias("w"))
    held = held.select("item_id", line(F.col("w")).alias("x"), F.least(F.size("w"), F.lit(grams)).alias("k"), F.xxhash64(F.array_join(F.slice("w", 1, grams), " ")).alias("h"))
    lengths = [r["k"] for r in held.select("k").distinct().collect()]
    rows = docs.select("doc_id", words("text").alias("w"))

    def at(k: int) -> Column:
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, k), " ")))

    hashes = F.concat(*[at(k) for k in lengths]) if lengths else F.array().cast("array<bigint>")
    near = rows.select("doc_id", F.explode(F.array_distinct(hashes)).alias("h")).join(held.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    both = near.join(rows.select("doc_id", line(F.col("w")).alias("y")), "doc_id").join(held.select("item_id", "x"), "item_id")
    return both.filter(F.contains("y", F.col("x"))).select("doc_id", "item_id").distinct()


def confusion(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn) at declared thresholds; each row is counted under all of them in one pass."""
    hit, y = F.col(score) >= F.col("threshold"), F.col(label) == 1
    each = rows.select(score, label, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))


def costs(rows: DataFrame, score: str, label: str, thresholds: list[float], false_positive: float, false_negative: float) -> DataFrame:
    """(threshold, cost) with the declared prices of both errors."""
    at = confusion(rows, score, label, thresholds)
    return at.select("threshold", (F.col("fp") * F.lit(false_positive) + F.col("fn") * F.lit(false_negative)).alias("cost"))


def pr_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision: the sum over distinct scores, from the top, of precision times the gain in recall.

    Scores are counted first; the window runs over distinct scores, so round them if there are many.
    """
    at = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    top = W.orderBy(F.col(score).desc())
    upto = at.select("p", F.sum("p").over(top).alias("tp"), F.sum("n").over(top).alias("all"))
    return upto.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p")).alias("pr_auc"))


def log_loss(rows: DataFrame, score: str, label: str, least: float = 1e-6) -> DataFrame:
    """Mean negative log likelihood; scores are kept ``least`` away from 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(least)), F.lit(1 - least))
    return rows.agg(F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def drift(rows: DataFrame, period: Column, measures: dict[str, Column], base: Column) -> DataFrame:
    """(period, measure, n, mean, shift): each measure's mean per period and its distance from the base period's.

    A measure is a feature, a label, a prediction, or their difference. The base rows are those where
    ``base`` holds. Means are combined before the shuffle; one row per measure is joined back.
    """
    long = rows.select(period.alias("period"), base.alias("_base"), F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("v")) for k, v in measures.items()])))
    exact = F.col("v").cast("decimal(30,9)")
    mean = F.sum(exact).cast("double") / F.count("v")
    first = long.filter("_base").groupBy("measure").agg(mean.alias("_mean"))
    per = long.groupBy("period", "measure").agg(F.count("v").alias("n"), mean.alias("mean"))
    return per.join(first, "measure").select("period", "measure", "n", "mean", (F.col("mean") - F.col("_mean")).alias("shift"))


def fold_of(key: Column, seed: int, folds: int) -> Column:
    """A fold 0..folds-1 by the key's draw; with a group's key all of a group fall into one fold."""
    return keyed_draw(key, seed) % folds


def stratified(rows: DataFrame, key: str, strata: list[str], seed: int, shares: dict[str, float]) -> DataFrame:
    """Adds ``part``: within each stratum the rows by their draws, shared out exactly.

    The place of a draw comes from counts of 256 ranges of draws, so a stratum isn't sorted in one
    task: ranges before it are summed, and only within its range are rows ranked.
    """
    drawn = rows.withColumn("_d", keyed_draw(F.col(key), seed)).withColumn("_r", F.expr("_d div 16777216"))
    counts = drawn.groupBy(*strata, "_r").agg(F.count("*").alias("_n"))
    every, before = W.partitionBy(*strata), W.partitionBy(*strata).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(s).alias(f"_s_{s}") for s in strata], F.col("_r").alias("_q"), F.sum("_n").over(every).alias("_all"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(W.partitionBy(*strata, "_r").orderBy("_d", key))
    ranked = drawn.withColumn("_at", at)
    same = [F.col(s).eqNullSafe(F.col(f"_s_{s}")) for s in strata] + [F.col("_r") == F.col("_q")]
    joined = ranked.join(counts, same)
    place, upto, out = F.col("_before") + F.col("_at"), 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share
        due = place <= F.round(F.lit(upto) * F.col("_all"))
        out = F.when(due, F.lit(name)) if out is None else out.when(due, F.lit(name))
    return joined.withColumn("part", out.otherwise(F.lit(list(shares)[-1]))).select(*rows.columns, "part")


def rolling_origins(rows: DataFrame, at: Column, origins: list, horizon: Column) -> DataFrame:
    """(row columns, origin, part): a row trains every origin after it, and tests those whose horizon it falls into."""
    each = rows.withColumn("_at", at).withColumn("origin", F.explode(F.array(*origins)))
    part = F.when(F.col("_at") < F.col("origin"), "train").when(F.col("_at") < F.col("origin") + horizon, "test")
    return each.withColumn("part", part).filter("part IS NOT NULL").drop("_at")


def bootstrap(rows: DataFrame, key: str, seed: int, draws: int) -> DataFrame:
    """(draw, row columns, times): Poisson bootstrap; each row's count in each draw depends on its key alone."""
    u = keyed_draw(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("draw").cast("string")), seed) / F.lit(float(1 << 32))
    cuts, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(7):
        total += term / max(1, math.factorial(k))
        cuts.append(total)
    times = sum((u >= F.lit(c)).cast("int") for c in cuts)
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", times).filter("times > 0")


def leakage(rows: DataFrame, part: str, key: str, group: str, content: Column, at: str, known: str, target: str, feature: str) -> DataFrame:
    """(kind, n): counts of what lets the training part know the other.

    duplicate_row, duplicate_content, shared_group (the same in training and another part),
    future_train (training rows not older than the oldest test row), late_feature (known after the
    row's own time), target_copy (a feature equal to the target), unassigned (no part), repeated_key.
    Groups are compared by counts per hash or key, never collected.
    """
    train = F.col(part) == "train"

    def shared(by: Column, kind: str) -> DataFrame:
        seen = rows.filter(F.col(part).isNotNull()).groupBy(by.alias("_k")).agg(F.bool_or(train).alias("_a"), F.bool_or(~train).alias("_b"))
        return seen.agg(F.count_if(F.col("_k").isNotNull() & F.col("_a") & F.col("_b")).alias("n")).select(F.lit(kind).alias("kind"), "n")

    digest = F.sha2(content, 256)
    oldest = rows.filter(~train).agg(F.min(at).alias("_oldest"))
    future = rows.filter(train).crossJoin(F.broadcast(oldest)).agg(F.count_if(F.col(at) >= F.col("_oldest")).alias("n")).select(F.lit("future_train").alias("kind"), "n")
    flat = rows.agg(
        F.count_if(F.col(known) > F.col(at)).alias("late_feature"), F.count_if(F.col(feature) == F.col(target)).alias("target_copy"), F.count_if(F.col(part).isNull()).alias("unassigned")
    )
    flat = flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in flat.columns])))
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("n")).select(F.lit("repeated_key").alias("kind"), "n")
    exact = shared(F.sha2(F.concat_ws("|", F.col(group).cast("string"), F.col(target).cast("string"), digest), 256), "duplicate_row")
    out = exact.unionByName(shared(digest, "duplicate_content")).unionByName(shared(F.col(group).cast("string"), "shared_group"))
    return out.unionByName(future).unionByName(flat).unionByName(again)


def domain_status(train: DataFrame, rows: DataFrame, columns: list[str], margin: float = 0.0) -> DataFrame:
    """Adds ``status``: InDomain if all columns lie in the training rows' ranges, widened by a share of them."""
    fitted = train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    inside = [F.col(c).between(F.col(f"_lo_{c}") - margin * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.col(f"_hi_{c}") + margin * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))) for c in columns]
    all_in = inside[0]
    for x in inside[1:]:
        all_in = all_in & x
    return rows.crossJoin(F.broadcast(fitted)).withColumn("status", F.when(all_in, "InDomain").otherwise("OutOfDomain")).drop(*fitted.columns)


def adjusted_effect(rows: DataFrame, treated: str, outcome: str, strata: list[str]) -> DataFrame:
    """The effect of ``do(treated)`` by back-door adjustment: differences within strata, weighed by their sizes.

    Strata without both arms identify nothing; their share of rows is reported as ``unidentified``.
    """
    y = F.col(outcome).cast("decimal(20,4)")
    arms = rows.groupBy(*strata).agg(
        F.count("*").alias("n"), F.count_if(treated).alias("n1"), F.sum(F.when(F.col(treated), y)).cast("double").alias("y1"), F.sum(F.when(~F.col(treated), y)).cast("double").alias("y0")
    )
    both = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    diff = F.when(both, F.col("y1") / F.col("n1") - F.col("y0") / (F.col("n") - F.col("n1")))
    return arms.agg(F.try_divide(F.sum(F.col("n") * diff), F.sum(F.when(both, F.col("n")))).alias("effect"), (F.sum(F.when(both, 0).otherwise(F.col("n"))) / F.sum("n")).alias("unidentified"))


def feature_values(rows: DataFrame, entity: str, at: str, features: dict[str, Column], version: str) -> DataFrame:
    """(feature, version, entity, observed_at, value): a feature set as records, one per feature and row."""
    each = F.array(*[F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value")) for name, value in features.items()])
    return rows.select(F.col(entity).alias("entity"), F.col(at).alias("observed_at"), F.inline(each)).withColumn("version", F.lit(version))


#: Which stage of a model may follow which. Fixed values.
LIFECYCLE = {"registered": ("shadow", "retired"), "shadow": ("live", "retired"), "live": ("shadow", "retired"), "retired": ()}


def lifecycle(moves: DataFrame, model: list[str], order: list[str], stage: str) -> DataFrame:
    """Adds ``was`` and ``legal``: whether each move of a model follows from the stage before it."""
    was = F.lag(stage).over(W.partitionBy(*model).orderBy(*order))
    allowed = [f"{a}>{b}" for a, rest in LIFECYCLE.items() for b in rest]
    legal = F.when(F.col("was").isNull(), F.col(stage) == "registered").otherwise(F.concat(F.col("was"), F.lit(">"), F.col(stage)).isin(allowed))
    return moves.withColumn("was", was).withColumn("legal", legal)
