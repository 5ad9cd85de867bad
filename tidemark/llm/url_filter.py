"""URL filters: path rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, store

#: (verdict, rule); of the rules that fit, the longest wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS = 4096
GRAM_SIZES = (3, 4, 5)
#: Words of hosts for the labelled table. Fixed values.
JUNK = (
    "adult ads bets bingo bitcoin bonus buy-now casino cheap cialis clickbait coupon crypto dating deal diet discount earn escort farm "
    "fastcash forex free gamble giveaway hack hookup instant jackpot keygen lottery loan lucky miracle milf nude offer payday pharma pills "
    "poker porn prize profit promo replica rich roulette sale scam sex slots spam sweepstakes track traffic viagra warez weightloss win winner xxx"
).split()
PLAIN = (
    "academy air animal archive art atlas bank book bridge calendar castle chemistry city climate club coast college community council course "
    "dance data dictionary docs earth energy engine family field film forest forum garden gazette guide harbor health heritage history home "
    "house institute journal kitchen language law letters library map market math medicine mountain museum music news ocean office opera park "
    "people physics planet poem press project public radio recipe research review river school science shop society sport station stone store "
    "story street student studio teacher theatre times tools town travel tree union university valley village voice water weather wiki world"
).split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, F.lit("://")), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"\A[^?#]*", 0)
    return ascii_lower(host), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits the host or a domain above it, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all character n-grams of host and path, with a mark between and at the ends."""
    s = F.concat(F.lit("<"), host, F.lit(">"), path, F.lit("$"))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(s) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(*[grams(n) for n in GRAM_SIZES])


def labelled_urls(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The small labelled table: host, path and label (1: block).

    Given a ``path``, it is the CSV file there, with these columns in a header. Otherwise it is built
    from the word lists by a rule. Block: hosts with a junk word, alone or beside any other word.
    Allow: hosts of ordinary words and of made-up names. Subdomains, endings and paths are dealt
    alike on both sides, so they tell nothing.
    """
    if path:
        return spark.read.schema("host string, path string, label int").option("header", "true").csv(path)
    names = [(a, 1) for a in JUNK] + [(a, 0) for a in PLAIN]
    for k in range(6):
        names += [(f"{a}-{(JUNK if k % 2 else PLAIN)[(7 * i + 11 * k) % 60]}", 1) for i, a in enumerate(JUNK)]
        names += [(f"{PLAIN[(5 * i + 13 * k) % 60]}-{a}", 1) for i, a in enumerate(JUNK)] if k < 2 else []
        names += [(f"{a}-{PLAIN[(7 * i + 11 * k + 1) % len(PLAIN)]}", 0) for i, a in enumerate(PLAIN)]
    parts = [a + b for a in ("b", "d", "th", "gr", "l", "m", "r", "st", "t", "") for b in ("a", "an", "e", "er", "in", "ion", "o", "or", "u", "y")]
    names += [("".join(parts[(17 * i + 29 * j * (1 + i // 100)) % 100] for j in range(1, 3 + i % 2)), 0) for i in range(1500)]
    before, after, ways = ["", "www.", "m.", "blog."], ["example.com", "example.org", "example.net"], ["/en/", "/de/", "/fr/", "/es/", "/"]
    rows = [(f"{before[k * 7 % 11 % 4]}{name}.{after[k * 5 % 7 % 3]}", f"{ways[k * 3 % 13 % 5]}{100 + 37 * k}", y) for k, (name, y) in enumerate(names)]
    values = ", ".join(f"('{h}', '{p}', {y})" for h, p, y in rows)
    # As a table of its own: rows typed in would be worked on by the optimizer, one by one.
    return store(spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, label)"), "labelled-urls")[0]


def held_out(host: Column) -> Column:
    """A fifth of the hosts that no fit sees, by a checksum."""
    return F.crc32(F.coalesce(host, F.lit("")).cast("binary")) % 5 == 0


def fit_url_model(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights per bucket and intercept, from the rows whose host isn't held out.

    The table is small by contract: some thousands of labelled URLs, which one task fits. Null hosts
    and paths count as empty; rows with another label than 0 or 1 are left out. With one label only,
    or none, the weights are zero and the intercept says the one label, or 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, Interaction

    usable = labelled.filter(F.col("label").isin(0, 1) & ~held_out(F.col("host"))).select("host", "path", "label")
    seen = usable.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if seen[0] == seen[1]:
        return [0.0] * buckets, 0.0 if seen[0] is None else 20.0 * (2 * seen[0] - 1)
    grams = usable.select("label", gram_buckets(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")), buckets).alias("m"))
    named = grams.select("label", F.col("m").cast("array<string>").alias("m"), (1 / F.sqrt(F.size("m").cast("double"))).alias("scale"))
    counted = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], "m", "counts").transform(named)
    rows = Interaction(inputCols=["scale", "counts"], outputCol="features").transform(counted)
    # Both labels weigh the same in all, whatever their shares of the table.
    weight = F.when(F.col("label") == 1, 0.5 / seen[2]).otherwise(0.5 / (1 - seen[2]))
    rows = rows.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "features").coalesce(1)
    model = LogisticRegression(regParam=0.0001, standardization=False, maxIter=60, weightCol="weight").fit(rows)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def score_urls(parts: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """Adds ``score``, how likely label 1 is, from host and path alone."""
    weights, intercept = model
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    buckets = F.col("_buckets")
    margin = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.sqrt(F.size(buckets).cast("double")) + F.lit(intercept)
    grams = gram_buckets(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")), len(weights))
    return parts.drop("score").withColumn("_buckets", grams).withColumn("score", 1 / (1 + F.exp(-margin))).drop("_buckets")


def held_out_auc(labelled: DataFrame, model: tuple[list[float], float]) -> float:
    """How often a held-out blocked URL scores above a held-out allowed one; ties count half.

    The window runs over the distinct scores of the small labelled table.
    """
    scored = score_urls(labelled.filter(F.col("label").isin(0, 1) & held_out(F.col("host"))), model)
    by_score = scored.groupBy("score").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    below = F.sum("zeros").over(Window.orderBy("score")) - F.col("zeros")
    return by_score.select("ones", "zeros", below.alias("below")).agg(F.sum(F.col("ones") * (F.col("below") + F.col("zeros") / 2)) / (F.sum("ones") * F.sum("zeros"))).first()[0]


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score and verdict to ``pages``.

    A null url or one without ``://`` has an empty host and path, which no rule fits; the model
    then judges the empty string, as it does any other. Repeated rows get equal verdicts; an empty
    table stays empty. Input columns with one of the five names are replaced.
    """
    model = fit_url_model(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = url_parts(F.col("url"))
    parts = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    found = F.col("_found")
    return (
        score_urls(parts, model).withColumn("_found", longest_rule(F.col("host"), F.col("path"), rules))
        .withColumn("rule", found["rule"])
        .withColumn("verdict", F.coalesce(found["verdict"], F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
        .drop("_found")
    )


def judged_urls(pages: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
