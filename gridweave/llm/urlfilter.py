"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

DataFrame and MLlib operations only.  A rule is ``host/path``; it fits its host and all
subdomains if the url's path starts with the rule's path, and the longest fitting rule decides.
URLs that a rule decides are also the labels: the trees are trained on a bounded sample of them
(``sample`` rows, by hash of the url) and decide where no rule fits.  Suffix statistics are the
smoothed block rates of the host's last label and last two labels over all labelled rows; in
training each row's own label is taken out of them.

Defined cases: a null url, or one without ``://``, has an empty host and path; without labels, or
with labels of one kind only, the rest is decided as ``allow`` or by that kind; repeated rows get
the same verdict; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, shared_dir, stored, table

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SAMPLE, TREES, DEPTH, SMOOTH, BROADCAST_ROWS, SEED = 20_000, 20, 4, 20.0, 100_000, 7
FEATURES = ["chars", "host_chars", "path_chars", "depth", "labels", "digits", "digit_ratio", "marks", "hyphens", "parameters", "has_query", "has_fragment", "secure", "entropy", "longest", "last_rate", "domain_rate"]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, u, host, path."""
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), u.alias("u"), ascii_lower(F.regexp_extract(u, parts, 1)).alias("host"), F.regexp_extract(u, parts, 2).alias("path"))


def decision(rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest fitting rule, else null; ties go to the earlier rule."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        on = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = on & F.startswith("path", F.lit(slash + path)) if slash + path else on
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def lexical(rows: DataFrame) -> DataFrame:
    u, host, path = F.col("u"), F.col("host"), F.col("path")
    count = lambda c, what: (F.length(c) - F.length(F.regexp_replace(c, what, ""))).cast("double")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    characters = F.array_sort(F.split(u, ""))
    # runs of equal characters in sorted order: their lengths from one pass
    tally = F.aggregate(
        characters, F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(c.alias("last"), F.when(c == a["last"], a["run"] + 1.0).otherwise(1.0).alias("run"), F.when(c == a["last"], a["sum"]).otherwise(a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0)))).otherwise(0.0)).alias("sum")),
        lambda a: a["sum"] + a["run"] * F.log2(F.greatest(a["run"], F.lit(1.0))),
    )
    names = F.split(host, "\\.")
    return rows.withColumns({
        "chars": F.length(u).cast("double"), "host_chars": F.length(host).cast("double"), "path_chars": F.length(path).cast("double"),
        "depth": count(path, "/"), "labels": F.size(names).cast("double"),
        "digits": count(u, "[0-9]"), "digit_ratio": count(u, "[0-9]") / n, "marks": count(u, "[^A-Za-z0-9]"), "hyphens": count(u, "-"),
        "parameters": count(F.regexp_extract(u, "(?s)\\?([^#]*)", 1), "=").cast("double"), "has_query": F.contains(u, F.lit("?")).cast("double"), "has_fragment": F.contains(u, F.lit("#")).cast("double"),
        "secure": F.startswith(u, F.lit("https://")).cast("double"), "entropy": F.log2(n) - tally / n,
        "longest": F.array_max(F.transform(F.split(u, "[^A-Za-z0-9]+"), lambda w: F.length(w))).cast("double"),
        "last": F.element_at(names, -1), "domain": F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), "."),
    })


def with_rates(rows: DataFrame, labelled: DataFrame, at: str, own: bool) -> DataFrame:
    """Adds the smoothed block rate of each suffix; ``own``: without the row's own label y."""
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("b")).first()
    prior = (total.b + 1) / (total.n + 2)
    for name in ("last", "domain"):
        path = f"{at}/{name}-{own}"
        stats = stored(labelled.groupBy(name).agg(F.sum("y").cast("double").alias("_b"), F.count("*").cast("double").alias("_n")), path)
        stats = F.broadcast(stats) if stats.count() <= BROADCAST_ROWS else stats
        mine = F.col("y").cast("double") if own else F.lit(0.0)
        b, n = F.coalesce("_b", F.lit(0.0)) - mine, F.coalesce("_n", F.lit(0.0)) - (1.0 if own else 0.0)
        rows = rows.join(stats, name, "left").withColumn(f"{name}_rate", (b + SMOOTH * prior) / (n + SMOOTH)).drop("_b", "_n")
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the trees, null where a rule decides)."""
    spark, at = pages.sparkSession, shared_dir(pages.sparkSession)
    rows = stored(lexical(parsed(pages)).withColumn("r", decision(rules)), f"{at}/rows")
    ruled = rows.where("r is not null").withColumn("y", (F.col("r.verdict") == "block").cast("int"))
    kinds = [r.y for r in ruled.select("y").distinct().limit(2).collect()]
    rest = rows.where("r is null")
    decided = ruled.select("page_id", "host", "path", "r.rule", "r.verdict", F.lit(None).cast("double").alias("score"))
    if len(kinds) < 2:
        other = "block" if kinds == [1] else "allow"
        return decided.union(rest.select("page_id", "host", "path", F.lit(None).cast("string"), F.lit(other), F.lit(1.0 if other == "block" else 0.0)))
    chosen = stored(ruled.orderBy(F.xxhash64("u", "page_id"), "u", "page_id").limit(sample), f"{at}/sample")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    known = vector.transform(with_rates(chosen, ruled, at, True)).select("features", F.col("y").cast("double").alias("label")).repartition(4)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.2, seed=SEED).fit(known)
    judged = trees.transform(vector.transform(with_rates(rest, ruled, at, False)))
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array("probability")[1]
    found = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(score >= 0.5, "block").otherwise("allow").alias("verdict"), score.alias("score"))
    return decided.union(found)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
