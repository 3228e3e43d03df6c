"""URL filters: rules for hosts and paths, and gradient-boosted trees on lexical features for URLs no rule fits.

The trees learn from labelled URLs (here: those that rules decide). Features are length, depth, digit ratio, entropy of the
characters, counts of parameters, host labels and hyphens, and statistics of the host's suffixes over all labelled URLs: how
many carry the suffix and what share of them is blocked. DataFrame and MLlib operations only.
"""
from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_per, saved

SAMPLE = 10_000       # labelled URLs the trees are fitted on, about
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "hyphens", "tld_n", "tld_block", "site_n", "site_block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path) that fits the columns host and path, as struct(rule, verdict) or null.
    A rule fits its host and all subdomains where the path starts with the rule's. Rules are a list of the caller's."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    out = none
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = F.concat(F.lit("."), F.col("host")).endswith(f".{h}") & F.col("path").startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _features(pages: DataFrame) -> DataFrame:
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.array_distinct(F.split(u, ""))
    # entropy over code points: -sum p log2 p
    p = lambda c: (F.length(u) - F.length(F.replace(u, c))) / n
    entropy = F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), p), F.lit(0.0), lambda a, x: a - x * F.log2(x))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return pages.select("*", n.cast("double").alias("length"), F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
                        (F.regexp_count(u, F.lit("[0-9]")) / n).alias("digits"), entropy.alias("entropy"), F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("params"),
                        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("labels"), F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
                        F.substring_index("host", ".", -1).alias("tld"), F.substring_index("host", ".", -2).alias("site"))


def _suffixes(labelled: DataFrame, name: str) -> DataFrame:
    """Per suffix: logarithm of its labelled URLs and their share of blocks, drawn towards one half."""
    return labelled.groupBy(name).agg(F.log1p(F.count("*")).alias(f"{name}_n"), ((F.sum("block") + 5) / (F.count("*") + 10)).alias(f"{name}_block"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], sample: int = SAMPLE, id_col: str = "page_id") -> DataFrame:
    """``pages`` (id, url) as (id, host, path, rule, verdict).

    ``rule`` and ``verdict`` are those of the longest rule that fits; elsewhere rule is null and the trees say allow or block.
    Null URLs and URLs without ``://`` have empty host and path and are judged by the trees like any other. Where the labelled
    URLs show one verdict only (or there are none), all others are allowed. Repeated rows get equal results; other columns
    are ignored."""
    ruled = pages.select(F.col(id_col).alias("id"), "url", host("url").alias("host"), path("url").alias("path")).withColumn("r", rule_of(rules))
    ruled = saved(_features(ruled), "urls")
    labelled = ruled.where("r IS NOT NULL").withColumn("block", (F.col("r.verdict") == "block").cast("double"))
    stats = [saved(_suffixes(labelled, name), name) for name in ("tld", "site")]
    # statistics join on suffixes that may be very common: one row each on their side
    full = reduce(lambda d, s: d.join(s, s.columns[0], "left"), stats, ruled)
    full = full.fillna({"tld_n": 0.0, "tld_block": 0.5, "site_n": 0.0, "site_block": 0.5})
    rule = F.col("r.rule").alias("rule")
    keep = [F.col("id").alias(id_col), "host", "path", rule]
    learn = saved(bounded_per(full.where("r IS NOT NULL"), "id", sample, F.col("r.verdict")).withColumn("block", (F.col("r.verdict") == "block").cast("double")).select("block", *FEATURES), "learn")
    if learn.select("block").distinct().count() < 2:
        return ruled.select(*keep, F.coalesce("r.verdict", F.lit("allow")).alias("verdict"))
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(labelCol="block", featuresCol="features", maxIter=15, maxDepth=4, stepSize=0.2, seed=11, maxBins=32).fit(pack.transform(learn))
    said = trees.transform(pack.transform(full))
    return said.select(*keep, F.coalesce("r.verdict", F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"))
