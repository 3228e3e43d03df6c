"""Data-quality reports: every check returns a DataFrame of findings, nothing is collected."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import AUX_COLUMNS, EXPECTED_RANGE, Indicator, expected_columns
from ..functions.norm import half_even


def spec_table(spark, specs: Sequence[Indicator]) -> DataFrame:
    rows = [(j, s.key, s.criterion, s.unit, s.weight, s.is_alias, s.city, s.cross_city) for j, s in enumerate(specs)]
    return spark.createDataFrame(rows, "j int, indicator string, criterion string, unit string, weight double, "
                                       "is_alias boolean, only_city string, cross_city boolean")


def weighted_coverage(stats: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """Per city and criterion the weighted share of habitable cells with data; below a half is flagged beta."""
    s = spec_table(stats.sparkSession, specs).drop("indicator")
    c = (stats.join(s, "j").where("NOT is_alias AND weight > 0 AND (only_city IS NULL OR only_city = city)")
         .groupBy("city", "criterion").agg((F.sum(F.col("weight") * F.col("coverage")) / F.sum("weight")).alias("c")))
    return c.select("city", "criterion", half_even(F.col("c"), 3).alias("coverage"),
                    (half_even(F.col("c"), 3) < 0.5).alias("beta"))


def plausible_table(spark, specs: Sequence[Indicator]) -> DataFrame:
    from ..config import PLAUSIBLE
    rows = [(j, *PLAUSIBLE[s.unit]) for j, s in enumerate(specs) if s.unit in PLAUSIBLE and not s.is_alias]
    return spark.createDataFrame(rows, "j int, lo double, hi double")


# ------------------------------------------------------------------ contract checks
def expected_schema(city: str) -> T.StructType:
    ident = T.StructType.fromDDL("cell_id string, lat double, lon double, habitable boolean, district_id string, "
                                 "district_name string, neighborhood string, population_est int")
    return T.StructType(list(ident) + [T.StructField(c, T.DoubleType()) for c in expected_columns(city)])


KINDS = {"string": "string", "double": "float", "float": "float", "boolean": "bool", "int": "int", "bigint": "int",
         "smallint": "int", "tinyint": "int", "void": "null"}


def check_schema(cells: DataFrame, city: str) -> DataFrame:
    """(city, column, problem): missing, unknown or wrongly typed columns.  Looks at the schema only."""
    want = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in expected_schema(city)}
    have = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in cells.schema if f.name != "city"}
    rows = [(city, c, "missing") for c in want if c not in have]
    rows += [(city, c, "missing") for c, cs in AUX_COLUMNS.items() if city in cs and c not in have]
    rows += [(city, c, f"{have[c]} instead of {k}") for c, k in want.items() if c in have and have[c] not in (k, "null")]
    rows += [(city, c, "unknown") for c in have if c not in want and c not in AUX_COLUMNS and not c.startswith("aux.")]
    return cells.sparkSession.createDataFrame(rows, "city string, column string, problem string")


def check_keys(cells: DataFrame, key: str = "cell_id", pattern: str = "^[0-9a-f]{15}$") -> DataFrame:
    """(city, problem, n): duplicate and malformed cell ids."""
    c = F.col(key).cast("string")
    per = cells.groupBy("city", key).agg(F.count("*").alias("n"), F.max((~c.rlike(pattern)).cast("int")).alias("bad"))
    return (per.groupBy("city").agg(F.count_if(F.col("n") > 1).alias("duplicate"), F.sum("bad").alias("malformed"))
            .selectExpr("city", "stack(2, 'duplicate', duplicate, 'malformed', malformed) AS (problem, n)"))


def check_ranges(long: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """Habitable values outside the expected range of their unit, extremes, and walk minutes above the cap."""
    rows = [(j, s.unit, *EXPECTED_RANGE[s.unit]) for j, s in enumerate(specs) if not s.is_alias]
    lim = long.sparkSession.createDataFrame(rows, "j int, unit string, lo double, hi double")
    v = F.col("v")
    return (long.where("habitable AND v IS NOT NULL").join(lim, "j").groupBy("city", "indicator", "unit").agg(
        F.avg((~v.between(F.col("lo"), F.col("hi"))).cast("double")).alias("outside"), F.min(v).alias("min"), F.max(v).alias("max"))
        .withColumn("above_cap", (F.col("unit") == "min") & (F.col("max") > 60.0001)))


def check_nulls(long: DataFrame, warn: float = 0.2) -> DataFrame:
    """Share of unknown habitable values per indicator: ok, warning above 20 %, dropped when nothing is known."""
    share = F.avg(F.col("v").isNull().cast("double"))
    return (long.where("habitable").groupBy("city", "indicator").agg(share.alias("null_share"))
            .withColumn("status", F.when(F.col("null_share") == 1, "dropped").when(F.col("null_share") > warn, "warning").otherwise("ok")))


def check_vocabulary(points: DataFrame, vocab: DataFrame) -> DataFrame:
    return points.join(vocab, "category", "left_anti").groupBy("category").agg(F.count("*").alias("n"))


def check_foreign_keys(child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str], name: str) -> DataFrame:
    """(name, missing): distinct child keys without a parent."""
    p = parent.select(*[F.col(b).alias(a) for a, b in zip(child_key, parent_key)]).distinct()
    return (child.select(*child_key).distinct().join(p, list(child_key), "left_anti")
            .agg(F.count("*").alias("missing")).select(F.lit(name).alias("name"), "missing"))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """Entries without a key or with an unknown status."""
    bad = F.col("key").isNull() | F.coalesce(~F.col("status").isin("ok", "fallback", "missing"), F.lit(True))
    return manifest.where(bad)


def same_flags(a: DataFrame, b: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """(only_left, only_right, differing): two tables must hold the same keys with the same flag."""
    l, r = a.select(*key, F.col(flag).alias("l")).withColumn("inl", F.lit(1)), b.select(*key, F.col(flag).alias("r")).withColumn("inr", F.lit(1))
    return l.join(r, list(key), "full_outer").agg(
        F.count_if(F.col("inr").isNull()).alias("only_left"), F.count_if(F.col("inl").isNull()).alias("only_right"),
        F.count_if(F.col("inl").isNotNull() & F.col("inr").isNotNull() & ~F.col("l").eqNullSafe(F.col("r"))).alias("differing"))


def coverage_report(stats: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """Per city and criterion: weighted coverage and indicators with data out of all."""
    s = spec_table(stats.sparkSession, specs).drop("indicator")
    use = stats.join(s, "j").where("NOT is_alias AND weight > 0 AND (only_city IS NULL OR only_city = city)")
    return use.groupBy("city", "criterion").agg(
        half_even(F.sum(F.col("weight") * F.col("coverage")) / F.sum("weight"), 3).alias("coverage"),
        F.count_if(F.col("coverage") > 0).alias("with_data"), F.count("*").alias("total"))


def health(regions: DataFrame) -> DataFrame:
    """ok only if every region is backed by real data."""
    return regions.agg(F.when(F.bool_and(F.col("source") == "real"), "ok").otherwise("degraded").alias("status"),
                       F.count("*").alias("regions"))


def check_translations(texts: DataFrame, langs: int = 4) -> DataFrame:
    """Paths (path, lang, text) that lack a language or whose variables differ between languages."""
    v = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\{(\w+)\}\}"), F.lit(1))))
    t = texts.where("text <> ''").withColumn("vars", F.array_join(v, ","))
    return (t.groupBy("path").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("vars").alias("forms"))
            .where((F.col("langs") < langs) | (F.col("forms") > 1)))


def sanity(assertions: Sequence[DataFrame]) -> DataFrame:
    """Assertion rows (name, passed, detail) of a region, stacked."""
    out = assertions[0]
    for a in assertions[1:]:
        out = out.unionByName(a)
    return out.select("name", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("result"), "detail")
