"""Cell table -> prepared cells: plausibility, imputation, coverage and percentiles, all per city."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AUX_COLUMNS, CELL_ID_COLUMNS, INDICATORS, PLAUSIBLE, Indicator
from ..session import written
from .ranking import medians
from .runs import rank_runs

IDENTITY = ("city", "cell_id", "lat", "lon", "habitable", "district_id", "district_name", "neighborhood",
            "population_est")


def present(cells: DataFrame, specs: Sequence[Indicator] = INDICATORS) -> list[Indicator]:
    """Indicators whose column exists; the others have no coverage and never enter a mean."""
    have = set(cells.columns)
    return [s for s in specs if s.column in have]


def raw_value(spec: Indicator, clean: bool = True) -> str:
    """SQL for one raw value: NaN -> NULL, outside the physical range of its unit -> NULL, other city -> NULL."""
    c = f"cast(`{spec.column}` as double)"
    tests = [f"NOT isnan({c})"]
    lim = PLAUSIBLE.get(spec.unit)
    if clean and lim and not spec.is_alias:
        tests.append(f"{c} BETWEEN {lim[0]}D AND {lim[1]}D")
    if clean and spec.city:
        tests.append(f"city = '{spec.city}'")
    return f"CASE WHEN {' AND '.join(tests)} THEN {c} END"


def raw_array(specs: Sequence[Indicator], clean: bool = True) -> Column:
    return F.expr("array(" + ", ".join(raw_value(s, clean) for s in specs) + ")")


def long_values(cells: DataFrame, specs: Sequence[Indicator], clean: bool = True) -> DataFrame:
    """One row per (city, cell, indicator) with its raw value."""
    names = "array(" + ", ".join(f"'{s.key}'" for s in specs) + ")"
    return (cells.select("city", "cell_id", "habitable", F.posexplode(raw_array(specs, clean)).alias("j", "v"))
            .selectExpr("city", "cell_id", "habitable", "j", f"{names}[j] AS indicator", "v"))


def median_and_coverage(long: DataFrame) -> DataFrame:
    """(city, j, indicator) -> median over habitable cells, share of habitable cells with a value."""
    hab = long.where("habitable")
    cov = hab.groupBy("city", "j", "indicator").agg(
        F.avg(F.col("v").isNotNull().cast("double")).alias("coverage"), F.count("v").alias("n_values"))
    return cov.join(medians(hab, ["city", "j"], "v"), ["city", "j"], "left")


def city_stats(stats: DataFrame, k: int) -> DataFrame:
    """One row per city with median / coverage arrays in spec order (k entries: bounded)."""
    per_city = stats.groupBy("city").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "median"))).alias("m"),
        F.map_from_entries(F.collect_list(F.struct("j", "coverage"))).alias("c"))
    return per_city.selectExpr("city", f"transform(sequence(0, {k - 1}), j -> m[j]) AS median",
                               f"transform(sequence(0, {k - 1}), j -> coalesce(c[j], 0.0D)) AS coverage")


def prepare(cells: DataFrame, specs: Sequence[Indicator] | None = None) -> DataFrame:
    """Cells with arrays in spec order: ``raw``, ``filled``, ``imputed``, ``pct`` (percentile score, NULL for other
    norms) and the city's ``median`` and ``coverage``.  Compute once per data version and write it; every request
    batch reads it without a further shuffle."""
    specs = list(specs or present(cells))
    k = len(specs)
    base = written(cells.select(*IDENTITY, raw_array(specs).alias("raw")), "raw")
    long = base.select("city", "cell_id", "habitable", F.posexplode("raw").alias("j", "v"))
    runs = rank_runs(long, ["city", "j"], "v", F.col("habitable"), ["cell_id"])
    # a missing value takes the median: its cells stand at the median among the habitable ones, those above it move up
    people = base.where("habitable").groupBy("city").agg(F.count("*").alias("of"))
    med = runs.hint(written(runs.quantiles({"median": 0.5}), "medians"))     # a row per city and indicator
    stats = (runs.around(med, "median").withColumnsRenamed({"lt": "m_lt", "le": "m_le"}).join(med, ["city", "j"])
             .join(runs.hint(people), "city").withColumn("missing", F.col("of") - F.col("n")))
    stats = runs.hint(written(stats, "stats"))
    inverse = [j for j, s in enumerate(specs) if s.norm == "inverse_percentile"]
    ranked = [j for j, s in enumerate(specs) if s.norm in ("percentile", "inverse_percentile")]

    def score(lt: Column, le: Column) -> Column:
        pct = (lt + le) / F.lit(2.0) / F.col("of") * 100.0
        return F.when(F.col("j").isin(inverse), 100.0 - pct).otherwise(pct)
    above = lambda test: F.when(test, F.col("missing")).otherwise(0)
    v, m = F.col("v"), F.col("median")
    pct = (runs.ranked().where(F.col("j").isin(ranked)).join(stats, ["city", "j"])
           .withColumn("s", score(F.col("lt") + above(v > m), F.col("le") + above(v >= m))))
    by_cell = pct.groupBy("city", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("j", "s"))).alias("__p"))
    per_city = stats.groupBy("city").agg(F.map_from_entries(F.collect_list(F.struct("j", F.struct(
        "median", (F.col("n") / F.col("of")).alias("coverage"), score(F.col("m_lt"), F.col("m_le") + F.col("missing")).alias("s"))))).alias("c"))
    slots = f"transform(sequence(0, {k - 1}), j -> c[j]"
    per_city = per_city.selectExpr("city", f"{slots}.median) AS median", f"coalesce({slots}.coverage), array())  AS __c", f"{slots}.s) AS __s")
    none = f"array_repeat(cast(NULL AS double), {k})"
    out = base.join(runs.hint(per_city), "city", "left").join(by_cell, ["city", "cell_id"], "left")
    out = out.selectExpr("* EXCEPT (median, __c, __s, __p)", f"coalesce(median, {none}) AS median", f"transform(coalesce(__c, {none}), x -> coalesce(x, 0.0D)) AS coverage",
                         "__s", "__p")
    of_rank = f"array({', '.join(str(j) for j in ranked)})" if ranked else "cast(array() AS array<int>)"
    return out.selectExpr("* EXCEPT (__s, __p)", "zip_with(raw, median, (r, m) -> coalesce(r, m)) AS filled", "transform(raw, r -> r IS NULL) AS imputed",
                          f"transform(sequence(0, {k - 1}), j -> CASE WHEN array_contains({of_rank}, j) THEN CASE WHEN raw[j] IS NULL THEN __s[j] ELSE __p[j] END END) AS pct")


def with_overrides(specs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per-city label and decimals replace the general ones where given."""
    return (specs.join(overrides, ["city", "indicator"], "left")
            .withColumn("label", F.coalesce("o_label", "label")).withColumn("decimals", F.coalesce("o_decimals", "decimals"))
            .drop("o_label", "o_decimals"))


def align(cells: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Contract columns in order: missing ones are added as NULL, others become ``aux.*`` and are kept only if they
    hold a value (one aggregate decides for all of them)."""
    ident = [c for c in ("city", *CELL_ID_COLUMNS) if c in cells.columns]
    have = set(cells.columns)
    named = {c: c if c in AUX_COLUMNS or c.startswith("aux.") else "aux." + c.replace(".", "_")
             for c in cells.columns if c not in ident and c not in expected}
    known = cells.agg(*[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(named)]).first() if named else []
    extra = sorted((new, c) for (c, new), n in zip(named.items(), known) if n)
    return cells.select(
        *ident, *[(F.col(f"`{c}`").cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in expected],
        *[F.expr(f"try_cast(`{c}` AS double)").alias(new) for new, c in extra])
