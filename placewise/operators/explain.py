"""Why a place ranks where it does: contributions, picks, sentences, prices, budgets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import COMMUTE_BAD, CRITERIA, HIGHLIGHT_MIN, INDICATORS, PRICE, WARNING_MAX, Indicator
from ..functions.norm import half_even
from ..functions.text import display_value, render
from .ranking import top_per_group


def contributions(rows: DataFrame, medians: DataFrame, keys: Sequence[str] = ("request_id", "cell_id")) -> DataFrame:
    """(keys, i, criterion, k): weight share times distance from the city median, rated criteria only."""
    names = "array(" + ", ".join(f"'{c}'" for c in CRITERIA) + ")"
    long = (rows.selectExpr(*keys, "cw", "lv", "total_w", "posexplode(crit) AS (i, sc)")
            .where("sc IS NOT NULL AND cw[i] > 0 AND lv[i] > 0"))
    m = medians.select("request_id", "i", "median")
    return (long.join(m, ["request_id", "i"]).selectExpr(
        *keys, "i", f"{names}[i] AS criterion", "cw[i] * (sc - median) / total_w AS k"))


def indicator_rows(rows: DataFrame, specs: Sequence[Indicator], keys: Sequence[str]) -> DataFrame:
    """One row per indicator of each picked place, with spec attributes."""
    attr = ", ".join(f"struct({j} AS j, '{s.key}' AS ikey, '{s.column}' AS col, '{s.criterion}' AS criterion, "
                     f"'{s.unit}' AS unit, {s.decimals} AS decimals, {str(s.no_warning).lower()} AS nowarn, "
                     f"{str(s.is_alias).lower()} AS is_alias)" for j, s in enumerate(specs))
    return (rows.selectExpr(*keys, "s", "raw", "imputed", "w", "coverage", "median", f"inline(array({attr}))")
            .selectExpr(*keys, "j", "ikey", "col", "criterion", "unit", "decimals", "nowarn", "is_alias",
                        "s[j] AS s", "raw[j] AS v", "imputed[j] AS imputed", "w[j] AS w", "coverage[j] AS coverage",
                        "median[j] AS med"))


def picks(rows: DataFrame, specs: Sequence[Indicator] = INDICATORS,
          keys: Sequence[str] = ("request_id", "cell_id")) -> DataFrame:
    """Best (score >= 60) and worst (score <= 40, no 'no warning' indicator) measured indicator per criterion;
    commute: the nearest and the farthest reachable anchor."""
    long = indicator_rows(rows, specs, keys).where("w > 0 AND NOT imputed AND v IS NOT NULL")
    payload = "struct(col, v, unit, decimals, s, j)"
    best = f"max_by({payload}, struct(w * s, w, -j)) FILTER (WHERE s >= {HIGHLIGHT_MIN}D)"
    worst = f"min_by({payload}, struct(s, -w, j)) FILTER (WHERE s <= {WARNING_MAX}D AND NOT nowarn)"
    ind = long.groupBy(*keys, "criterion").agg(F.expr(best).alias("best"), F.expr(worst).alias("worst"))
    ind = ind.selectExpr(*keys, "criterion", "inline(array(struct('best' AS kind, best AS p), struct('worst' AS kind, worst AS p)))")
    ind = ind.where("p IS NOT NULL").selectExpr(*keys, "criterion", "kind", "p.col AS indicator", "p.v AS value",
                                                 "p.unit AS unit", "p.decimals AS decimals", "cast(NULL AS string) AS anchor",
                                                 "cast(NULL AS string) AS mode")
    a = (rows.where("anchor_slots IS NOT NULL").selectExpr(*keys, "anchors", "explode(minutes) AS (pos, m)")
         .selectExpr(*keys, "pos", "m", "coalesce(anchors[pos].label, anchors[pos].id) AS anchor", "anchors[pos].mode AS mode")
         .groupBy(*keys).agg(F.expr("min_by(struct(anchor, mode, m), struct(m, pos))").alias("best"),
                             F.expr("max_by(struct(anchor, mode, m), struct(m, -pos))").alias("worst"))
         .selectExpr(*keys, "inline(array(struct('best' AS kind, best AS p), struct('worst' AS kind, worst AS p)))")
         .selectExpr(*keys, "'commute' AS criterion", "kind", "cast(NULL AS string) AS indicator",
                     "cast(p.m AS double) AS value", "'min' AS unit", "0 AS decimals", "p.anchor AS anchor", "p.mode AS mode"))
    return ind.unionByName(a)


def highlights_and_warnings(contrib: DataFrame, picked: DataFrame, keys: Sequence[str] = ("request_id", "cell_id"),
                            n_high: int = 2, n_warn: int = 1) -> DataFrame:
    """The strongest positive criteria that have a pick, and the most negative one."""
    c = contrib.withColumn("kind", F.when(F.round("k", 9) > 0, "best").when(F.round("k", 9) < 0, "worst"))
    hit = c.where("kind IS NOT NULL").join(picked, [*keys, "criterion", "kind"])
    order = [F.when(F.col("kind") == "best", -F.round("k", 9)).otherwise(F.round("k", 9)),
             F.when(F.col("kind") == "best", F.col("i")).otherwise(-F.col("i"))]
    limit = F.when(F.col("kind") == "best", n_high).otherwise(n_warn)
    top = top_per_group(hit, [*keys, "kind"], order, max(n_high, n_warn), "pos").where(F.col("pos") <= limit)
    return top.withColumn("kind", F.when(F.col("kind") == "best", "highlight").otherwise("warning"))


def sentences(picked: DataFrame, templates: DataFrame, mode_phrases: DataFrame, lang: Column) -> DataFrame:
    """Text from raw values.  ``templates``: (indicator, lang, text), the indicator NULL for the commute template."""
    p = picked.withColumn("lang", lang)
    shown = display_value(F.col("value"), F.col("unit"), F.col("lang"), F.col("decimals"))
    t = templates.select(F.coalesce("indicator", F.lit("commute")).alias("__i"), "lang", F.col("text").alias("template"))
    p = p.withColumn("__i", F.coalesce("indicator", F.lit("commute"))).join(t, ["__i", "lang"], "left").drop("__i")
    p = p.join(mode_phrases.select("mode", "lang", "phrase"), ["mode", "lang"], "left")
    return p.withColumn("text", render(F.col("template"), value=shown, anchor=F.col("anchor"),
                                       mode=F.col("phrase"))).drop("template", "phrase")


def price_index(specs: Sequence[Indicator], what: str, default: str = "NULL") -> str:
    """SQL choosing a slot of an array column by the city's price indicator."""
    idx = {s.key: j for j, s in enumerate(specs)}
    arms = " ".join(f"WHEN city = '{c}' THEN {what}[{idx[p[0]]}]" for c, p in PRICE.items() if p[0] in idx)
    return f"CASE {arms} ELSE {default} END" if arms else default


def price_and_budget(rows: DataFrame, specs: Sequence[Indicator], value: Column | None = None) -> DataFrame:
    """Adds price (own value, else the city median), price_imputed, currency and the area the budget buys."""
    raw = F.expr(price_index(specs, "raw")) if value is None else value
    rows = rows.withColumn("__v", raw).withColumn("__m", F.expr(price_index(specs, "median"))) \
               .withColumn("__c", F.expr(price_index(specs, "coverage")) > 0)
    rows = rows.withColumn("price", F.when(F.col("__c"), half_even(F.coalesce("__v", "__m"), 1))) \
               .withColumn("price_imputed", F.when(F.col("__c"), F.col("__v").isNull()))
    cur = " ".join(f"WHEN '{c}' THEN '{p[3]}'" for c, p in PRICE.items())
    field = " ".join(f"WHEN '{c}' THEN budget.{p[2]}" for c, p in PRICE.items())
    return (rows.withColumn("currency", F.expr(f"CASE city {cur} END"))
            .withColumn("budget_m2", F.expr(f"cast(bround(round(try_divide(CASE city {field} END, nullif(price, 0)), 9), 0) AS long)"))
            .drop("__v", "__m", "__c"))


def imputed_columns(specs: Sequence[Indicator]) -> Column:
    """Sorted columns that were filled in although they carry weight in an included criterion."""
    ci = {c: i for i, c in enumerate(CRITERIA)}
    parts = ", ".join(f"CASE WHEN imputed[{j}] AND w[{j}] > 0 AND cw[{ci[s.criterion]}] > 0 THEN '{s.column}' END"
                      for j, s in enumerate(specs))
    return F.expr(f"array_sort(array_distinct(filter(array({parts}), x -> x IS NOT NULL)))")


def spoken(rows: DataFrame, medians: DataFrame, specs: Sequence[Indicator], templates: DataFrame, mode_phrases: DataFrame, lang: Column,
           keys: Sequence[str] = ("request_id", "cell_id")) -> DataFrame:
    """(keys, kind, pos, criterion, indicator, value, text): highlights and warnings of places or groups in one language."""
    hw = highlights_and_warnings(contributions(rows, medians, keys), picks(rows, specs, keys), keys)
    return sentences(hw, templates, mode_phrases, lang)


def rounded_criteria(crit: str = "crit") -> Column:
    """'criterion:score' of the criteria that have one, in order, rounded half to even."""
    names = "array(" + ", ".join(f"'{c}'" for c in CRITERIA) + ")"
    return F.expr(f"array_join(filter(transform({crit}, (x, i) -> CASE WHEN x IS NOT NULL THEN concat({names}[i], ':', cast(bround(round(x, 9), 0) AS int)) END), t -> t IS NOT NULL), ',')")


def anchor_times() -> Column:
    """Per anchor of the request: id, label, minutes (NULL if unreachable) and mode, in the request's order."""
    return F.expr("transform(anchors, (a, p) -> struct(a.id AS id, a.label AS label, "
                  "try_element_at(minutes, p) AS minutes, a.mode AS mode))")


__all__ = ["COMMUTE_BAD", "anchor_times", "contributions", "highlights_and_warnings", "imputed_columns",
           "indicator_rows", "picks", "price_and_budget", "price_index", "sentences"]
