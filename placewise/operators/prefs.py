"""Preference learning: contrasting pairs to show, and level weights from the choices of many users."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import CRITERIA
from ..session import cut
from .ranking import quantiles

CHOICE_CRITERIA = tuple(c for c in CRITERIA if c != "commute")


def contrasting_pairs(long: DataFrame, n: int, criteria: Sequence[str]) -> DataFrame:
    """(city, pair, high, low): per pair one cell at or above the 80th and one at or below the 20th percentile of a
    rotating criterion.  ``long``: habitable (city, cell_id, criterion, s).  The draw is an arithmetic hash."""
    qs = quantiles(long, ["city", "criterion"], "s", {"p20": 0.2, "p80": 0.8}).drop("n")
    focus = long.sparkSession.createDataFrame([(p, criteria[p % len(criteria)]) for p in range(n)], "pair int, criterion string")
    c = long.join(qs, ["city", "criterion"]).join(F.broadcast(focus), "criterion")     # n rows
    h = F.pmod(F.col("cell_id").cast("long") * 7919 + F.col("pair") * 31 + 7, F.lit(10_007))
    c = c.select("city", "pair", "cell_id", h.alias("h"), (F.col("s") >= F.col("p80")).alias("hi"), (F.col("s") <= F.col("p20")).alias("lo"))
    pick = lambda cond: F.min(F.when(F.col(cond), F.struct("h", "cell_id")))
    return c.groupBy("city", "pair").agg(pick("hi").alias("hi"), pick("lo").alias("lo")).select(
        "city", "pair", F.col("hi.cell_id").alias("high"), F.col("lo.cell_id").alias("low"))


def shown(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(city, id, cell_a, cell_b, a, b): the pairs as they are put to a user. The higher cell is first in every other pair, so its
    place tells nothing; ``a`` and ``b`` are the whole scores of both sides. ``scores``: (city, cell_id, scores)."""
    even = F.col("pair") % 2 == 0
    p = pairs.select("city", F.concat(F.lit("p"), (F.col("pair") + 1).cast("string")).alias("id"), F.when(even, F.col("high")).otherwise(F.col("low")).alias("cell_a"),
                     F.when(even, F.col("low")).otherwise(F.col("high")).alias("cell_b"))
    for side in "ab":
        p = p.join(scores.select("city", F.col("cell_id").alias(f"cell_{side}"), F.col("scores").alias(side)), ["city", f"cell_{side}"])
    return p.select("city", "id", "cell_a", "cell_b", "a", "b")


def _newton(d: int):
    """One Newton step per user row (w, gradient, packed upper Hessian), a batch of users at once."""
    iu = np.triu_indices(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, g, h = (np.array(b[c].tolist(), float).reshape(len(b), -1) for c in "wgh")
            m = np.zeros((len(b), d, d))
            m[:, iu[0], iu[1]] = m[:, iu[1], iu[0]] = h
            moved = np.linalg.solve(m + np.eye(d), (g + w)[..., None])[..., 0] if len(b) else w
            yield pd.DataFrame({"user": b["user"], "w": (w - moved).tolist()})
    return run


def fit_preferences(choices: DataFrame, criteria: Sequence[str] = CHOICE_CRITERIA, rounds: int = 30, tol: float = 1e-6) -> DataFrame:
    """(user, levels map, confidence): ridge logistic regression without intercept on the differences a - b, all users
    in the same Newton rounds.

    ``choices``: (user, a map, b map, choice 'a'|'b').  Each choice counts twice (a over b and its mirror image).  Equal
    choices of a user are folded first; gradients and Hessians are sums, combined map-side, so a user with very many
    choices costs no single task more than the others.  Only one row per user reaches Python."""
    d = len(criteria)
    diff = "array(" + ", ".join(f"(coalesce(a['{c}'], 50D) - coalesce(b['{c}'], 50D)) / 100D" for c in criteria) + ")"
    sign = "CASE WHEN choice = 'a' THEN 1D ELSE -1D END"
    x = (choices.selectExpr("user", f"{diff} AS d", f"{sign} AS sgn").selectExpr("user", "transform(d, v -> v * sgn) AS x")
         .groupBy("user", "x").agg(F.count("*").alias("n")))
    x = cut(x)
    types = {f.name: f.dataType.simpleString() for f in choices.schema}
    w = cut(x.select("user").distinct().select("user", F.array_repeat(F.lit(0.0), d).alias("w")))
    dot = "aggregate(zip_with(x, w, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    for _ in range(rounds):
        j = x.join(w, "user").selectExpr("user", "x", "n", f"1D / (1D + exp({dot})) AS miss")     # 1 - sigma(w.x)
        grad = F.array(*[F.sum(-2.0 * F.col("n") * F.col("miss") * F.col("x")[i]) for i in range(d)])
        hess = F.array(*[F.sum(2.0 * F.col("n") * F.col("miss") * (1 - F.col("miss")) * F.col("x")[i] * F.col("x")[k])
                         for i, k in zip(*(a.tolist() for a in np.triu_indices(d)))])
        step = j.groupBy("user").agg(grad.alias("g"), hess.alias("h")).join(w, "user")
        new = cut(step.select("user", "w", "g", "h").mapInPandas(_newton(d), f"user {types['user']}, w array<double>"))
        moved = new.join(w.withColumnRenamed("w", "w0"), "user").agg(F.max(F.expr(
            "array_max(zip_with(w, w0, (p, q) -> abs(p - q)))"))).first()[0]
        w = new
        if moved is None or moved < tol:
            break
    else:
        raise RuntimeError(f"preferences did not converge in {rounds} rounds")
    top = "CASE WHEN array_max(w) > 0 THEN array_max(w) ELSE 1D END"
    level = f"CASE WHEN v > 0 THEN cast(least(greatest(bround(round(1 + 4 * v / ({top}), 6), 0), 1), 5) AS int) ELSE 0 END"
    names = "array(" + ", ".join(f"'{c}'" for c in criteria) + ")"
    right = x.join(w, "user").selectExpr("user", "n", f"CASE WHEN {dot} > 1e-12 THEN 1D WHEN {dot} < -1e-12 THEN 0D ELSE 0.5D END AS ok")
    acc = right.groupBy("user").agg(F.round(F.sum(F.col("ok") * F.col("n")) / F.sum("n"), 3).alias("confidence"))
    return w.selectExpr("user", f"map_from_arrays({names}, transform(w, v -> {level})) AS levels", "w").join(acc, "user")


__all__ = ["CHOICE_CRITERIA", "contrasting_pairs", "fit_preferences"]
