"""The best places of many requests without scoring every cell for every request twice.

Cells lie in square tiles, and a small table holds the bounds of every sub-score over each tile. A first look at one cell in
sixteen shows every request how good its k-th best neighbourhood is at least. The sum of a tile's upper bounds, weighted by the
request, says how good its cells can be: tiles that stay under the first look are not read for that request. The cells of the
others are scored once, those under the threshold leave at once, and the few that stay are ranked exactly.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CRITERIA, INDICATORS, MUST_HAVE, Indicator
from ..session import broadcast_if_small, written
from .ranking import top_per_group
from .scoring import lens, normalized, place_name, request_blocks, score_cells

TILE_CELLS = 256        # cells of a tile on average
PROBE = 16              # one cell in so many is looked at first
DEFAULT_LIMIT = 20
PAIRS = 2_000_000       # (request, tile) pairs to broadcast: 40 bytes each
SPARSE = 0.5            # tiles are picked by request where that leaves less than this share of the pairs


@dataclass(frozen=True)
class Tiles:
    """``cells``: prepared cells with their ``tile``, written. ``bounds``: per (city, tile, walk_factor) ``low`` and ``high`` of
    every sub-score over its habitable cells."""
    cells: DataFrame
    bounds: DataFrame


def tiled(prepared: DataFrame, tile_cells: int = TILE_CELLS) -> DataFrame:
    """Cells with the tile of their city's box they lie in; as many tiles as hold ``tile_cells`` cells on average."""
    box = prepared.groupBy("city").agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"), (F.max("lat") - F.min("lat")).alias("h"),
                                       (F.max("lon") - F.min("lon")).alias("w"), F.ceil(F.sqrt(F.count("*") / F.lit(float(tile_cells)))).alias("k"))
    at = lambda c, c0, size: F.least(F.floor((F.col(c) - F.col(c0)) / F.greatest(F.col(size), F.lit(1e-9)) * F.col("k")), F.col("k") - 1)
    tile = (at("lat", "lat0", "h") * F.col("k") + at("lon", "lon0", "w")).cast("int")
    return prepared.join(broadcast_if_small(box), "city").withColumn("tile", tile).drop("lat0", "lon0", "h", "w", "k")


def bounds(cells: DataFrame, specs: Sequence[Indicator] = INDICATORS) -> DataFrame:
    s = [f"s_{j}" for j in range(len(specs))]
    ends = normalized(cells.where("habitable"), specs).groupBy("city", "tile", "walk_factor").agg(
        *[F.min(c).alias(f"l{c}") for c in s], *[F.max(c).alias(f"h{c}") for c in s])
    return ends.select("city", "tile", "walk_factor", F.array(*[f"l{c}" for c in s]).alias("low"), F.array(*[f"h{c}" for c in s]).alias("high"))


def tiles(prepared: DataFrame, specs: Sequence[Indicator] = INDICATORS, tile_cells: int = TILE_CELLS) -> Tiles:
    """Both, written: once per data version."""
    cells = written(tiled(prepared, tile_cells), "tiles")
    return Tiles(cells, written(bounds(cells, specs), "tile-bounds"))


def reach(bound: str, commute: float, n: int) -> Column:
    """What a request's ordering value can be for cells whose sub-scores are all at ``bound`` and whose commute scores ``commute``."""
    weighted = lambda e: f"aggregate(zip_with({bound}, {e}, (a, b) -> a * b), 0.0D, (a, x) -> a + x)"
    match = f"{weighted('array(' + ', '.join(f'e_{j}' for j in range(n)) + ')')} + e_commute * {commute}D"
    i = CRITERIA.index("commute")
    return F.expr(f"CASE WHEN rankBy IS NULL THEN {match} WHEN rank_e IS NOT NULL THEN {weighted('rank_e')} "
                  f"WHEN rankBy = 'commute' AND den[{i}] > 0 THEN {commute}D WHEN rankBy LIKE 'anchor:%' THEN greatest(0.0D, {match}) ELSE {match} END")


ENDLESS, LARGEST = "cast('Infinity' AS double)", "1.7976931348623157E308D"


def _limit(c: str) -> str:
    """A filter's limit as a plain number: endless where the request sets none."""
    return f"CASE WHEN {c} IS NULL THEN {ENDLESS} ELSE least({c}, {LARGEST}) END"


def _plain(cells: DataFrame, compiled: DataFrame, specs: Sequence[Indicator], keep: Sequence[str], pairs: DataFrame | None) -> DataFrame:
    """Candidates of requests without anchors: sums of products and comparisons of plain columns, one compiled loop."""
    idx, n = {s.key: j for j, s in enumerate(specs)}, range(len(specs))
    must = [(f"must_{c}", idx[col]) for c, (col, _) in MUST_HAVE.items() if col in idx]
    own = [c for c in keep if c != "score"]
    values = [("price_value", "price_value"), ("noise_value", "noise_value"), *[(m, f"raw[{j}]") for m, j in must]]
    narrow = normalized(cells.where("habitable"), specs).selectExpr(
        "city", "walk_factor", "cell_id", "district_id", *(["tile"] if pairs is not None else []), *[c for c in own if c not in ("city", "cell_id", "district_id")],
        "coalesce(CASE WHEN neighborhood != '' THEN neighborhood END, district_name) AS group", *[f"coalesce(s_{j}, 0.0D) AS s_{j}" for j in n],
        *[f"coalesce({e}, {ENDLESS}) AS v_{m}" for m, e in values])
    asks = compiled.where("anchor_slots IS NULL").selectExpr(
        "request_id", "city", "walk_factor", "district", "total_w > 0 AS weighed", "rank_e IS NULL AS by_match", f"coalesce(limit, {DEFAULT_LIMIT}) AS limit",
        f"{_limit('price_limit')} AS l_price_value", f"{_limit('noise_limit')} AS l_noise_value", *[f"{_limit(m)} AS l_{m}" for m, _ in must],
        *[f"coalesce(e_{j}, 0.0D) AS e_{j}" for j in n], *[f"coalesce(rank_e[{j}], e_{j}, 0.0D) AS r_{j}" for j in n], *(["floor"] if "floor" in compiled.columns else []))
    by = ["city", "walk_factor"] if pairs is None else ["city", "walk_factor", "request_id"]
    narrow = narrow if pairs is None else narrow.join(pairs, ["city", "walk_factor", "tile"])
    total = lambda c: " + ".join([f"s_{j} * {c}_{j}" for j in n] or ["0.0D"])
    passing = " AND ".join(["(district IS NULL OR district_id = district)", *[f"v_{m} <= l_{m}" for m, _ in values]])
    parts = [narrow.join(block, by).where(passing) for block in request_blocks(asks)]
    df = reduce(DataFrame.unionByName, parts).selectExpr("*", f"CASE WHEN weighed THEN {total('e')} END AS mf").selectExpr(
        "*", f"CASE WHEN by_match THEN mf ELSE {total('r')} END AS lens")
    score = ["cast(least(greatest(bround(round(mf, 9), 0), 0.0D), 100.0D) AS int) AS score"] if "score" in keep else []
    return _over(df).selectExpr("request_id", "city", "cell_id", "group", "lens", "mf", "limit", *[c for c in own if c not in ("city", "cell_id")], *score, "l9")


def _over(df: DataFrame) -> DataFrame:
    df = df.withColumn("l9", F.round("lens", 9))
    return df.where("floor IS NULL OR l9 >= floor").drop("floor") if "floor" in df.columns else df


def _candidates(cells: DataFrame, compiled: DataFrame, minutes: DataFrame | None, specs: Sequence[Indicator], keep: Sequence[str] = (),
                pairs: DataFrame | None = None) -> DataFrame:
    """Passing cells in the requested district, at or above the request's ``floor`` if it has one, with group and ordering values."""
    out = _plain(cells, compiled, specs, keep, pairs)
    if minutes is None:
        return out
    scored = score_cells(cells, compiled.where("anchor_slots IS NOT NULL"), minutes, specs, pairs)
    return out.unionByName(_over(scored.where("passing").where("district IS NULL OR district_id = district").select(
        "request_id", "city", "cell_id", place_name().alias("group"), lens().alias("lens"), "mf", F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"),
        *[c for c in keep if c not in ("city", "cell_id")], *(["floor"] if "floor" in scored.columns else []))))


def most(compiled: DataFrame) -> int:
    """The largest limit of the requests: a literal, by which rows are pruned in the map tasks."""
    return compiled.agg(F.max(F.coalesce("limit", F.lit(DEFAULT_LIMIT)))).first()[0] or 0


def floors(candidates: DataFrame, largest: int) -> DataFrame:
    """(request_id, floor): the ordering value that ``limit`` groups reach already; requests with fewer groups are absent."""
    groups = candidates.groupBy("request_id", "group").agg(F.max("l9").alias("l9"), F.max("limit").alias("limit"))
    best = top_per_group(groups, ["request_id"], [F.desc("l9")], largest).where("rank = limit")
    return best.select("request_id", F.col("l9").alias("floor"))


def pairs(t: Tiles, compiled: DataFrame, specs: Sequence[Indicator]) -> DataFrame:
    """(request_id, city, walk_factor, tile): tiles in which a request can find a cell at or above its floor."""
    asks = compiled.select("request_id", "city", "walk_factor", "rankBy", "rank_e", "den", "e_commute", "floor", *[f"e_{j}" for j in range(len(specs))])
    both = t.bounds.join(broadcast_if_small(asks), ["city", "walk_factor"]).withColumn("high", reach("high", 100.0, len(specs)))
    return both.where("floor IS NULL OR high + 1e-6D >= floor").select("request_id", "city", "walk_factor", "tile")


def top_cells(t: Tiles, compiled: DataFrame, minutes: DataFrame | None = None, specs: Sequence[Indicator] = INDICATORS,
              keep: Sequence[str] = ()) -> DataFrame:
    """(request_id, city, cell_id, rank, lens, *keep): as ``scoring.top_cells`` of all scored cells, from the tiles that matter.

    Passing cells by lens, then match, then cell id; one per neighbourhood; the request's limit."""
    compiled = written(compiled.drop("median"), "requests")
    minutes = minutes if minutes is None else written(minutes, "minutes")
    largest = most(compiled)
    out = ["request_id", "city", "cell_id", "rank", "lens", *[c for c in keep if c not in ("city", "cell_id")]]
    first = t.cells.where(F.pmod(F.xxhash64("city", "cell_id"), F.lit(PROBE)) == 0)
    floor = written(floors(_candidates(first, compiled, minutes, specs), largest), "floors")
    compiled = written(compiled.join(broadcast_if_small(floor), "request_id", "left"), "requests")
    every, read = tiles_of(t, compiled), written(pairs(t, compiled, specs), "pairs")
    some = read.count() <= SPARSE * every
    found = _candidates(t.cells, compiled, minutes, specs, keep, broadcast_if_small(read, PAIRS) if some else None)
    return ranked(found, largest).select(*out)


def tiles_of(t: Tiles, compiled: DataFrame) -> int:
    """How many (request, tile) pairs there are."""
    per = t.bounds.groupBy("city", "walk_factor").agg(F.count("*").alias("n"))
    asks = compiled.groupBy("city", "walk_factor").agg(F.count("*").alias("m"))
    return per.join(asks, ["city", "walk_factor"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def ranked(candidates: DataFrame, largest: int) -> DataFrame:
    order = [F.desc("l9"), F.desc(F.round("mf", 9)), F.asc("cell_id")]
    best = top_per_group(candidates, ["request_id", "group"], order, 1, "__one").drop("__one")
    return top_per_group(best, ["request_id"], order, largest).where(F.col("rank") <= F.col("limit"))


__all__ = ["Tiles", "bounds", "floors", "most", "pairs", "ranked", "reach", "tiled", "tiles", "top_cells"]
