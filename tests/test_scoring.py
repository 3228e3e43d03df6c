import pytest
from pyspark.sql import functions as F

from placewise.config import CRITERIA
from placewise.operators import scoring as S
from placewise.plans import bindings as B, scoring_queries as Q

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    base = dict(city="praha", persona="custom")
    rows = [dict(base, request_id=1, weights={c: 1 for c in CRITERIA}), dict(base, request_id=2, weights={c: 5 for c in CRITERIA}),
            dict(base, request_id=3, weights={c: 0 for c in CRITERIA}), dict(base, request_id=4, weights={**{c: 1 for c in CRITERIA}, "green": 2}),
            dict(base, request_id=5, weights={**{c: 1 for c in CRITERIA}, "green": 5}),
            dict(base, request_id=6, maxPrice=1.0, must=[("supermarket", 12.0)]), dict(base, request_id=7, must=[("supermarket", 12.0)])]
    return Q.scored(spark, D, rows).select("request_id", "cell_id", "habitable", "passing", "mf", "crit", "masks").cache()


def matches(scored, rid):
    return {r.cell_id: round(r.mf, 9) for r in scored.where(F.col("request_id") == rid).collect()}


def test_only_ratios_of_levels_matter(scored):
    assert matches(scored, 1) == matches(scored, 2) == matches(scored, 3)


def test_raising_a_level_never_hurts_the_best_cell_of_it(scored):
    i = CRITERIA.index("green")
    rows = scored.where("habitable AND request_id IN (4, 5)").collect()
    best = max((r for r in rows if r.request_id == 4), key=lambda r: r.crit[i]).cell_id

    def rank(rid):
        m = {r.cell_id: r.mf for r in rows if r.request_id == rid}
        return sum(v > m[best] + 1e-9 for v in m.values())
    assert rank(5) <= rank(4)


def test_relax_hint_equals_a_run_without_the_filter(scored):
    hint = {r.request_id: r for r in S.relax_hints(scored).collect()}
    assert list(hint) == [6] and hint[6].filter == "price"
    assert hint[6].passing_after == scored.where("request_id = 7 AND passing").count()


def test_masks_and_passing_agree(scored):
    assert scored.where("passing <> (habitable AND forall(masks, m -> m.ok))").count() == 0


def test_only_rows_with_anchors_are_shuffled_to_their_minutes(spark):
    """Most requests have no anchors: their rows stay where they are, whatever the size of the table of minutes."""
    compiled, minutes = Q.asked(spark, D)
    plan = S.score_cells(Q.prepared(spark, D), compiled, minutes, B.SPECS)._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Union") < plan.find("Join LeftOuter") and plan.count("Join LeftOuter") == 1
    assert "isnotnull(anchor_slots" in plan and "isnull(anchor_slots" in plan
    top = Q.top_rows(spark, D)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in top
