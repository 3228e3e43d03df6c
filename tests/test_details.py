"""Explanations of groups and places hold to the raw values."""
import pytest
from pyspark.sql import functions as F

from placewise.config import CRITERIA
from placewise.operators import explain as X, groups as G
from placewise.plans import bindings as B, detail_queries as DQ, scoring_queries as Q

D = "/root/testdata/sf0.001"


def test_pooled_rows_equal_plain_means(spark):
    top, rows = DQ.ranked(spark, D, "district")
    cells = [r.asDict() for r in Q.scores(spark, D).where("habitable").select("request_id", "district_id", "population_est", "crit", "s", "raw", "minutes").collect()]
    some = rows.collect()
    assert len(some) == top.count() and any(r.minutes for r in some)
    for r in some[:40]:
        mine = [c for c in cells if c["request_id"] == r.request_id and c["district_id"] == r.group_id]
        mean = lambda xs: (lambda k: sum(x * (c["population_est"] + 1) for x, c in k) / sum(c["population_est"] + 1 for _, c in k) if k else None)([(x, c) for x, c in zip(xs, mine) if x is not None])
        for what in ("crit", "s", "raw"):
            for j, got in enumerate(r[what]):
                want = mean([c[what][j] for c in mine])
                assert got == (None if want is None else pytest.approx(want)), (what, j)
        assert r.imputed == [x is None for x in r.raw]
        for pos, minutes in (r.minutes or {}).items():
            known = sorted(c["minutes"][pos] for c in mine if c["minutes"] and c["minutes"].get(pos) is not None)
            k = len(known)
            assert minutes == int((known[(k - 1) // 2] + known[k // 2]) / 2)


@pytest.mark.parametrize("keys", [["request_id", "cell_id"], ["request_id", "group_id"]])
def test_sentences_match_raw_values(spark, keys):
    """A highlight's criterion lies above the city's median and its indicator scores at least 60; a warning's below, at most 40."""
    rows = Q.top_rows(spark, D) if "cell_id" in keys else DQ.ranked(spark, D, "neighborhood")[1]
    said = X.spoken(rows, DQ.medians(spark, D), B.SPECS, Q.templates(spark), Q.mode_phrases(spark), F.lit("en"), keys).collect()
    at = {tuple(r[k] for k in keys): r for r in rows.collect()}
    med = {(r.request_id, r.i): r["median"] for r in DQ.medians(spark, D).collect()}
    column = {s.column: j for j, s in enumerate(B.SPECS) if not s.is_alias}
    assert {s.kind for s in said} == {"highlight", "warning"}
    for s in said:
        r, i = at[tuple(s[k] for k in keys)], CRITERIA.index(s.criterion)
        assert (r.crit[i] > med[r.request_id, i]) == (s.kind == "highlight") and r.lv[i] > 0
        if s.indicator:
            own = [j for j, spec in enumerate(B.SPECS) if spec.column == s.indicator and spec.criterion == s.criterion] or [column[s.indicator]]
            assert any(r.raw[j] == s.value and (r.s[j] >= 60 if s.kind == "highlight" else r.s[j] <= 40) for j in own)
        assert s.text and "{{" not in s.text


def test_place_detail_has_every_section(spark):
    got = DQ.place_detail(spark, D).groupBy("section").count().collect()
    assert {r.section for r in got} == {"indicator", "criterion", "nearest", "anchor", "price", "archetype", "highlight", "warning"}
    assert G.LEVELS.keys() == {"district", "neighborhood"}
