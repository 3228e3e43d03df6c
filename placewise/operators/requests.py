"""Shared request state: base64url JSON, decoding and bounds checks over whole columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scoring import REQUEST


def encode_state(request: Column) -> Column:
    """Struct -> base64url(JSON) without padding."""
    b = F.base64(F.encode(F.to_json(request), "UTF-8"))
    return F.regexp_replace(F.translate(b, "+/", "-_"), "=+$|\\s", "")


def decode_state(state: Column) -> Column:
    """base64url(JSON), padding optional -> request struct; NULL for an empty state."""
    s = F.translate(F.nullif(state, F.lit("")), "-_", "+/")
    padded = F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), "=")
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), REQUEST)


# name -> SQL condition under which the request is invalid
RULES = {
    "lang": "lang IS NOT NULL AND lang NOT IN ('pl', 'cs', 'en', 'ko')",
    "anchors": "size(anchors) > 3",
    "anchor.lat": "exists(anchors, a -> a.lat IS NULL OR a.lat NOT BETWEEN -90 AND 90)",
    "anchor.lon": "exists(anchors, a -> a.lon IS NULL OR a.lon NOT BETWEEN -180 AND 180)",
    "anchor.mode": "exists(anchors, a -> a.mode NOT IN ('transit', 'bike', 'walk'))",
    "anchor.level": "exists(anchors, a -> a.level NOT BETWEEN 1 AND 5)",
    "anchor.maxMinutes": "exists(anchors, a -> a.maxMinutes NOT BETWEEN 1 AND 120)",
    "filters.maxCommuteMinutes": "filters.maxCommuteMinutes NOT BETWEEN 1 AND 120",
    "filters.mustHave": "exists(filters.mustHave, m -> m.maxWalkMin NOT BETWEEN 1 AND 60)",
    "budget.total": "budget.total <= 0",
    "budget.monthlyRent": "budget.monthlyRent <= 0",
    "aggregate": "aggregate NOT IN ('hex', 'district', 'neighborhood')",
    "limit": "limit NOT BETWEEN 1 AND 100",
}


def validate(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` (names of violated rules) and ``valid``; split on it for the accepted and rejected rows."""
    arms = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())
    return requests.selectExpr("*", f"filter(array({arms}), e -> e IS NOT NULL) AS errors") \
        .withColumn("valid", F.size("errors") == 0)
