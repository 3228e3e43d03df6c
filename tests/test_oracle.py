"""A cross-section of the registered queries against their SQL twins on the smallest tables (all: tools/check.py)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, norm  # noqa: E402

from placewise.plans import load  # noqa: E402

D = "/root/testdata/sf0.001"
NAMES = ["E01_score_response_hex", "P13_relax_hint", "W01_midrank_percentile", "E05_explain_pick", "A10_stop_stats", "J13_point_in_polygon",
         "J09_radius_join_count", "A13_kring_median_expanding", "G10_disk_mean", "M08_similar_places", "E11_search_rank", "J05_address_geocode_cascade",
         "S07_read_xml_features", "T02_latest_per_station", "T05_reading_dedup", "F24_decode_request_state", "E02_score_response_group", "E03_place_detail",
         "E12_search_merge_dedup", "E16_anchor_times", "J14_majority_area_label", "J15_area_apportion", "P14_iqr_trim", "A05_city_medians", "S03_read_gtfs_csv",
         "E09_indicator_catalog", "M07_calibrate_dref", "M11_pref_pairs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    queries, sql = load()
    df = queries[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
