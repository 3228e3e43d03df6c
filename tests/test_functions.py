from pyspark.sql import functions as F

from placewise.functions import norm as N, text as T
from placewise.operators import transit as TR


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_decay_and_rounding(spark):
    got = one(spark, a=N.decay(F.lit(7.5), 3, 12), b=N.decay(F.lit(20.0), 3, 12), c=N.decay(F.lit(165.0), 300, 30), d=N.half_even(F.lit(2.5)),
              e=N.half_even(F.lit(1.5)), f=N.band_value(F.lit(-24), F.lit(55)), g=N.band_value(F.lit(75), F.lit(99)))
    assert got == {"a": 50.0, "b": 0.0, "c": 50.0, "d": 2.0, "e": 2.0, "f": 50.0, "g": 77.5}


def test_text(spark):
    nb = "\u00a0"
    f = lambda v, lang, d=0: T.fmt_number(F.lit(float(v)), F.lit(lang), F.lit(d))
    got = one(spark, a=T.fold(F.lit("Žižkov")), b=T.fold(F.lit("Łobzów, (Kraków)")), pl=f(12450, "pl"), pl2=f(1250, "pl"), cs=f(1250, "cs"),
              en=f(12450, "en"), dec=f(3.46, "cs", 1))
    assert got == {"a": "zizkov", "b": "lobzow krakow", "pl": f"12{nb}450", "pl2": "1250", "cs": f"1{nb}250", "en": "12,450", "dec": "3,5"}


def test_gtfs_time(spark):
    s = TR.seconds(F.lit("25:10:00"))
    assert one(spark, s=s, night=TR.is_night(s), peak=TR.is_peak(s)) == {"s": 90600, "night": True, "peak": False}


def test_fold_decomposes_letters_beyond_the_list(spark):
    got = one(spark, a=T.fold(F.lit("Ảnh Ǎ")), b=T.fold(F.lit("ﬁn ĳs ß")), c=T.fold(F.lit("é Ž")), d=T.fold(F.lit("한글")), e=T.fold(F.lit(None).cast("string")))
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == ("anh a", "fin ijs ss", "e z", "한글", None)


def test_sql_folding_equals_the_column_function(spark):
    """Every lower- and upper-case letter with a decomposition, ligatures, loose marks and punctuation."""
    import sys
    import unicodedata

    from placewise.operators.adapters import register_sql_functions
    register_sql_functions(spark)
    letters = [c for c in map(chr, range(0xA0, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LM" and unicodedata.decomposition(c)]
    rows = [(f"a{c}b {c.upper()}",) for c in letters] + [("Straße, „Łódź” / ﬁn-Ả 'x'\t\"y\"",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string").selectExpr("s", "pw_fold(s) AS q").withColumn("f", T.fold(F.col("s")))
    assert df.where("NOT (q <=> f)").count() == 0
    assert df.where("s LIKE 'Stra%'").first()["q"] == "strasse lodz fin a x y"


def test_offline_match_is_a_point_off_at_most(spark):
    from placewise.plans import catalog_queries as CQ
    got = CQ.static_score(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.where("NOT within_one").count() == 0
