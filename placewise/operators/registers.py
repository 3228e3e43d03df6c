"""Register and transaction cleaning: classification rules, address matching, price filters."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import house_number, street_norm
from .ranking import medians
from .runs import rank_runs

# Tag rules of the point-of-interest vocabulary.  Columns hold '' for an absent tag.
HOSPITAL = "(amenity = 'hospital' OR healthcare = 'hospital')"
DISCOUNT = "(?iu)lidl|biedronka|aldi|penny|netto|kaufland|dino"
NURSERY = "(?iu)żłob|zlob|jesl|dětsk[áa] skupin|detska skupin|nursery|kids club"
PAEDIATRIC = "(?iu)pediatr|paediatr|dětsk[ýy] lékař|detsky lekar"
GYNAECOLOGY = "(?iu)gyn|położn|polozn|porod"
TAG_COLUMNS = ("amenity", "shop", "leisure", "tourism", "healthcare", "name", "brand", "speciality", "emergency", "access",
               "railway", "station", "subway", "vending", "atm", "tram")
TAG_RULES = {
    "supermarket": "shop = 'supermarket'",
    "discount_grocery": f"shop IN ('supermarket', 'convenience') AND concat(brand, ' ', name) RLIKE '{DISCOUNT}'",
    "convenience": "shop = 'convenience'",
    "pharmacy": "amenity = 'pharmacy' OR healthcare = 'pharmacy'",
    "post_office": "amenity = 'post_office'",
    "parcel_locker": "amenity = 'parcel_locker' OR vending = 'parcel_pickup'",
    "bakery": "shop = 'bakery'",
    "marketplace": "amenity = 'marketplace'",
    "atm": "amenity = 'atm' OR (amenity = 'bank' AND atm = 'yes')",
    "shop": "shop <> ''",
    "gp_clinic": "(amenity IN ('doctors', 'clinic') OR healthcare IN ('doctor', 'clinic', 'centre')) "
                 "AND amenity <> 'dentist' AND healthcare <> 'dentist'",
    "paediatrician": f"speciality RLIKE 'paediatrics' OR name RLIKE '{PAEDIATRIC}'",
    "gynaecology": "speciality RLIKE 'gynaecology|obstetrics' OR "
                   f"(amenity IN ('doctors', 'clinic') AND name RLIKE '{GYNAECOLOGY}')",
    "hospital": HOSPITAL,
    "hospital_er": f"{HOSPITAL} AND emergency = 'yes'",
    "maternity_ward": f"{HOSPITAL} AND speciality RLIKE 'obstetrics|maternity'",
    "dentist": "amenity = 'dentist' OR healthcare = 'dentist'",
    "nursery": f"amenity IN ('childcare', 'kindergarten') AND name RLIKE '{NURSERY}'",
    "kindergarten": f"amenity = 'kindergarten' AND NOT name RLIKE '{NURSERY}'",
    "primary_school": "amenity = 'school'",
    "university": "amenity = 'university'",
    "library": "amenity = 'library'",
    "playground": "leisure = 'playground'",
    "park": "leisure = 'park'",
    "sports": "leisure IN ('sports_centre', 'fitness_centre', 'sports_hall', 'ice_rink') OR "
              "(leisure = 'swimming_pool' AND access NOT IN ('private', 'customers', 'no'))",
    "kids_sports": "leisure = 'water_park' OR (leisure IN ('swimming_pool', 'sports_centre', 'sports_hall') "
                   "AND access NOT IN ('private', 'customers', 'no'))",
    "restaurant": "amenity IN ('restaurant', 'fast_food', 'food_court')",
    "cafe": "amenity IN ('cafe', 'ice_cream')",
    "bar": "amenity IN ('bar', 'pub', 'biergarten')",
    "nightclub": "amenity = 'nightclub'",
    "culture": "amenity IN ('theatre', 'cinema', 'arts_centre', 'community_centre', 'concert_hall') "
               "OR tourism IN ('museum', 'gallery')",
    "bench": "amenity = 'bench'",
    "bike_rack": "amenity = 'bicycle_parking'",
    "bikeshare_station": "amenity = 'bicycle_rental'",
    "tram_stop": "railway = 'tram_stop'",
    "metro_station": "station = 'subway' OR (railway = 'station' AND subway = 'yes')",
    "rail_station": "railway IN ('station', 'halt') AND station NOT IN ('subway', 'light_rail', 'monorail') "
                    "AND subway <> 'yes' AND tram <> 'yes'",
}
# Health register rules on type (druh), field (obor, lower case) and care form (forma, lower case).
HEALTH_HOSPITALS = "druh IN ('Fakultní nemocnice', 'Nemocnice', 'Specializovaná nemocnice')"
HEALTH_RULES = {
    "gp_clinic": "druh LIKE '%všeob. prakt. lékaře%' OR obor LIKE '%všeobecné praktické lékařství%'",
    "paediatrician": "druh LIKE '%pro děti a dorost%' OR obor LIKE '%praktické lékařství pro děti a dorost%' "
                     f"OR (obor LIKE '%dětské lékařství%' AND NOT {HEALTH_HOSPITALS})",
    "gynaecology": "druh LIKE '%gynekologa%' OR (obor LIKE '%gynekologie a porodnictví%' AND forma LIKE '%ambulantní%')",
    "maternity_ward": f"{HEALTH_HOSPITALS} AND obor RLIKE 'gynekologie a porodnictví|neonatologie' AND forma LIKE '%lůžková%'",
    "hospital_er": "druh IN ('Fakultní nemocnice', 'Nemocnice') AND obor RLIKE 'urgentní medicína|anesteziologie'",
    "hospital": HEALTH_HOSPITALS,
    "dentist": "druh LIKE '%stomatologa%' OR obor LIKE '%zubní lékařství%'",
    "pharmacy": "druh = 'Lékárna'",
}
# School register types.
KINDERGARTEN_TYPES = ("Przedszkole", "Punkt przedszkolny", "Zespół wychowania przedszkolnego")
PRIMARY_TYPES = ("Szkoła podstawowa",)
SECONDARY_TYPES = ("Liceum ogólnokształcące", "Technikum", "Branżowa szkoła I stopnia")


def with_optional(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every listed tag column as text, '' where the tag or the whole column is absent."""
    have = set(df.columns)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
                              for c in columns])


def classify(df: DataFrame, rules: Mapping[str, str], out: str = "category") -> DataFrame:
    """One row per matching rule: a feature may enter several categories."""
    arms = ", ".join(f"CASE WHEN {rule} THEN '{cat}' END" for cat, rule in rules.items())
    return df.selectExpr("*", f"explode(filter(array({arms}), c -> c IS NOT NULL)) AS {out}")


def classify_schools(df: DataFrame) -> DataFrame:
    """Type and audience decide the category; everything else is dropped."""
    t, a = F.col("type"), F.col("audience")
    cat = (F.when(t.isin(*SECONDARY_TYPES) & (a == "Dzieci lub młodzież"), "secondary_school")
           .when(t.isin(*PRIMARY_TYPES) & (F.coalesce(a, F.lit("")) != "Dorośli"), "primary_school")
           .when(t.isin(*KINDERGARTEN_TYPES), "kindergarten"))
    return df.withColumn("category", cat).where("category IS NOT NULL")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Deterministic drop-duplicates: the first row in ``order`` wins.  The aggregate combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
            .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]))


def replace_authoritative(base: DataFrame, register: DataFrame, categories: DataFrame) -> DataFrame:
    """The register replaces base rows of the listed categories."""
    return (base.join(categories.select("category").distinct(), "category", "left_anti")
            .unionByName(register, allowMissingColumns=True))


def exclude_entities(df: DataFrame, entity: str, bad: Column) -> DataFrame:
    """Drop an entity if any of its rows is bad, then keep one row per entity (the first class)."""
    rest = [c for c in df.columns if c != entity]
    g = df.groupBy(entity).agg(F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("__bad"),
                               F.min(F.struct(*rest)).alias("__row"))
    return g.where("__bad = 0").select(entity, *[F.col(f"__row.{c}").alias(c) for c in rest])


def arms_length(tx: DataFrame) -> DataFrame:
    """One dwelling per transaction at its own price; the total price counts for single-unit transactions.

    Counts per transaction come from an aggregate joined back, so a huge transaction is combined before the shuffle."""
    per = tx.groupBy("tx_id").agg(F.count("flat_id").alias("units"),
                                  F.sum(F.coalesce((F.col("function") == "dwelling").cast("int"), F.lit(0))).alias("flats"))
    df = tx.join(per, "tx_id").withColumn(
        "p", F.when(F.col("flat_price") > 0, F.col("flat_price")).when(F.col("units") == 1, F.col("tx_price")))
    ok = ("function = 'dwelling' AND market = 'free' AND share = '1/1' AND flats = 1 AND buyer = 'person' "
          "AND area BETWEEN 15 AND 250 AND p IS NOT NULL")
    return df.where(ok).withColumn("ppm2", F.col("p") / F.col("area"))


def iqr_trim(df: DataFrame, value: str, keys: Sequence[str] = (), floor: float | None = None) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles (and above the floor)."""
    keys = list(keys)
    by = keys or ["__one"]
    runs = rank_runs(df if keys else df.withColumn("__one", F.lit(1)), by, value, payload=[c for c in df.columns if c not in (*keys, value)])
    qs = runs.hint(runs.quantiles({"q1": 0.25, "q3": 0.75}).drop("n"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    lo = F.greatest(lo, F.lit(floor)) if floor is not None else lo
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return runs.rows.join(qs, by).where((F.col(value) >= lo) & (F.col(value) <= hi)).select(*df.columns)


def lookup_code_or_name(base: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Join on ``code``; misses fall back to the normalised ``name_key``.  Adds the value and how it was found."""
    by_code = first_per_key(table.select("code", value, "name_key"), ["code"], ["name_key"]).select("code", F.col(value).alias("__c"))
    by_name = first_per_key(table.select("name_key", value, "code"), ["name_key"], ["code"]).select("name_key", F.col(value).alias("__n"))
    df = base.join(by_code, "code", "left").join(by_name, "name_key", "left")
    how = F.when(F.col("__c").isNotNull(), "code").when(F.col("__n").isNotNull(), "name").otherwise("none")
    return df.withColumn(value, F.coalesce("__c", "__n")).withColumn("how", how).drop("__c", "__n")


def address_keys(addresses: DataFrame) -> DataFrame:
    a = addresses.withColumn("k", street_norm(F.coalesce("street", F.lit(""))))
    return (a.withColumn("k2", F.substring_index("k", " ", -1))
            .withColumn("n", house_number(F.coalesce("number", F.lit("")))))


def geocode_cascade(rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """(street, number) exact, then last street word with number, then the median point of the street."""
    a = address_keys(addresses).select("addr_id", "k", "k2", "n", "lat", "lon")
    full = first_per_key(a.drop("k2"), ["k", "n"], ["addr_id"]).select("k", "n", F.struct("lat", "lon").alias("__full"))
    last = first_per_key(a.drop("k"), ["k2", "n"], ["addr_id"]).select("k2", "n", F.struct("lat", "lon").alias("__last"))
    street = medians(a, ["k"], "lat", "slat").join(medians(a, ["k"], "lon", "slon"), "k") \
        .select("k", F.struct(F.col("slat").alias("lat"), F.col("slon").alias("lon")).alias("__street"))
    r = address_keys(rows)
    r = r.join(full, ["k", "n"], "left").join(last, ["k2", "n"], "left").join(street, "k", "left")
    hit = F.coalesce("__full", "__last", "__street")
    how = (F.when(F.col("__full").isNotNull() | F.col("__last").isNotNull(), "exact")
           .when(F.col("__street").isNotNull(), "street").otherwise("none"))
    return (r.withColumn("lat", hit["lat"]).withColumn("lon", hit["lon"]).withColumn("how", how)
            .drop("k", "k2", "n", "__full", "__last", "__street"))


def split_address(addr: Column) -> tuple[Column, Column, Column]:
    """First comma part split into street, house number and number after the slash (NULL where it does not match)."""
    first = F.trim(F.split(addr, ",")[0])
    pat = r"^(.*?)\s+(\d+)(?:/(\d+)\w*)?$"
    part = lambda i: F.when(first.rlike(pat), F.nullif(F.regexp_extract(first, pat, i), F.lit("")))
    return part(1), part(2), part(3)


def geocode_variants(rows: DataFrame, addresses: DataFrame) -> DataFrame:
    """Street + house number, street + orientation number (or house number), part of town + house number."""
    a = addresses.select("addr_id", "st", "part", "cp", "co", "lat", "lon")

    def lut(keys, src):
        return first_per_key(src, keys, ["addr_id"]).select(*keys, F.struct("lat", "lon").alias("__" + "_".join(keys)))
    by_cp = lut(["st", "cp"], a.select("addr_id", "st", "cp", "lat", "lon"))
    by_co = lut(["st", "co"], a.where("co IS NOT NULL").select("addr_id", "st", "co", "lat", "lon"))
    by_part = lut(["part", "cp"], a.select("addr_id", "part", "cp", "lat", "lon"))
    r = rows.withColumn("co", F.coalesce("co", "cp")).withColumn("part", F.col("st"))
    r = r.join(by_cp, ["st", "cp"], "left").join(by_co, ["st", "co"], "left").join(by_part, ["part", "cp"], "left")
    hit = F.coalesce("__st_cp", "__st_co", "__part_cp")
    how = (F.when(F.col("__st_cp").isNotNull(), "cp").when(F.col("__st_co").isNotNull(), "co")
           .when(F.col("__part_cp").isNotNull(), "part").otherwise("none"))
    return (r.withColumn("lat", hit["lat"]).withColumn("lon", hit["lon"]).withColumn("how", how)
            .drop("__st_cp", "__st_co", "__part_cp", "part", "co"))


def coords_or_geocode(rows: DataFrame, addresses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Own coordinates, else the address matched by the cascade; rows with neither are dropped, then deduplicated.
    Only rows without coordinates enter the address joins."""
    own = rows.where("lat IS NOT NULL").withColumn("how", F.lit("own")).drop("street", "number")
    rest = geocode_cascade(rows.where("lat IS NULL").drop("lat", "lon"), addresses).where("lat IS NOT NULL").drop("street", "number")
    both = own.unionByName(rest)
    return first_per_key(both, [*keys, "lat", "lon"], [c for c in both.columns if c not in (*keys, "lat", "lon")])


def latest_months(df: DataFrame, month: str, n: int) -> DataFrame:
    """Rows of the newest n months."""
    newest = df.select(month).distinct().orderBy(F.desc(month)).limit(n)
    return df.join(newest, month, "left_semi")




def finalize_points(points: DataFrame) -> DataFrame:
    """Points of interest as stored: coordinates known and rounded to six places, empty name and extra filled in."""
    six = lambda c: F.bround(F.round(c, 9), 6)
    return (points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("name", F.coalesce("name", F.lit("")))
            .withColumn("extra_json", F.coalesce("extra_json", F.lit("{}"))).withColumn("lat", six("lat")).withColumn("lon", six("lon")))
