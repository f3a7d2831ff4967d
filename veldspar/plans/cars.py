"""Queries of ranking, filters and intent on the driver's tables, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import intent, text
from veldspar.operators import filters, ranking
from veldspar.plans.registry import registered
from veldspar.session import table

QUERIES, ORACLES, query = registered()

_MODELS = ["nano", "venue", "creta", "amaze", "compass", "brezza", "kwid", "octavia", "alto 800", "plain"]

_CARS = f"""WITH c AS (SELECT p_partkey, p_brand AS make, [{", ".join(repr(m) for m in _MODELS)}][p_partkey % 10 + 1] AS model, p_name, p_retailprice * 1000 AS price, CAST(p_size AS DOUBLE) AS mileage,
  CAST(p_size * 3 AS DOUBLE) AS power, CAST(p_partkey % 250 AS DOUBLE) AS torque, CAST(4 + p_partkey % 4 AS DOUBLE) AS seats,
  CASE WHEN p_type LIKE 'LARGE%' THEN 'suv' WHEN p_type LIKE 'SMALL%' THEN 'hatchback' WHEN p_type LIKE 'MEDIUM%' THEN 'sedan' ELSE 'mpv' END AS body,
  ['petrol', 'diesel', 'cng', 'electric', 'hybrid'][p_partkey % 5 + 1] AS fuel, CASE WHEN p_partkey % 2 = 0 THEN 'automatic' ELSE 'manual' END AS transmission,
  p_partkey % 3 > 0 AS airbags, p_partkey % 4 > 0 AS abs_, p_partkey % 5 = 0 AS sunroof, p_partkey % 6 = 0 AS ventilated_seats, p_partkey % 3 = 0 AS cruise_control, p_partkey % 7 < 4 AS android_auto, p_partkey % 7 < 3 AS apple_carplay
  FROM part) """


def _cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cars: brand is the make, type the body, size the mileage; the rest follows from the key."""
    k, t = F.col("p_partkey"), F.col("p_type")
    pick = lambda values: F.array(*map(F.lit, values))[(k % len(values)).cast("int")]
    body = F.when(t.startswith("LARGE"), "suv").when(t.startswith("SMALL"), "hatchback").when(t.startswith("MEDIUM"), "sedan").otherwise("mpv")
    flags = {"airbags": k % 3 > 0, "abs": k % 4 > 0, "sunroof": k % 5 == 0, "ventilated_seats": k % 6 == 0, "cruise_control": k % 3 == 0, "android_auto": k % 7 < 4, "apple_carplay": k % 7 < 3}
    numbers = {"price": F.col("p_retailprice") * 1000, "mileage": F.col("p_size"), "power": F.col("p_size") * 3, "torque": k % 250, "seats": 4 + k % 4}
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("make"), pick(_MODELS).alias("model"), "p_name", *(c.cast("double").alias(n) for n, c in numbers.items()), body.alias("body"), pick(["petrol", "diesel", "cng", "electric", "hybrid"]).alias("fuel"), F.when(k % 2 == 0, "automatic").otherwise("manual").alias("transmission"), *(c.alias(n) for n, c in flags.items()))


# (use, cap, fuel, body, transmission, mileage asked, sunroof asked, airbags asked)
_ASKS = [
    ("family", 980000.0, None, "suv", None, False, False, True),
    ("parents", 990000.0, "petrol", None, "automatic", False, False, False),
    ("highway", 985000.0, "diesel", "sedan", "manual", True, False, False),
    ("city", 970000.0, None, "hatchback", "automatic", True, False, False),
    ("student", 1500000.0, "cng", None, None, True, False, False),
    ("budget", 2500000.0, None, None, None, False, False, True),
    ("premium", 1000000.0, None, "suv", "automatic", False, True, False),
    ("enthusiast", 995000.0, None, "sedan", "manual", False, False, False),
    ("general", None, "electric", None, None, False, True, True),
]
_ASK_COLUMNS = "use string, cap double, asked_fuel string, asked_body string, asked_transmission string, asked_mileage boolean, asked_sunroof boolean, asked_airbags boolean"


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v)


_ASKED = f"(VALUES {', '.join('(' + ', '.join(map(_sql, a)) + ')' for a in _ASKS)}) q(use, cap, want_fuel, want_body, want_gear, want_mileage, want_sunroof, want_airbags)"


def _asked(spark: SparkSession, cars: DataFrame) -> DataFrame:
    """Every request beside every car; requests are few and broadcast.  Scores cost far more than a
    car weighs, so cars are dealt out first, or a small file would be scored by one task."""
    asks = spark.createDataFrame(_ASKS, _ASK_COLUMNS)
    for name in ("ventilated_seats", "cruise_control", "android_auto", "apple_carplay", "abs"):
        asks = asks.withColumn(f"asked_{name}", F.lit(False))
    return cars.repartition(spark.sparkContext.defaultParallelism, "p_partkey").crossJoin(F.broadcast(asks))


_PRICE = """(CASE WHEN cap IS NULL THEN 0.0 WHEN price > cap THEN -100.0 ELSE 40 * greatest(0.0, 1 - abs(price - aim * cap) / greatest(cap, 1.0))
  + CASE WHEN use = 'premium' AND price / cap BETWEEN 0.75 AND 0.98 THEN 18 WHEN use = 'premium' AND price / cap < 0.60 THEN -22
         WHEN use IN ('highway', 'enthusiast') AND price / cap BETWEEN 0.70 AND 0.98 THEN 12 WHEN use IN ('family', 'parents') AND price / cap BETWEEN 0.60 AND 0.95 THEN 6 ELSE 0 END
  + CASE WHEN use IN ('family', 'parents', 'highway', 'premium') AND price / cap < 0.40 THEN -12 ELSE 0 END END)"""
_MILEAGE = """(CASE WHEN mileage <= 0 THEN 0 ELSE least(1, greatest(0, (mileage - 10) / 15)) * 12 + CASE WHEN want_mileage THEN 6 ELSE 0 END
  + CASE WHEN use IN ('city', 'commute', 'family', 'student', 'budget') THEN least(1, greatest(0, (mileage - 12) / 12)) * 5 ELSE 0 END END)"""
_AIM = "CASE WHEN use IN ('budget', 'student') THEN 0.55 WHEN use = 'premium' THEN 0.92 WHEN use IN ('highway', 'enthusiast') THEN 0.88 WHEN use IN ('family', 'parents') THEN 0.78 ELSE 0.70 END"

# Each use case's rules: condition, points, reason.
_USE = {
    "family": [("seats >= 5", 6, "suitable seating for family"), ("seats >= 6", 7, "extra seating capacity"), ("body IN ('suv', 'mpv', 'muv')", 12, "very practical family body type"), ("body = 'sedan'", 9, "comfortable family sedan"), ("body = 'hatchback'", 3, "usable family hatchback"), ("airbags", 10, "airbags for safety"), ("abs_", 8, "ABS for safety"), ("mileage >= 17", 4, "family-friendly mileage"), ("model IN ('nano', 'kwid', 'alto 800')", -18, "penalized as too small/basic for family use")],
    "parents": [("transmission = 'automatic'", 12, "automatic is easier for parents"), ("airbags", 10, "airbags for safety"), ("abs_", 8, "ABS for safety"), ("body IN ('hatchback', 'sedan', 'suv')", 5, "practical body type for parents"), ("mileage >= 14", 3, "reasonable mileage for parents"), ("model IN ('nano', 'kwid')", -15, "penalized as too basic for parents")],
    "highway": [("body IN ('suv', 'sedan')", 10, "good highway body type"), ("power >= 90", 8, "adequate highway power"), ("power >= 110", 4, "stronger highway performance"), ("torque >= 180", 7, "good torque for highway use"), ("fuel = 'diesel'", 6, "diesel suits highway driving"), ("abs_", 7, "ABS useful for highway safety"), ("airbags", 7, "airbags useful for highway safety"), ("cruise_control", 5, "cruise control useful for highway driving"), ("model IN ('nano', 'kwid', 'alto 800')", -20, "penalized as weak for highway use")],
    "city": [("body IN ('hatchback', 'sedan', 'suv')", 6, "practical for city/commute"), ("transmission = 'automatic'", 7, "automatic helps in traffic"), ("mileage >= 17", 8, "efficient for daily use"), ("price < 1000000", 3, "reasonable daily-use price")],
    "student": [("mileage >= 18", 10, "student-friendly mileage"), ("body IN ('hatchback', 'sedan')", 6, "student-friendly body type"), ("fuel IN ('petrol', 'cng')", 5, "practical fuel choice"), ("price < 900000", 5, "student-friendly price")],
    "budget": [("mileage >= 18", 10, "good mileage for budget buyer"), ("fuel IN ('petrol', 'cng', 'diesel')", 5, "practical budget fuel type"), ("body IN ('hatchback', 'sedan')", 6, "budget-friendly body type")],
    "premium": [("sunroof", 8, "sunroof adds premium feel"), ("ventilated_seats", 10, "ventilated seats add premium comfort"), ("android_auto", 4, "has Android Auto"), ("apple_carplay", 4, "has Apple CarPlay"), ("cruise_control", 5, "has cruise control"), ("body IN ('suv', 'muv')", 10, "premium SUV-like body type"), ("body = 'sedan'", 8, "premium sedan body type"), ("power >= 120", 5, "premium-level power")],
    "enthusiast": [("power >= 100", 10, "strong power output"), ("torque >= 180", 8, "strong torque output"), ("body IN ('sedan', 'suv', 'sports', 'coupe')", 6, "enthusiast-friendly body type")],
}
_USE_RULES = [(f"use = '{u}' AND {c}", p, why) for u, rules in _USE.items() for c, p, why in rules]
_OTHER = [("want_sunroof AND sunroof", 15, "has sunroof"), ("want_sunroof AND NOT sunroof", -50, "missing requested sunroof"), ("want_airbags AND airbags", 8, "has airbags"), ("want_airbags AND NOT airbags", -10, "missing requested airbags")]
_WANTED = [
    ("want_fuel = fuel", 12, "want_fuel || ' fuel preference'"), ("want_fuel <> fuel", -8, "'does not match requested ' || want_fuel || ' fuel'"),
    ("want_body = body", 12, "CASE body WHEN 'suv' THEN 'SUV body type' ELSE body || ' body type' END"), ("want_body <> body", -8, "'does not match requested body type'"),
    ("want_gear = transmission AND want_gear = 'automatic'", 10, "'automatic transmission'"), ("want_gear <> transmission AND want_gear = 'automatic'", -8, "'does not match automatic preference'"),
    ("want_gear = transmission AND want_gear = 'manual'", 8, "'manual transmission'"), ("want_gear <> transmission AND want_gear = 'manual'", -6, "'does not match manual preference'"),
]
_QUALITY = [("model = 'nano'", -18, "penalized outdated/basic model"), ("use = 'family' AND model IN ('venue', 'brezza', 'amaze')", 10, "strong family-friendly model match"), ("use = 'highway' AND model IN ('venue', 'creta', 'brezza', 'compass')", 10, "strong highway-friendly model match"), ("use = 'parents' AND model IN ('venue', 'amaze')", 10, "strong parents-friendly model match"), ("use = 'premium' AND model IN ('compass', 'creta', 'octavia')", 18, "strong premium model match"), ("use = 'premium' AND model IN ('brezza', 'kwid', 'alto 800')", -14, "penalized as less premium for this query")]
_POINTS = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in [*_OTHER, *_WANTED, *_USE_RULES, *_QUALITY])
_MONEY = [("price > cap", "over budget"), ("price <= cap", "within budget"), ("price <= cap AND use = 'premium' AND price / cap BETWEEN 0.75 AND 0.98", "uses premium budget well"), ("price <= cap AND use = 'premium' AND price / cap < 0.60", "penalized for underusing premium budget"), ("price <= cap AND use IN ('highway', 'enthusiast') AND price / cap BETWEEN 0.70 AND 0.98", "uses budget well for performance use"), ("price <= cap AND use IN ('family', 'parents') AND price / cap BETWEEN 0.60 AND 0.95", "uses budget well for practical use"), ("price <= cap AND use IN ('family', 'parents', 'highway', 'premium') AND price / cap < 0.40", "penalized for being too basic for this use-case"), ("mileage >= 18 OR (mileage > 0 AND want_mileage)", "good mileage")]
_SAID = ", ".join([*(f"CASE WHEN {c} THEN '{w}' END" for c, w in [*_MONEY, *((c, w) for c, _, w in _OTHER)]), *(f"CASE WHEN {c} THEN {w} END" for c, _, w in _WANTED), *(f"CASE WHEN {c} THEN '{w}' END" for c, _, w in [*_USE_RULES, *_QUALITY])])
_RANKED = f""", s AS (SELECT *, {_AIM} AS aim FROM c, {_ASKED}),
p AS (SELECT use, p_partkey, make, round({_PRICE} + {_MILEAGE} + {_POINTS}, 6) AS score, list_filter([{_SAID}], lambda x: x IS NOT NULL) AS said FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY use ORDER BY score DESC, p_partkey) AS rk FROM p)
"""


@query(_CARS + _RANKED + "SELECT use, p_partkey, score, CAST(rk AS INTEGER) AS rk, array_to_string(list_filter(said, lambda x, i: list_position(said, x) = i)[1:5], '; ') AS reasons FROM r WHERE rk <= 20")
def batch_rank_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All score components and cleaned reasons of many requests against the whole catalog, 20 of each."""
    body = F.when(F.col("asked_body") == "suv", "SUV body type").otherwise(F.concat("asked_body", F.lit(" body type")))
    top = ranking.top_scored(_asked(spark, _cars(spark, sf_dir)), ["use"], "p_partkey", 20)
    return top.select("use", "p_partkey", "score", "rk", F.array_join(ranking.cleaned_reasons(F.col("reasons"), body), "; ").alias("reasons"))


@query(
    _CARS
    + f""", q AS (SELECT *, 'family' AS use, 980000.0 AS cap, 0.78 AS aim, FALSE AS want_mileage FROM c WHERE price <= 990000),
s AS (SELECT p_partkey, make, p_name, round({_PRICE} + {_MILEAGE} + CASE WHEN body = 'suv' THEN 12 ELSE -8 END, 6) AS score FROM q),
t AS (SELECT * FROM s ORDER BY score DESC, p_partkey LIMIT 20),
m AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY score DESC, p_partkey) AS n FROM t),
k AS (SELECT p_partkey, make, p_name, score FROM m WHERE n <= 2 ORDER BY score DESC, p_partkey LIMIT 10),
o AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_partkey) AS n FROM k)
SELECT p_partkey, make, p_name, score FROM o WHERE n = 1 ORDER BY score DESC, p_partkey LIMIT 4"""
)
def catalog_topk_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price cap, additive score, best 20, two of a make, ten, best of each model, four."""
    use, cap = F.lit("family"), F.lit(980000.0)
    points = ranking.price_points(F.col("price"), cap, use) + ranking.mileage_points(F.col("mileage"), use, F.lit(False)) + ranking.match_points(F.col("body"), F.lit("suv"))
    rows = _cars(spark, sf_dir).where("price <= 990000").select("p_partkey", "make", "p_name", F.round(points, 6).alias("score"))
    return ranking.diversified(rows, "make", "p_name", "p_partkey")


@query(_CARS + f"SELECT p_partkey, use, CAST({' + '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for c, p, _ in _USE_RULES)} AS DOUBLE) AS points, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {w!r} END' for c, _, w in _USE_RULES)}], lambda x: x IS NOT NULL), '; ') AS reasons FROM c, {_ASKED}")
def rank_use_case_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ranking.use_rules(F.col("use"))
    return _asked(spark, _cars(spark, sf_dir)).select("p_partkey", "use", ranking.points(rules).alias("points"), F.array_join(ranking.reasons(rules), "; ").alias("reasons"))


@query(
    _CARS
    + """, r AS (SELECT make, p_partkey, round(CASE WHEN mileage > 0 THEN least(1.0, greatest(0.0, (mileage - 10) / 15.0)) * 12 ELSE 0.0 END, 6) AS score FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY score DESC, p_partkey) AS rk FROM r)
SELECT make, p_partkey, score, CAST(rk AS INTEGER) AS rk FROM w WHERE rk <= 3"""
)
def rank_within_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(ranking.mileage_points(F.col("mileage"), F.lit("general"), F.lit(False)), 6)
    rows = _cars(spark, sf_dir).select("make", "p_partkey", score.alias("score"))
    return ranking.ranked(rows, ["make"], "p_partkey").where("rk <= 3")


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The catalog with one-hot columns and coded makes, and the codes."""
    hot = lambda c, v: (F.col(c) == v).cast("int")
    cars = _cars(spark, sf_dir)
    out = cars.select(
        "p_partkey", F.substring("make", 7, 9).cast("int").alias("Make"), F.col("price").alias("Ex-Showroom_Price"), F.col("mileage").alias("ARAI_Certified_Mileage"), F.col("power").alias("Power"), F.col("seats").cast("int").alias("Seating_Capacity"),
        hot("body", "suv").alias("Body_Type_SUV"), hot("body", "sedan").alias("Body_Type_Sedan"), hot("fuel", "petrol").alias("Fuel_Type_Petrol"), hot("fuel", "cng").alias("Fuel_Type_CNG"),
        hot("transmission", "automatic").alias("Transmission_Automatic"), hot("transmission", "manual").alias("Transmission_Manual"), (F.col("airbags").cast("int") * 2).alias("Number_of_Airbags"), F.col("android_auto").cast("int").alias("Android_Auto"), F.when(F.col("abs"), "1").otherwise("none").alias("ABS"),
    )
    return out, cars.select(F.col("make").alias("label"), F.substring("make", 7, 9).cast("int").alias("code")).distinct()


@query(_CARS + "SELECT p_partkey FROM c WHERE price BETWEEN 900000 AND 990000 AND CAST(substr(make, 7) AS INTEGER) < 40 AND body = 'suv' AND mileage >= 10 AND transmission = 'automatic' AND android_auto")
def filtered_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter map with a price pair, coded makes, a one-hot family, a range, a flag and a feature."""
    rows, codes = _encoded(spark, sf_dir)
    asked = {"Ex-Showroom_Price": [900000, 990000], "Make": [*(f"Brand#{i}" for i in range(40)), "Nobody"], "Body_Type": "Body_Type_SUV", "ARAI_Certified_Mileage": 10, "Transmission_Automatic": 1, "Transmission_Manual": 1, "Android_Auto": 1, "Nothing": 5}
    return filters.filtered(rows, asked, codes).select("p_partkey")


@query(_CARS + "SELECT p_partkey FROM c WHERE price <= 950000 AND seats = 5 AND power BETWEEN 30 AND 120 AND fuel = 'cng'")
def range_and_residual_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap alone, equal seats, a range pair and a residual one-hot column."""
    rows, _ = _encoded(spark, sf_dir)
    return filters.filtered(rows, {"Ex-Showroom_Price": 950000, "Seating_Capacity": 5, "Power": [30, 120], "Fuel_Type_CNG": 1}).select("p_partkey")


@query(_CARS + "SELECT p_partkey FROM c WHERE airbags AND abs_ AND android_auto")
def hard_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked features by parts of column names; a text that is no number counts as 0."""
    rows, _ = _encoded(spark, sf_dir)
    return filters.hard_features(rows, {"Airbags": 1, "ABS_(Anti-lock_Braking_System)": 1, "Android_Auto": 1})[0].select("p_partkey")


@query(_CARS + "SELECT p_partkey, CASE WHEN body IN ('suv', 'sedan') THEN body ELSE 'unknown' END AS body, CASE WHEN fuel = 'petrol' THEN 'Petrol' WHEN fuel = 'cng' THEN 'Cng' ELSE 'Not specified' END AS fuel, make FROM c")
def decoded_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot families as values (first by a table, last by name) and makes from their codes."""
    rows, codes = _encoded(spark, sf_dir)
    body = ranking.first_positive({"suv": "Body_Type_SUV", "sedan": "Body_Type_Sedan"}, rows.columns)
    return filters.decoded(rows, {"Make": codes}).select("p_partkey", body.alias("body"), ranking.last_positive("Fuel_Type_", rows.columns).alias("fuel"), F.col("Make").alias("make"))


# Templates of requests by key; %d is the size.
_TEXTS = ["family suv under %d lakh", "Diesel automatic sedan 10 to %d lakh with sunroof", "7 seater petrol MPV above %d lakh", "cheap hatchback with good mileage", "15 to 20 kmpl manual car from Tata or Maruti", "Luxury electric suv below %d crore with ABS and airbags", "automatic or manual cng for city, max %d", "highway car over %d cr, large family"]
_ASKED_TEXT = f"WITH q AS (SELECT p_partkey, p_partkey % 8 AS t, CAST(p_size AS BIGINT) AS n, replace([{', '.join(repr(t) for t in _TEXTS)}][p_partkey % 8 + 1], '%d', CAST(p_size AS VARCHAR)) AS query FROM part) "


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.array(*map(F.lit, _TEXTS))[(k % 8).cast("int")], F.lit("%d"), F.col("p_size").cast("string")).alias("query"))


@query(
    _ASKED_TEXT
    + """SELECT p_partkey, CASE t WHEN 1 THEN 1000000 WHEN 2 THEN n * 100000 WHEN 4 THEN 1500000 WHEN 7 THEN n * 10000000 END AS price_min,
  CASE t WHEN 0 THEN n * 100000 WHEN 1 THEN n * 100000 WHEN 4 THEN 2000000 WHEN 5 THEN n * 10000000 WHEN 6 THEN n * 100000 END AS price_max,
  CASE t WHEN 2 THEN 7 WHEN 7 THEN 7 END AS seats, CASE t WHEN 0 THEN 'suv' WHEN 1 THEN 'sedan' WHEN 2 THEN 'mpv' WHEN 3 THEN 'hatchback' WHEN 5 THEN 'suv' END AS body_type,
  CASE t WHEN 1 THEN 'diesel' WHEN 2 THEN 'petrol' WHEN 5 THEN 'electric' WHEN 6 THEN 'cng' END AS fuel_type, CASE t WHEN 1 THEN 'automatic' WHEN 4 THEN 'manual' END AS transmission,
  CASE t WHEN 0 THEN 'family' WHEN 3 THEN 'budget' WHEN 5 THEN 'premium' WHEN 6 THEN 'city' WHEN 7 THEN 'family' ELSE 'general' END AS use_case,
  CAST(CASE t WHEN 3 THEN 18 WHEN 4 THEN 15 END AS DOUBLE) AS mileage_min, CAST(CASE t WHEN 4 THEN 20 END AS DOUBLE) AS mileage_max,
  CASE t WHEN 4 THEN 'Tata,Maruti Suzuki' ELSE '' END AS makes, CASE t WHEN 1 THEN 'sunroof' WHEN 5 THEN 'airbags,abs' ELSE '' END AS features FROM q"""
)
def intent_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the intent; a mileage range counts as a price range too."""
    rows = intent.parsed(_requests(spark, sf_dir))
    return rows.withColumn("makes", F.array_join("makes", ",")).withColumn("features", F.array_join("features", ",")).drop("query")


@query(_ASKED_TEXT + "SELECT p_partkey, CASE t WHEN 1 THEN 1000000 WHEN 2 THEN n * 100000 WHEN 7 THEN n * 10000000 END AS price_min, CASE t WHEN 0 THEN n * 100000 WHEN 1 THEN n * 100000 WHEN 5 THEN n * 10000000 WHEN 6 THEN n * 100000 END AS price_max FROM q")
def intent_price_without_mileage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, numbers of kmpl and seats being no prices."""
    return intent.parsed(_requests(spark, sf_dir), compat=False).select("p_partkey", "price_min", "price_max")


@query(
    _ASKED_TEXT
    + """SELECT p_partkey, array_to_string(list_sort(CASE t WHEN 0 THEN ['Ex-Showroom_Price=' || n * 100000, 'Body_Type=Body_Type_SUV'] WHEN 1 THEN ['Ex-Showroom_Price=1000000..' || n * 100000, 'Body_Type=Body_Type_Sedan', 'Transmission_Automatic=1', 'Fuel_Type_Diesel=1', 'Sunroof=1']
  WHEN 2 THEN ['price_min_only=' || n * 100000, 'Body_Type=Body_Type_MPV', 'Seating_Capacity=7', 'Fuel_Type_Petrol=1'] WHEN 3 THEN ['Body_Type=Body_Type_Hatchback', 'ARAI_Certified_Mileage=18.0..'] WHEN 4 THEN ['Ex-Showroom_Price=1500000..2000000', 'Make=Tata|Maruti Suzuki', 'Transmission_Manual=1', 'ARAI_Certified_Mileage=15.0..20.0']
  WHEN 5 THEN ['Ex-Showroom_Price=' || n * 10000000, 'Body_Type=Body_Type_SUV', 'Fuel_Type_Electric=1', 'Airbags=1', 'ABS_(Anti-lock_Braking_System)=1'] WHEN 6 THEN ['Ex-Showroom_Price=' || n * 100000, 'Fuel_Type_CNG=1'] ELSE ['price_min_only=' || n * 10000000, 'Seating_Capacity=7'] END), ';') AS filters FROM q"""
)
def intent_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intent.filter_map(intent.parsed(_requests(spark, sf_dir)))
    pairs = F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("p_partkey", F.array_join(F.array_sort(pairs), ";").alias("filters"))


@query(
    _ASKED_TEXT
    + """SELECT p_partkey, CAST(CASE t WHEN 1 THEN 1000000 WHEN 4 THEN 1500000 END AS BIGINT) AS price_min, CASE t WHEN 0 THEN n * 100000 WHEN 1 THEN n * 100000 WHEN 2 THEN 700000 WHEN 4 THEN 2000000 WHEN 5 THEN n * 10000000 WHEN 6 THEN n * 100000 WHEN 7 THEN n * 10000000 END AS price_max,
  CASE t WHEN 2 THEN 7 END AS seats, CASE t WHEN 1 THEN 'automatic' WHEN 4 THEN 'manual' END AS transmission, CASE t WHEN 0 THEN 'suv' WHEN 1 THEN 'sedan' WHEN 2 THEN 'mpv' WHEN 3 THEN 'hatchback' WHEN 5 THEN 'suv' END AS body_type,
  CASE t WHEN 4 THEN 'Tata' ELSE '' END AS makes, CASE t WHEN 4 THEN 15 END AS mileage_min, CASE t WHEN 4 THEN 20 END AS mileage_max,
  CASE t WHEN 1 THEN 'Fuel_Type=DIESEL,Sunroof=1' WHEN 2 THEN 'Fuel_Type=PETROL' WHEN 5 THEN 'ABS_(Anti-lock_Braking_System)=1,Airbags=1,Fuel_Type=ELECTRIC' WHEN 6 THEN 'Fuel_Type=CNG' ELSE '' END AS features FROM q"""
)
def plain_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback parser, in which any number is a budget."""
    rows = intent.plain(_requests(spark, sf_dir))
    pairs = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("features", F.array_join(F.array_sort(pairs), ",")).withColumn("makes", F.array_join("makes", ",")).drop("query")


_USED_TEXTS = ["Maruti Swift in Pune under %d lakh", "diesel suv 5 to %d lakh from 2019", "automatic honda in delhi under 40k km", "hyundai or tata sedan, manual, less than 60000 kms"]


@query(
    f"WITH q AS (SELECT p_partkey, p_partkey % 4 AS t, CAST(p_size AS BIGINT) AS n FROM part) "
    + """SELECT p_partkey, CAST(CASE t WHEN 1 THEN 500000 END AS BIGINT) AS price_min, CASE t WHEN 0 THEN n * 100000 WHEN 1 THEN n * 100000 WHEN 2 THEN 4000000 END AS price_max, CASE t WHEN 0 THEN 'pune' WHEN 2 THEN 'delhi' END AS city,
  CASE t WHEN 1 THEN 'diesel' END AS fuel_type, CASE t WHEN 1 THEN 'suv' WHEN 3 THEN 'sedan' END AS body_type, CASE t WHEN 2 THEN 'automatic' WHEN 3 THEN 'manual' END AS transmission,
  CASE t WHEN 0 THEN 'maruti' WHEN 2 THEN 'honda' WHEN 3 THEN 'tata,hyundai' ELSE '' END AS makes, CASE t WHEN 1 THEN 2019 END AS year_min, CAST(CASE t WHEN 2 THEN 40000 WHEN 3 THEN 60000 END AS BIGINT) AS km_max FROM q"""
)
def used_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.array(*map(F.lit, _USED_TEXTS))[(F.col("p_partkey") % 4).cast("int")], F.lit("%d"), F.col("p_size").cast("string")).alias("query"))
    return intent.used(asked).withColumn("makes", F.array_join("makes", ",")).drop("query")


_COSINE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))))"


@query(f"SELECT a.vec_id, round({_COSINE}, 5) AS similarity, round(0.85 * (a.vec_id % 50) + 0.15 * 50 * ({_COSINE} + 1), 4) AS blended FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines with one asked vector, blended with a rule score."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("asked"))  # one vector
    s = ranking.cosine(F.col("embedding"), F.col("asked"))
    return rows.crossJoin(F.broadcast(asked)).select("vec_id", F.round(s, 5).alias("similarity"), F.round(ranking.blended((F.col("vec_id") % 50).cast("double"), s), 4).alias("blended"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS label, replace(lower(p_name), ' ', '-') AS slug, translate(lower(p_name), '_- ()/', '') AS squashed, 'https://example.org/' || replace(lower(p_brand), ' ', '-') || '/' || replace(lower(p_name), ' ', '-') AS link FROM part")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.label(c).alias("label"), text.slug(c).alias("slug"), text.squashed(c).alias("squashed"), text.link("example.org", F.col("p_brand"), c).alias("link"))


@query(
    """SELECT p_partkey, CAST(p_size * 100000 + 50000 AS BIGINT) AS price, CASE WHEN 600 + p_size * 100 BETWEEN 600 AND 6000 THEN 600 + p_size * 100 END AS cc, CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE END AS flag,
  CAST(1000 + p_size AS BIGINT) AS length, CAST(1500 AS BIGINT) AS width, CAST(NULL AS BIGINT) AS height, CAST(p_size + 0.5 AS DOUBLE) AS hours, CAST(p_size * 60 + 30 AS BIGINT) AS minutes, p_size AS years, CAST(100000 AS BIGINT) AS km, p_size AS gears,
  CASE WHEN p_partkey % 2 = 0 THEN 'amt' ELSE 'manual' END AS family, CASE WHEN p_partkey % 2 = 0 THEN 'Automatic (AMT)' ELSE 'Manual' END AS gearbox FROM part"""
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, displacements, flags, dimensions, times, warranties and gears from texts."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    size, years = text.dimensions(said("1,0", F.lpad(n, 2, "0"), ".7 x 1500 mm")), text.warranty(said(n, " Years or 1,00,000 km"))
    gear = F.when(k % 2 == 0, "Automatic (AMT)").otherwise("5 Speed Manual")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.price(said("Rs. ", n, ".5 Lakh")).alias("price"), text.engine_cc(said("2024 model, ", (F.col("p_size") * 100 + 600).cast("string"), " cc")).alias("cc"), text.tri_bool(F.array(*map(F.lit, ["Yes ", "not  available", "ABS-No", "front only"]))[(k % 4).cast("int")]).alias("flag"),
        size["length"].alias("length"), size["width"].alias("width"), size["height"].alias("height"), text.hours(said(n, " Hrs 30 mins")).alias("hours"), text.minutes(said(n, " h 30 m")).alias("minutes"), years["years"].alias("years"), years["km"].alias("km"),
        text.gear_count(said(n, "-Speed ", n, " gears")).alias("gears"), text.transmission_family(gear).alias("family"), text.transmission_label(gear).alias("gearbox"),
    )
