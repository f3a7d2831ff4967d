"""Queries of page records, listing addresses, source registries and failures on the driver's tables, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import addresses, intent
from veldspar.operators import build, extraction, failures, records, registry, rules
from veldspar.plans.registry import registered
from veldspar.session import table

QUERIES, ORACLES, query = registered()


def _said(*parts: object) -> Column:
    """Texts and columns, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, html): a part's page.  Of five, one has a broken state and one none; labels,
    values, missing items and texts that are neither yes nor no vary with the part's columns."""
    k, n, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    items: list[tuple[str, Column]] = [
        ("Fuel Type", F.when(k % 3 == 0, "Electric").when(k % 3 == 1, "Petrol").otherwise("")),
        ("Mileage (ARAI)", _said(n, ".5 kmpl")), ("Displacement", _said("Engine ", n * 100, " cc")), ("Engine", F.when(k % 2 == 0, _said(n, " Cylinders Turbo \\\"x\\\" {")).otherwise(_said(n, " valves"))),
        ("Battery", _said(n, " kWh")), ("Transmission Type", F.when(k % 2 == 0, _said(n, " Speed Manual")).otherwise("Automatic (AMT)")),
        ("Max Power", _said("1,", F.lpad(n.cast("string"), 3, "0"), ".25 bhp")), ("Max Torque (Nm@rpm)", F.when(k % 7 == 0, "").otherwise(_said(n, " Nm"))),
        ("AC Regular Charging", _said(n, " hrs 30 mins")), ("AC Fast Charging", F.when(k % 2 == 0, _said(n, " minutes")).otherwise("")), ("DC Fast Charging", _said(n, " min")),
        ("Seating Capacity", _said(n, " Person")), ("Length *Width *Height", _said(n * 10, " mm x ", n * 20, " mm x ", n * 30, ".9")), ("Boot Space (litres)", _said("-", n, " litres")), ("Airbags", _said(n, " Airbags (2 Front)")),
        ("NCAP Rating", _said(n % 6, " Star (Global NCAP)")), ("Anti-Lock Braking System (ABS)", F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise(name)),
        ("Parking Sensors", F.when(k % 2 == 0, _said("Front & Rear ", name)).otherwise("Front")), ("Sunroof", F.when(k % 2 == 0, "Panoramic").otherwise("Not  Available")),
        ("Driver Seat Adjustment", F.when(k % 2 == 0, "8 way electrically adjustable").otherwise("6 way manual")), ("Smart Connectivity", F.when(k % 2 == 0, "Android Auto (Yes), Apple CarPlay (Yes)").otherwise("No ports")),
        ("Geo-fence", F.when(k % 5 == 0, "Yes optional").otherwise("")), ("Vehicle Warranty", _said(n, " Years or 1,", F.lpad((n * 10).cast("string"), 3, "0"), " km")),
    ]
    item = lambda label, value: _said('{"itemName":"', label, '","value":"', value, '"}')
    tree = F.concat(F.lit('{"specsFeaturesMaster":[{"name":"All","subCategories":[{"name":"One","items":['), F.concat_ws(",", *(item(a, b) for a, b in items)), F.lit(']},{"name":"none"}]}],'))
    rendered = _said('"versionDetail":{', F.when(k % 3 > 0, _said('"makeName":"', F.col("p_type"), '",')).otherwise(""), '"modelName":"', F.col("p_brand"), '","versionName":"', F.when(k % 4 > 0, name).otherwise(""), '","versionId":', k, ',"featureSpecs":[{"itemName":"Cruise  CONTROL!","value":null,"renderedTemplates":{"z":"","a":"', F.when(k % 2 == 0, "available").otherwise("none"), '"}},{"itemName":"x","renderedTemplates":{"q":"Hill Hold Control: Yes"}}]},')
    state = F.concat(F.lit('{"trimPage":'), tree, rendered, _said('"trimDetail":{"makeName":"', F.col("p_type"), ' trim","trimName":"', F.when(k % 8 == 0, "").otherwise("base"), '"},"trimDetailedPriceBreakup":{"', k, '":[{"exShowRoom":', n * 1000, ',"onRoad":"', F.when(k % 2 == 0, _said("Rs ", n, ".5 Lakh")).otherwise(""), '"}]}}}'))
    script = F.when(k % 5 == 3, "<script>window.__INITIAL_STATE__ = {\"a\": [1,</script>").when(k % 5 == 4, "").otherwise(F.concat(F.lit("<script>var a='{'; window.__INITIAL_STATE__ = "), state, F.lit("; var b = {}</script>")))
    linked = F.when(k % 3 > 0, _said('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"name":"x"},{"offers":{"price":', n * 7, F.when(k % 3 == 1, ',"priceCurrency":"USD"').otherwise(""), "}}]}</script>")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 > 0, F.concat(_said("<h1 class='t'>", name, "<b>&amp; more</b> </h1>"), linked, script)).alias("html"))


_ON = {  # of pages with a state: SQL of what the rules of the fields give; fields that no page shows are null
    "fuel_type": "CASE WHEN k % 3 = 0 THEN 'Electric' WHEN k % 3 = 1 THEN 'Petrol' END", "mileage_arai_kmpl": "n + 0.5::DOUBLE", "transmission": "CASE WHEN k % 2 = 0 THEN 'Manual' ELSE 'Automatic (AMT)' END", "gearbox_speeds": "CASE WHEN k % 2 = 0 THEN CAST(n AS INTEGER) END",
    "engine_cc": "CASE WHEN k % 3 > 0 AND CAST(left(CAST(n * 100 AS VARCHAR), 4) AS INTEGER) BETWEEN 600 AND 6000 THEN CAST(n * 100 AS INTEGER) END", "cylinders": "CASE WHEN k % 2 = 0 THEN CAST(n AS INTEGER) END", "battery_capacity_kwh": "CASE WHEN k % 3 = 0 THEN CAST(n AS DOUBLE) END", "turbocharged": "CASE WHEN k % 2 = 0 THEN TRUE END",
    "power_bhp": "1000.25::DOUBLE + n", "torque_nm": "CASE WHEN k % 7 > 0 THEN CAST(n AS DOUBLE) END", "charging_time_ac_hours": "CASE WHEN k % 2 = 0 THEN round(n / 60, 2) ELSE n + 0.5::DOUBLE END", "charging_time_dc_minutes": "CAST(n AS BIGINT)", "seating_capacity": "CAST(n AS BIGINT)",
    "length_mm": "CAST(n * 10 AS BIGINT)", "width_mm": "CAST(n * 20 AS BIGINT)", "height_mm": "CAST(n * 30 AS BIGINT)", "boot_space_litres": "CAST(-n AS DOUBLE)", "airbags": "CAST(n AS BIGINT)", "crash_test_rating": "CAST(n % 6 AS DOUBLE)", "crash_test_agency": "'Global NCAP'",
    "abs": "CASE WHEN k % 3 = 0 THEN TRUE WHEN k % 3 = 1 THEN FALSE END", "hill_assist": "CAST(NULL AS BOOLEAN)", "rear_parking_sensors": "k % 2 = 0", "front_parking_sensors": "CAST(NULL AS BOOLEAN)", "sunroof": "CASE WHEN k % 2 = 1 THEN FALSE END", "panoramic_sunroof": "k % 2 = 0",
    "cruise_control": "k % 2 = 0", "powered_driver_seat": "k % 2 = 0", "android_auto": "k % 2 = 0", "apple_carplay": "k % 2 = 0", "connected_car_features": "CASE WHEN k % 5 = 0 THEN TRUE END", "standard_warranty_years": "CAST(n AS INTEGER)", "standard_warranty_km": "CAST(1000 + n * 10 AS BIGINT)",
}
_KIND = {"text": "VARCHAR", "number": "DOUBLE", "int": "BIGINT", "flag": "BOOLEAN", "hours": "DOUBLE", "minutes": "BIGINT", "panoramic": "BOOLEAN"}
_FIELD_SQL = {f.name: f"CASE WHEN there THEN {_ON[f.name]} END" if f.name in _ON else f"CAST(NULL AS {_KIND[f.parse]})" for f in extraction.FIELDS}
_FIELD_SQL |= {f.name: f"CAST({_FIELD_SQL[f.name]} AS VARCHAR)" for f in extraction.FIELDS if _KIND.get(f.parse) == "BOOLEAN"}  # three states as texts
_FIRST_SQL = {
    "source": "'pages'", "source_url": "'https://pages.example/' || k",
    "make": "CASE WHEN there THEN CASE WHEN k % 3 > 0 THEN p_type ELSE p_type || ' trim' END END", "model": "CASE WHEN there THEN p_brand END", "variant": "CASE WHEN there THEN CASE WHEN k % 4 > 0 THEN p_name WHEN k % 8 > 0 THEN 'base' END END",
    "full_name": "CASE WHEN there AND k % 8 > 0 THEN CASE WHEN k % 3 > 0 THEN p_type ELSE p_type || ' trim' END || ' ' || p_brand || ' ' || CASE WHEN k % 4 > 0 THEN p_name ELSE 'base' END WHEN full_ THEN p_name || ' & more' END",
    "price_ex_showroom": "CASE WHEN there THEN CAST(n * 1000 AS BIGINT) END", "price_on_road": "CASE WHEN there AND k % 2 = 0 THEN CAST(n * 100000 + 50000 AS BIGINT) WHEN full_ AND k % 3 > 0 THEN CAST(n * 7 AS BIGINT) END", "currency": "CASE WHEN full_ AND k % 3 = 1 THEN 'USD' ELSE 'INR' END",
}


@query(
    f"""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS n, p_name, p_type, p_brand, p_partkey % 11 > 0 AS full_, p_partkey % 11 > 0 AND p_partkey % 5 < 3 AS there FROM part),
r AS (SELECT k AS p_partkey, full_, there, {', '.join(f'{sql} AS "{name}"' for name, sql in (_FIRST_SQL | _FIELD_SQL).items())} FROM p)
SELECT * EXCLUDE (full_, there), CASE WHEN NOT full_ THEN 'page is empty' WHEN p_partkey % 5 = 4 THEN 'no embedded state' WHEN p_partkey % 5 = 3 THEN 'embedded state is no valid JSON object' END AS error,
  round(100.0 * ({' + '.join(f'CAST("{name}" IS NOT NULL AS INTEGER)' for name in _FIRST_SQL | _FIELD_SQL)}) / 91, 2)::DOUBLE AS field_completeness_score FROM r"""
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of a record from raw pages: fallbacks, overrides, and pages that can't be read as rows with an error."""
    out = extraction.page_records(_pages(spark, sf_dir), ["p_partkey"], source=F.lit("pages"), url=_said("https://pages.example/", F.col("p_partkey")))
    return out.withColumns({n: F.col(n).cast("string") for n, t in out.dtypes if t == "boolean"})


# Requests for used vehicles from orders: words, amounts and missing filters vary with the order's columns.
_USED = """q AS (SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 4 WHEN 0 THEN 'Hyderabad' WHEN 1 THEN 'New Delhi' WHEN 2 THEN 'pune' END AS city, CASE o_custkey % 5 WHEN 0 THEN 'Maruti' WHEN 1 THEN 'kia' WHEN 2 THEN 'Mercedes Benz' WHEN 3 THEN 'tata' END AS make,
  CASE o_orderkey % 3 WHEN 0 THEN 'SUV' WHEN 1 THEN 'muv' END AS body, CASE o_custkey % 4 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'hydrogen' WHEN 2 THEN 'cng' END AS fuel, CASE o_orderkey % 5 WHEN 0 THEN 'Manual' WHEN 1 THEN 'automatic' WHEN 2 THEN 'amt' END AS trans,
  CASE WHEN o_custkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 10 WHEN o_custkey % 3 = 1 THEN 0 END AS low, CASE WHEN o_custkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 7 END AS high, CASE WHEN o_orderkey % 7 > 2 THEN o_custkey * 100 END AS km,
  CASE WHEN o_orderkey % 6 < 3 THEN 2010 + o_custkey % 10 END AS y0, CASE WHEN o_orderkey % 6 IN (0, 4) THEN 2020 END AS y1, CASE WHEN o_custkey % 9 = 0 THEN 5 END AS seats FROM orders)"""


def _used_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice").cast("bigint")
    pick = lambda on, *words: F.try_element_at(F.array(*map(F.lit, words)), (on + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(k % 4, "Hyderabad", "New Delhi", "pune").alias("city"), F.array_compact(F.array(pick(c % 5, "Maruti", "kia", "Mercedes Benz", "tata"), F.lit("skoda"))).alias("makes_"), pick(c % 5, "Maruti", "kia", "Mercedes Benz", "tata").alias("make"),
        pick(k % 3, "SUV", "muv").alias("body_type"), pick(c % 4, "Diesel", "hydrogen", "cng").alias("fuel_type"), pick(k % 5, "Manual", "automatic", "amt").alias("transmission"),
        F.when(c % 3 == 0, price * 10).when(c % 3 == 1, 0).alias("price_min"), F.when(c % 2 == 0, price * 7).alias("price_max"), F.when(k % 7 > 2, c * 100).alias("km_max"),
        F.when(k % 6 < 3, 2010 + c % 10).alias("year_min"), F.when((k % 6).isin(0, 4), 2020).alias("year_max"), F.when(c % 9 == 0, 5).alias("seats"),
    ).drop("makes_")


_WORD = "replace(lower({}), ' ', '+')"


@query(
    f"""WITH {_USED} SELECT k AS o_orderkey, 'https://www.cars24.com/buy-used-' || coalesce({_WORD.format('make')} || '-', '') || 'cars-' || {_WORD.format("coalesce(city, 'hyderabad')")} || '/?' || coalesce('f=bodyType:in:' || lower(body) || '&', '') || coalesce('f=fuelType:in:' || lower(fuel) || '&', '')
  || coalesce('f=transmission:=:' || lower(trans) || '&', '') || 'f=listingPrice:bw:' || coalesce(low, 0) || ',' || coalesce(high, 10000000) || coalesce('&f=odometer:bw:0,' || km, '') || CASE WHEN coalesce(y0, y1) IS NOT NULL THEN '&f=year:bw:' || coalesce(y0, 2000) || ',' || coalesce(y1, 2025) ELSE '' END
  || coalesce('&f=seatNumber:in:' || seats, '') || '&sort=bestmatch&serveWarrantyCount=true&listingSource=TabFilter' AS pathed,
  'https://www.cartrade.com/second-hand/' || {_WORD.format("coalesce(city, 'hyderabad')")} || '/#sc=1&so=-1&city=105' || CASE WHEN greatest(1, coalesce(high, 10000000) // 100000) >= coalesce(low, 0) // 100000 THEN '&budget=' || (coalesce(low, 0) // 100000) || '-' || greatest(1, coalesce(high, 10000000) // 100000) ELSE '' END
  || coalesce('&fuel=' || CASE lower(fuel) WHEN 'petrol' THEN 1 WHEN 'diesel' THEN 2 WHEN 'cng' THEN 3 WHEN 'lpg' THEN 4 WHEN 'electric' THEN 5 ELSE CASE WHEN fuel IS NOT NULL THEN 1 END END, '') || coalesce('&trans=' || CASE lower(trans) WHEN 'automatic' THEN 2 ELSE CASE WHEN trans IS NOT NULL THEN 1 END END, '')
  || CASE WHEN km > 0 THEN '&kms=' || (km // 1000) || '-' ELSE '' END || coalesce('&bodytype=' || CASE lower(body) WHEN 'suv' THEN 6 WHEN 'muv' THEN 6 END, '') || coalesce('&car=' || CASE lower(make) WHEN 'kia' THEN 43 WHEN 'tata' THEN 12 ELSE CASE WHEN make IS NOT NULL THEN 8 END END, '') AS coded,
  'https://www.olx.in/hyderabad_g4058526/cars_c84' || CASE WHEN p IS NULL AND t IS NULL THEN '' ELSE '?filter=' || concat_ws('%2C', p, t) END AS filtered
FROM (SELECT *, CASE WHEN low > 0 AND high > 0 THEN 'price_between_' || low || '_to_' || high WHEN high > 0 THEN 'price_max_' || high WHEN low > 0 THEN 'price_min_' || low END AS p, CASE lower(trans) WHEN 'automatic' THEN 'transmission_eq_1' WHEN 'manual' THEN 'transmission_eq_2' END AS t FROM q)"""
)
def listing_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search addresses in three dialects, unknown cities and missing filters included."""
    rows = _used_requests(spark, sf_dir)
    made = {"pathed": addresses.PATHED, "coded": addresses.CODED, "filtered": addresses.FILTERED}
    return rows.select("o_orderkey", *(addresses.address(rows, d, F.lit(2025)).alias(n) for n, d in made.items()))


@query(
    """WITH q AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS none, o_orderkey % 5 = 0 AS bad, 5 + o_custkey % 20 AS n, o_orderkey % 3 AS f FROM orders)
SELECT k AS o_orderkey, CASE WHEN none OR bad THEN 'regex_fallback' ELSE 'hybrid' END AS parser_used, CASE WHEN NOT none AND NOT bad THEN 'general' END AS use_case, CASE WHEN NOT none THEN CAST(n * 100000 AS BIGINT) END AS price_max,
  CASE WHEN NOT none THEN 'suv' END AS body_type, CASE WHEN NOT none AND NOT bad AND f = 0 THEN 'automatic' WHEN NOT none AND bad AND f = 0 THEN NULL END AS transmission, CASE WHEN NOT none THEN CAST(7 AS INTEGER) END AS seats FROM q"""
)
def dispatched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the hybrid parser, by the plain one where that fails: ``amt`` is a transmission to the first alone."""
    k = F.col("o_orderkey")
    text = F.when(k % 7 > 0, _said("SUV under ", 5 + F.col("o_custkey") % 20, " lakh 7 seater", F.when(k % 3 == 0, " amt").otherwise("")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("query"))
    out = failures.dispatched(rows, fails=k % 5 == 0)
    return out.select("o_orderkey", "parser_used", F.col("intent.use_case").alias("use_case"), *(F.col(f"filters.{n}").alias(n) for n in ("price_max", "body_type", "transmission", "seats")))


@query(
    """WITH s AS (SELECT o_orderkey AS k, o_custkey % 3 AS src, CASE WHEN o_orderkey % 10 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS raw FROM orders)
SELECT ['first', 'second', 'third'][src + 1] AS source, count(*) FILTER (raw NOT LIKE 'x%') AS n, count(*) FILTER (raw LIKE 'x%') AS n_errors, CAST(sum(CASE WHEN raw NOT LIKE 'x%' THEN CAST(raw AS BIGINT) * 2 END) AS BIGINT) AS total FROM s WHERE src < 2 GROUP BY src
UNION ALL SELECT 'third', 0, 1, NULL"""
)
def failures_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three sources gave and failed at: rows that can't be read in two, and a third that isn't there."""
    raw = F.when(F.col("o_orderkey") % 10 == 0, _said("x", F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), (F.col("o_custkey") % 3).alias("src"))
    read = {"first": lambda: rows.where("src = 0"), "second": lambda: rows.where("src = 1"), "third": lambda: spark.read.parquet(f"{sf_dir}/no such table.parquet").select("o_orderkey", "raw")}
    union, absent = failures.union_of(read, ["o_orderkey", "raw"])
    tried = failures.attempted(union, "raw", lambda t: str(2 * int(t)))
    per = tried.groupBy("source").agg(F.count("value").alias("n"), F.count("error").alias("n_errors"), F.sum(F.col("value").cast("bigint")).alias("total"))
    return per.union(spark.createDataFrame([(name, 0, 1, None) for name, _ in absent], "source string, n long, n_errors long, total long"))


_MODELS = [("Tata", "Nexon"), ("Hyundai", "Creta"), ("Maruti Suzuki", "Swift"), ("Mahindra", "XUV 3XO"), ("MG", "Windsor EV")]
_BOXES = ["5 Speed Manual", "Automatic (DCT)", "Automatic (AMT)", "automatic", "Manual", "Automatic (TC)"]


def _gearbox_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as variants of five models, with transmissions of six texts and a word of the part's name as variant."""
    k = F.col("p_partkey")
    pick = lambda on, words: F.array(*map(F.lit, words))[on.cast("int")]
    return table(spark, sf_dir, "part").select(
        "p_partkey", pick(k % 5, [m for m, _ in _MODELS]).alias("make"), pick(k % 5, [m for _, m in _MODELS]).alias("model"), F.col("p_name").alias("variant"),
        F.when(k % 11 > 0, pick(k % 6, _BOXES)).alias("transmission"), F.when(k % 5 == 4, "Electric").otherwise("Petrol").alias("fuel_type"),
    )


_RULES_SQL = ", ".join(f"('{a}', '{b}', {i}, '{p}', {n})" for i, (a, b, p, n) in enumerate(build.GEARBOX_RULES))


@query(
    f"""WITH r AS (SELECT p_partkey, {[m for m, _ in _MODELS]}[p_partkey % 5 + 1] AS make, {[m for _, m in _MODELS]}[p_partkey % 5 + 1] AS model, p_name || ' ' || CASE WHEN p_partkey % 11 > 0 THEN {_BOXES}[p_partkey % 6 + 1] ELSE '' END AS t FROM part),
u(make, model, priority, pattern, speeds) AS (VALUES {_RULES_SQL}), m AS (SELECT c.compat, r.*, (SELECT min_by(speeds, priority) FROM u WHERE u.make = r.make AND u.model = r.model AND regexp_matches(r.t, CASE WHEN compat THEN replace(pattern, '\\', '\\\\') ELSE pattern END, 'i')) AS s FROM r, (VALUES (TRUE), (FALSE)) c(compat))
SELECT compat, p_partkey, CAST(coalesce(s, CASE WHEN p_partkey % 5 = 4 THEN 1 END) AS VARCHAR) AS value FROM m WHERE coalesce(s, CASE WHEN p_partkey % 5 = 4 THEN 1 END) IS NOT NULL"""
)
def gearbox_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gearboxes by a joined rule table, with the patterns as the results to match have them and as they were meant."""
    rows = _gearbox_records(spark, sf_dir)
    each = [build.gearbox_rule_candidates(rows, build.gearbox_rules(spark, compat=c), "p_partkey").select(F.lit(c).alias("compat"), "p_partkey", "value") for c in (True, False)]
    return each[0].union(each[1])


@query(
    """WITH r AS (SELECT p_partkey, ['Swift', 'Windsor EV', 'Creta', 'Nexon'][p_partkey % 4 + 1] AS model, p_name AS variant, p_partkey % 3 AS t, p_size FROM part),
c AS (SELECT p_partkey, 'boot_space_litres' AS field, CAST(p_size AS VARCHAR) AS value, 'brochure' AS source, 0.93 AS confidence, 'MODEL_LEVEL' AS scope FROM (SELECT r.*, s.p_size FROM (SELECT p_partkey, model FROM r) r JOIN (SELECT model, min(p_size) AS p_size FROM r GROUP BY 1) s USING (model))
UNION ALL SELECT p_partkey, f.field, 'Yes', 'portal', 0.85, 'VARIANT_LEVEL' FROM r, (VALUES (0, 'ebd'), (1, 'rear_parking_sensors')) f(pos, field) WHERE t > 0 AND (pos = 0 OR model IN ('Swift', 'Windsor EV')))
SELECT p_partkey, field, value, source, confidence::DOUBLE AS confidence, scope, CASE field WHEN 'boot_space_litres' THEN 'brochure,archive' ELSE 'portal' END AS sources FROM c"""
)
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two registered adapters, capped at their sources' ceilings, beside the sources of each field by priority."""
    k = F.col("p_partkey")
    model = F.array(*map(F.lit, ["Swift", "Windsor EV", "Creta", "Nexon"]))[(k % 4).cast("int")]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("m").alias("make"), model.alias("model"), F.col("p_name").alias("variant"), F.lit("petrol").alias("fuel_type"), F.lit("Manual").alias("transmission"), "p_size")
    specs = rows.groupBy("make", "model").agg(F.min("p_size").cast("string").alias("value")).select("make", "model", F.lit("boot_space_litres").alias("field"), "value", F.lit("spec sheet").alias("evidence"))
    listed = rows.withColumn("variant", F.when(k % 3 > 0, F.upper("variant")).otherwise(F.concat("variant", F.lit(" plus"))))
    held = registry.Registry()
    held.register(registry.Source("archive", ("boot_space_litres",), "MODEL_LEVEL", 9, 0.5))
    held.register(registry.Source("portal", ("ebd", "rear_parking_sensors"), "VARIANT_LEVEL", 2, 0.85, registry.OverlapAdapter(listed, "portal.example")))
    held.register(registry.Source("brochure", ("boot_space_litres",), "MODEL_LEVEL", 1, 0.93, registry.SpecAdapter(specs)))
    found = held.candidates(rows, "p_partkey", ["boot_space_litres", "ebd", "rear_parking_sensors"])
    return held.ranked(spark, found).select("p_partkey", "field", "value", "source", "confidence", "scope", F.array_join("sources", ",").alias("sources"))


@query(
    """WITH c AS (SELECT l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS seq, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS unit, CASE WHEN l_linenumber % 4 = 0 THEN l_quantity > 25 END AS b, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity END AS n,
  CASE WHEN l_linenumber % 3 = 0 THEN 'MODEL_LEVEL' WHEN l_linenumber % 3 = 1 THEN 'VARIANT_LEVEL' END AS scope FROM lineitem),
p AS (SELECT x.l_partkey, x.l_suppkey FROM c x JOIN c y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey AND x.seq < y.seq
  WHERE CASE WHEN x.unit <> '' AND y.unit <> '' AND x.unit <> y.unit THEN TRUE WHEN x.b IS NOT NULL OR y.b IS NOT NULL THEN x.b IS DISTINCT FROM y.b ELSE coalesce(abs(x.n - y.n) > 0.02 * greatest(abs(x.n), abs(y.n), 1.0), FALSE) OR coalesce(x.scope = 'MODEL_LEVEL' AND y.scope = 'VARIANT_LEVEL', FALSE) END)
SELECT l_partkey, l_suppkey, 'SSCONFLICT-' || l_partkey || '-' || l_suppkey || '-' || count(*) AS conflict_id FROM p GROUP BY l_partkey, l_suppkey"""
)
def conflict_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that stays of a cell's numbered conflicts."""
    n = F.col("l_linenumber")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"]
    rows = rules.numbered(table(spark, sf_dir, "lineitem"), [F.col(c) for c in order], "", 12).select(
        "l_partkey", "l_suppkey", F.col("candidate_id").cast("bigint").alias("seq"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("unit"), F.when(n % 4 == 0, F.col("l_quantity") > 25).alias("value_bool"),
        F.when(n % 4 > 0, F.col("l_quantity")).alias("value_num"), F.when(n % 3 == 0, "MODEL_LEVEL").when(n % 3 == 1, "VARIANT_LEVEL").alias("scope"),
    )
    return records.conflict_ids(rows, ["l_partkey", "l_suppkey"], "seq")


# Requests put together from an order's columns: 7 * 6 * 5 * 4 * 5 * 4 phrases, with numbers.
_PHRASES = [
    ["SUV", "sporty car", "Pick-Up", "suvs", "MUV or sedan", "convertible", ""], ["diesel", "EV", "gasoline hybrid", "evening drive", "CNG/petrol", ""], ["automatic", "manual", "AMT or manual", "cvt", ""],
    ["for my elderly parents", "luxury family car", "daily use", ""], ["with sun-roof and ABS", "panoramic roof, cooled seats", "Apple CarPlay", "airbag", ""], ["Tata or Land Rover", "MARUTI", "mgr", ""],
]
_AMOUNTS = ["{a} to {b} lakh", "under {b} crore", "above {a} cr", "{a} to {b} kmpl", "at least {a} kmpl", "below {b} lakhs {a}-seater", "good mileage", "for a large family", "max {b}"]


def _asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = [k, c, k + c, F.floor(k / 7), F.floor(c / 6), F.floor((k + c) / 5)]
    said = [F.array(*map(F.lit, words))[(on % len(words)).cast("int")] for on, words in zip(at, _PHRASES, strict=True)]
    amount = F.array(*map(F.lit, _AMOUNTS))[(F.floor(c / 3) % len(_AMOUNTS)).cast("int")]
    amount = F.replace(F.replace(amount, F.lit("{a}"), (3 + k % 9).cast("string")), F.lit("{b}"), (12 + c % 17).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.filter(F.array(*said[:3], amount, *said[3:]), lambda w: w != ""), " ").alias("query"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _one_of(words: list[str], whole: bool = True) -> str:
    """SQL: whether the lower-case text ``q`` has one of some words, as words or as parts."""
    said = "|".join(w.replace("-", "\\-") for w in words)
    return f"regexp_matches(q, '(^|[^a-z0-9_])({said})($|[^a-z0-9_])')" if whole else f"regexp_matches(q, '{said}')"


def _found(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(q, '{pattern}', {group}), '')"


def _money(pattern: str, number: int, unit: int) -> str:
    return f"CAST({_found(pattern, number)} AS BIGINT) * CASE WHEN {_found(pattern, unit)} IN ('cr', 'crore') THEN 10000000 ELSE 100000 END"


_AT = ["k", "c", "k + c", "k // 7", "c // 6", "(k + c) // 5"]
_TOLD = [f"{_sql_list(words)}[({at}) % {len(words)} + 1]" for at, words in zip(_AT, _PHRASES, strict=True)]
_AMOUNT = f"replace(replace({_sql_list(_AMOUNTS)}[(c // 3) % {len(_AMOUNTS)} + 1], '{{a}}', CAST(3 + k % 9 AS VARCHAR)), '{{b}}', CAST(12 + c % 17 AS VARCHAR))"
_SPAN, _CAP, _FLOOR = r"([0-9]+)\s*to\s*([0-9]+)\s*(lakhs|lakh|crore|cr)?", r"(?:under|below|less than|max|maximum|upto|up to)\s*([0-9]+)\s*(lakhs|lakh|crore|cr)?", r"(?:above|over|more than|min|minimum)\s*([0-9]+)\s*(lakhs|lakh|crore|cr)?"
_KM_SPAN, _KM_LEAST, _KM_MOST = r"([0-9]+)\s*to\s*([0-9]+)\s*kmpl", r"(?:above|more than|at least|min|minimum)\s*([0-9]+)\s*kmpl", r"(?:under|below|less than|max|maximum)\s*([0-9]+)\s*kmpl"
_AUTO, _MANUAL = _one_of(["automatic", "amt", "cvt", "dct", "auto"]), _one_of(["manual"])


def _case(classes: list[tuple[str, list[str]]], whole: bool = True, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_one_of(words, whole)} THEN '{name}'" for name, words in classes) + f" ELSE {otherwise} END"


@query(
    f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), t AS (SELECT k AS o_orderkey, lower(array_to_string(list_filter([{', '.join([*_TOLD[:3], _AMOUNT, *_TOLD[3:]])}], lambda x: x <> ''), ' ')) AS q FROM o)
SELECT o_orderkey, CASE WHEN {_found(_SPAN, 1)} IS NOT NULL THEN {_money(_SPAN, 1, 3)} WHEN {_found(_CAP, 1)} IS NULL THEN {_money(_FLOOR, 1, 2)} END AS price_min, CASE WHEN {_found(_SPAN, 1)} IS NOT NULL THEN {_money(_SPAN, 2, 3)} ELSE {_money(_CAP, 1, 2)} END AS price_max,
  coalesce(CAST({_found('([0-9]+)[- ]?seater', 1)} AS INTEGER), CASE WHEN {_one_of(['large family', 'big family'], False)} THEN 7 END) AS seats, {_case(intent.BODIES)} AS body_type, {_case(intent.FUELS)} AS fuel_type,
  CASE WHEN {_AUTO} AND NOT {_MANUAL} THEN 'automatic' WHEN {_MANUAL} AND NOT {_AUTO} THEN 'manual' END AS transmission, {_case(intent.USES, False, "'general'")} AS use_case,
  CASE WHEN {_found(_KM_SPAN, 1)} IS NOT NULL THEN {_found(_KM_SPAN, 1)}::DOUBLE WHEN {_found(_KM_LEAST, 1)} IS NOT NULL THEN {_found(_KM_LEAST, 1)}::DOUBLE WHEN {_found(_KM_MOST, 1)} IS NOT NULL THEN 0.0::DOUBLE WHEN {_one_of(['good mileage', 'fuel efficient', 'high mileage'], False)} THEN 18.0::DOUBLE END AS mileage_min,
  CASE WHEN {_found(_KM_SPAN, 1)} IS NOT NULL THEN {_found(_KM_SPAN, 2)}::DOUBLE WHEN {_found(_KM_LEAST, 1)} IS NULL THEN {_found(_KM_MOST, 1)}::DOUBLE END AS mileage_max,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_one_of([w])} THEN '{name}' END" for w, name in intent.MAKES)}], lambda x: x IS NOT NULL), ',') AS makes, array_to_string(list_filter([{', '.join(f"CASE WHEN {_one_of(words)} THEN '{name}' END" for name, words in intent.FEATURES)}], lambda x: x IS NOT NULL), ',') AS features FROM t"""
)
def intent_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the intent of thousands of different request texts."""
    got = intent.parsed(_asked_texts(spark, sf_dir))
    return got.select("o_orderkey", "price_min", "price_max", "seats", "body_type", "fuel_type", "transmission", "use_case", "mileage_min", "mileage_max", F.array_join("makes", ",").alias("makes"), F.array_join("features", ",").alias("features"))
