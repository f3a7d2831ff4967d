"""Queries of whole-batch checks, reports, provenance and labelled evaluation, with SQL written from the rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import intent
from veldspar.operators import audits, build, filters, ranking, records, rules
from veldspar.plans.registry import registered
from veldspar.session import shared_dir, table

QUERIES, ORACLES, query = registered()

# Customers as records: segment is the model, and values are missing by nation and balance.
_RECORD = """r AS (SELECT c_custkey AS k, c_mktsegment AS model, ['petrol', 'diesel', NULL, 'electric'][c_nationkey % 4 + 1] AS fuel_type, CASE WHEN c_nationkey % 3 > 0 THEN 'b' || c_nationkey % 3 ELSE '' END AS body_type, CASE WHEN c_custkey % 2 = 0 THEN 'Manual' END AS transmission,
  CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS VARCHAR) END AS power_bhp, CASE WHEN c_nationkey % 5 > 0 THEN CAST(c_nationkey * 100 AS VARCHAR) END AS engine_cc, CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE '' END AS make FROM customer)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    fuel = F.array(F.lit("petrol"), F.lit("diesel"), F.lit(None), F.lit("electric"))[(n % 4).cast("int")]
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.col("c_mktsegment").alias("model"), fuel.alias("fuel_type"), F.when(n % 3 > 0, F.concat(F.lit("b"), (n % 3).cast("string"))).otherwise("").alias("body_type"), F.when(k % 2 == 0, "Manual").alias("transmission"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("power_bhp"), F.when(n % 5 > 0, (n * 100).cast("string")).alias("engine_cc"), F.when(k % 7 > 0, F.col("c_name")).otherwise("").alias("make"),
    )


_FIELDS = ["power_bhp", "engine_cc", "make"]
_BY = ["model", "fuel_type", "body_type", "transmission"]
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT k, model, fuel_type, body_type, transmission, '{f}' AS field, {f} AS value FROM r" for f in _FIELDS) + ")"


@query(f"WITH {_RECORD}, {_CELLS} " + " UNION ALL ".join(f"SELECT field, '{c}' AS \"column\", CASE WHEN coalesce({c}, '') = '' THEN 'UNKNOWN' ELSE {c} END AS grp, count(*) AS n, count(*) FILTER (value <> '') AS n_populated, round(100.0 * count(*) FILTER (value <> '') / count(*), 2)::DOUBLE AS pct FROM cells GROUP BY 1, 3" for c in _BY))
def coverage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each field by each of four columns from one scan."""
    return audits.coverage_sets(_records(spark, sf_dir), "k", _FIELDS, _BY)


@query(f"WITH {_RECORD}, {_CELLS}, p AS (SELECT field, round(100.0 * count(*) FILTER (value <> '') / count(*), 2)::DOUBLE AS pct FROM cells GROUP BY 1), a AS (SELECT 'poorest' AS \"end\", row_number() OVER (ORDER BY pct, field) AS place, field, pct FROM p UNION ALL SELECT 'best', row_number() OVER (ORDER BY pct DESC, field), field, pct FROM p) SELECT \"end\", CAST(place AS INTEGER) AS place, field, pct FROM a WHERE place <= 2")
def field_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two poorest and the two best fields."""
    per = records.coverage(_records(spark, sf_dir), "k", _FIELDS).select("field", "pct")
    return audits.extremes(per, 2)


@query(f"WITH {_RECORD}, {_CELLS}, p AS (SELECT model, field, round(avg(CASE WHEN value <> '' THEN 100.0 ELSE 0.0 END), 6) AS c FROM cells GROUP BY 1, 2) SELECT model, round(avg(c), 6) AS mean_coverage, array_to_string((list(field ORDER BY c, field))[1:2], ',') AS weakest FROM p GROUP BY 1")
def weakest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model its mean coverage and its two weakest fields."""
    cells = records.cells(_records(spark, sf_dir), "k", _FIELDS, ["model"])
    return audits.weakest_fields(cells, "model", 2).withColumn("weakest", F.array_join("weakest", ","))


# Parts as the three outputs of a build, each part in one, every 17th in two.
_OUT = """p AS (SELECT p_partkey AS k, p_size AS n, p_brand AS make, CASE WHEN p_partkey % 19 > 0 THEN p_name END AS model, 'v' || p_partkey % 500 AS variant, ['petrol', 'electric', 'cng'][p_partkey % 3 + 1] AS fuel_type, 'Manual' AS transmission, p_retailprice AS price,
  CASE WHEN p_partkey % 23 = 0 THEN 'n/a' ELSE CAST(p_size * 2 AS VARCHAR) END AS power_bhp, CASE WHEN p_partkey % 29 = 0 THEN 2 ELSE p_partkey % 2 END AS abs_, CASE WHEN p_partkey % 4 = 0 THEN p_size * 150 END AS engine_cc, CASE WHEN p_partkey % 5 = 0 THEN 18.5 END AS kmpl FROM part),
o AS (SELECT *, ['recommendation_ready', 'nullable_usable', 'excluded'][k % 3 + 1] AS subset FROM p UNION ALL SELECT *, 'excluded' FROM p WHERE k % 17 = 0)"""
_BASE = "SELECT {check!r} AS \"check\", CAST({key} AS VARCHAR) AS key, {field} AS field, {detail} AS detail FROM {rows}"
_FOUND = " UNION ALL ".join(
    _BASE.format(check=check, key=key, field=field, detail=detail, rows=rows)
    for check, key, field, detail, rows in [
        ("required", "k", "'model'", "NULL", "o WHERE model IS NULL"), ("numeric", "k", "'power_bhp'", "power_bhp", "o WHERE k % 23 = 0"), ("boolean", "k", "'abs'", "'2'", "o WHERE k % 29 = 0"),
        ("implausible", "k", "'engine_cc'", "'EV has engine_cc'", "o WHERE fuel_type = 'electric' AND engine_cc IS NOT NULL"), ("implausible", "k", "'engine_cc'", "CAST(engine_cc AS VARCHAR) || '.0'", "o WHERE fuel_type <> 'electric' AND engine_cc NOT BETWEEN 600 AND 6000"),
        ("implausible", "k", "'mileage'", "'EV mileage contamination'", "o WHERE fuel_type = 'electric' AND kmpl IS NOT NULL"), ("implausible", "k", "'mileage_arai_kmpl'", "'CNG km/kg in km/l field'", "o WHERE fuel_type = 'cng' AND kmpl IS NOT NULL"),
        ("protected", "k", "'make'", "make || ' -> ' || make", "o WHERE FALSE"), ("protected", "k", "'variant'", "'old -> ' || variant", "o WHERE k % 31 = 0"), ("provenance", "k", "'engine_cc'", "NULL", "o WHERE k % 6 = 0"),
        ("duplicate", "key", "NULL", "CAST(n AS VARCHAR)", "(SELECT make || '|' || coalesce(model, '') || '|' || variant || '|' || fuel_type || '|' || transmission AS key, count(*) AS n FROM o GROUP BY make, model, variant, fuel_type, transmission HAVING count(*) > 1)"),
        ("ready", "k", "NULL", "NULL", "(SELECT k FROM o GROUP BY k HAVING bool_or(subset = 'recommendation_ready') AND bool_or(subset = 'excluded'))"), ("unknown", "CAST(NULL AS VARCHAR)", "'surprise'", "NULL", "(SELECT 1)"),
    ]
)


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    fuel = F.array(*map(F.lit, ["petrol", "electric", "cng"]))[(k % 3).cast("int")]
    entry = F.struct(F.lit("https://x").alias("source_url"), F.when(k % 6 > 0, n.cast("string")).otherwise("").alias("raw_value"))
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.col("p_brand").alias("make"), F.when(k % 19 > 0, F.col("p_name")).alias("model"), F.concat(F.lit("v"), (k % 500).cast("string")).alias("variant"), fuel.alias("fuel_type"), F.lit("Manual").alias("transmission"),
        F.when(k % 23 == 0, "n/a").otherwise((n * 2).cast("string")).alias("power_bhp"), F.when(k % 29 == 0, 2).otherwise(k % 2).alias("abs"), F.when(k % 4 == 0, n * 150).alias("engine_cc"), F.when(k % 5 == 0, 18.5).alias("mileage_arai_kmpl"),
        F.when(k % 2 == 0, F.create_map(F.lit("engine_cc"), entry)).alias("provenance"), F.lit(1).alias("surprise"),
    )
    source = rows.withColumn("variant", F.when(F.col("k") % 31 == 0, "old").otherwise(F.col("variant")))
    each = [rows.where(F.col("k") % 3 == i) for i in range(3)]
    outputs = audits.union_of_outputs(each[0], each[1], each[2].unionByName(rows.where("k % 17 = 0")))
    known = [c for c in outputs.columns if c != "surprise"]
    identity = ["make", "model", "variant", "fuel_type", "transmission"]
    return audits.output_violations(outputs, source, "k", identity, ["make", "model", "variant"], ["power_bhp", "engine_cc"], ["abs"], ["make", "variant"], known, "provenance")


@query(f"WITH {_OUT} {_FOUND}")
def output_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation of the eight checks over a build's three outputs, and the unknown columns."""
    return _violations(spark, sf_dir)


@query(f"WITH {_OUT}, v AS ({_FOUND}) SELECT CASE \"check\" {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in audits.FAILURES.items())} END AS failure, count(*) AS n FROM v WHERE \"check\" <> 'unknown' GROUP BY 1")
def output_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the checks that fail, with their counts."""
    return audits.rollup_of(_violations(spark, sf_dir))


_BLOCKS = [f"block{i}" for i in range(6)]
_PROVENANCE = """e AS (SELECT o_orderkey AS k, b, CASE WHEN b % 2 = 0 THEN 'list' ELSE 'one' END AS kind, ['engine_cc', 'airbags', 'abs'][(o_orderkey + b) % 3 + 1] AS name, CASE WHEN o_custkey % 4 = 0 THEN 'engine_cc' ELSE ['engine_cc', 'airbags', 'abs'][(o_orderkey + b) % 3 + 1] END AS field, b || ':' || o_custkey AS value FROM orders, range(6) t(b) WHERE (o_custkey + b) % 3 > 0),
m AS (SELECT k, b * 10 + 1 AS pos, b, value FROM e WHERE name = 'engine_cc' UNION ALL SELECT k, b * 10 + 2, b, value || '+' FROM e WHERE name = 'engine_cc' AND kind = 'list' UNION ALL SELECT k, b * 10 + 2, b, value FROM e WHERE kind = 'one' AND field = 'engine_cc')"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records with six provenance blocks, of which some are missing: even ones hold lists, odd ones single entries."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entry = "struct<field:string,value:string,source:string>"
    held = []
    for b in range(6):
        name = F.array(*map(F.lit, ["engine_cc", "airbags", "abs"]))[((k + b) % 3).cast("int")]
        one = lambda more, name=name, b=b: F.struct(F.when(c % 4 == 0, "engine_cc").otherwise(name).alias("field"), F.concat(F.lit(f"{b}:"), c.cast("string"), F.lit(more)).alias("value"), F.lit("s").alias("source")).cast(entry)
        value = F.array(one(""), one("+")) if b % 2 == 0 else one("")
        held.append(F.when((c + b) % 3 > 0, F.create_map(name, value)).alias(_BLOCKS[b]))
    return table(spark, sf_dir, "orders").select("o_orderkey", *held)


@query(f"WITH {_PROVENANCE} SELECT o_orderkey, array_to_string(list('block' || b || '=' || value ORDER BY pos) FILTER (value IS NOT NULL), ' ') AS entries FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1")
def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that six provenance blocks say about a field, in their order."""
    rows = _blocks(spark, sf_dir)
    told = F.transform(audits.provenance_blocks(rows, _BLOCKS, F.lit("engine_cc")), lambda e: F.concat(e["block"], F.lit("="), e["value"]))
    return rows.select("o_orderkey", F.nullif(F.array_join(told, " "), F.lit("")).alias("entries"))


@query(f"WITH {_PROVENANCE}, o AS (SELECT k, name, min(b) AS b, min_by(value, b) AS value FROM e WHERE kind = 'one' GROUP BY 1, 2) SELECT k AS o_orderkey, name AS field, value FROM o")
def first_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several blocks the first one's entry for each field."""
    rows = _blocks(spark, sf_dir)
    return rows.select("o_orderkey", F.explode(audits.first_provenance([F.col(b) for b in _BLOCKS[1::2]])).alias("field", "e")).select("o_orderkey", "field", "e.value")


_STATUS = ["ACCEPTED", "REJECTED_INHERITANCE_POLICY", "REJECTED_VALIDATION", "EXISTING_VALUE_PRESERVED"]


@query(
    f"""WITH d AS (SELECT {_STATUS}[l_linenumber % 4 + 1] AS terminal_status, CASE WHEN l_suppkey % 3 = 0 THEN 'direct exact-record assignment' ELSE coalesce(CASE l_partkey % 3 WHEN 0 THEN 'MODEL_LEVEL' WHEN 1 THEN 'POWERTRAIN_LEVEL' END, 'UNKNOWN') END AS scope FROM lineitem)
SELECT terminal_status, scope, count(*) AS n FROM d GROUP BY ROLLUP (terminal_status, scope) UNION ALL SELECT 'REJECTED*', NULL, count(*) FILTER (terminal_status LIKE 'REJECTED%') FROM d"""
)
def scope_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions by status and scope with all totals, and the sum over rejections."""
    status = F.array(*map(F.lit, _STATUS))[(F.col("l_linenumber") % 4).cast("int")]
    scope = F.when(F.col("l_partkey") % 3 == 0, "MODEL_LEVEL").when(F.col("l_partkey") % 3 == 1, "POWERTRAIN_LEVEL")
    return audits.scope_totals(table(spark, sf_dir, "lineitem").select(status.alias("terminal_status"), scope.alias("scope"), (F.col("l_suppkey") % 3 > 0).alias("inherited")))


@query(
    f"""WITH {_RECORD}, a AS (SELECT k, power_bhp AS p0, engine_cc AS e0, coalesce(power_bhp, CASE WHEN k % 3 = 0 THEN '100' END) AS p1, engine_cc AS e1 FROM r),
c AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'oem' WHEN 1 THEN 'portal' END AS source, CASE WHEN l_partkey % 2 = 0 THEN 'MODEL_LEVEL' END AS scope, l_discount < 0.05 AS ok, 1 - l_discount < 0.93 AS low FROM lineitem),
m AS (SELECT count(*) AS n, count(p0) AS p0, count(e0) AS e0, count(p1) AS p1, count(e1) AS e1 FROM a)
SELECT 'totals' AS section, 'records' AS name, n::DOUBLE AS value FROM m UNION ALL SELECT 'totals', 'completeness before', 50.0::DOUBLE * (p0 + e0) / n FROM m UNION ALL SELECT 'totals', 'completeness after', 50.0::DOUBLE * (p1 + e1) / n FROM m
UNION ALL SELECT 'coverage before', 'power_bhp', p0 FROM m UNION ALL SELECT 'coverage before', 'engine_cc', e0 FROM m UNION ALL SELECT 'coverage after', 'power_bhp', p1 FROM m UNION ALL SELECT 'coverage after', 'engine_cc', e1 FROM m
UNION ALL SELECT 'gained', 'power_bhp', p1 - p0 FROM m WHERE p1 > p0 UNION ALL SELECT 'candidates by source', coalesce(source, 'none'), count(*) FROM c GROUP BY 2 UNION ALL SELECT 'accepted by source', coalesce(source, 'none'), count(*) FILTER (ok) FROM c GROUP BY 2
UNION ALL SELECT 'accepted by scope', coalesce(scope, 'none'), count(*) FILTER (ok) FROM c GROUP BY 2 UNION ALL SELECT 'totals', 'candidates', count(*) FROM c UNION ALL SELECT 'totals', 'accepted', count(*) FILTER (ok) FROM c UNION ALL SELECT 'totals', 'low confidence', count(*) FILTER (low) FROM c"""
)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a batch that fills a field, with what is observed while its records are written."""
    before = _records(spark, sf_dir).select("k", "power_bhp", "engine_cc")
    after = before.withColumn("power_bhp", F.coalesce("power_bhp", F.when(F.col("k") % 3 == 0, "100")))
    line = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_suppkey") % 3 == 0, "oem").when(F.col("l_suppkey") % 3 == 1, "portal")
    said = line.select(source.alias("source"), F.when(F.col("l_partkey") % 2 == 0, "MODEL_LEVEL").alias("scope"), (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_discount") < 0.05, "ACCEPTED").otherwise("OTHER").alias("status"))
    return audits.batch_report(before, after, said, "k", ["power_bhp", "engine_cc"], f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}", 0.93)


@query(
    """WITH o AS (SELECT o_orderkey AS k, 5 + o_custkey % 20 AS n, o_custkey % 3 AS b, o_orderkey % 4 AS f, o_orderkey % 5 AS t, o_custkey % 7 = 0 AS sun FROM orders),
w AS (SELECT 'price_max' AS field, TRUE AS ok FROM o UNION ALL SELECT 'body_type', k % 10 > 0 FROM o WHERE b < 2 UNION ALL SELECT 'fuel_type', TRUE FROM o WHERE f < 2 UNION ALL SELECT 'transmission', t = 0 FROM o WHERE t < 2 UNION ALL SELECT 'sunroof', TRUE FROM o WHERE sun)
SELECT coalesce(field, 'all') AS field, count(*) AS total, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM w GROUP BY ROLLUP (field)"""
)
def labelled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser over labelled requests, some labels wrong (every tenth body, each manual): accuracy of each field and of all."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda on, *words: F.array(*map(F.lit, words))[on.cast("int")]
    body, fuel, gear = pick(c % 3, "suv", "sedan", "unknown"), pick(k % 4, "diesel", "cng", "unknown", "unknown"), pick(k % 5, "automatic", "manual", "unknown", "unknown", "unknown")
    word = lambda x: F.when(x != "unknown", F.concat(F.lit(" "), x)).otherwise("")
    text = F.concat(F.lit("car"), word(body), word(fuel), F.when(k % 5 == 0, " automatic").otherwise(""), F.when(c % 7 == 0, " with sunroof").otherwise(""), F.lit(" under "), (5 + c % 20).cast("string"), F.lit(" lakh"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("query"), F.when(k % 10 == 0, "muv").otherwise(body).alias("want_body"), body.alias("body"), fuel.alias("want_fuel"), gear.alias("want_gear"), (5 + c % 20).alias("n"), (c % 7 == 0).alias("want_sunroof"))
    rows = rows.withColumn("want_body", F.when(F.col("body") == "unknown", "unknown").otherwise(F.col("want_body")))
    expected = audits.informative({"price_max": F.col("n") * 100_000, "body_type": F.col("want_body"), "fuel_type": F.col("want_fuel"), "transmission": F.col("want_gear")}, {"sunroof": F.col("want_sunroof")})
    parsed = intent.parsed(rows.withColumn("expected", expected))
    found = audits.informative({n: F.col(n) for n in ("price_max", "body_type", "fuel_type", "transmission", "use_case")}, {"sunroof": F.array_contains("features", "sunroof")})
    return audits.field_accuracy(parsed.withColumn("found", found), "expected", "found")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5.0 ELSE 7.0 END AS seats, p_size % 2 AS abs_, p_size AS size FROM part), q(use, seats_, abs__, size_) AS (VALUES ('a', 5.0, 1.0, NULL), ('b', NULL, 1.0, 7.0), ('c', NULL, NULL, NULL))
SELECT use, p_partkey, 5.0::DOUBLE * (coalesce(seats = seats_, FALSE)::INTEGER + coalesce(abs_ = abs__, FALSE)::INTEGER + coalesce(size = size_, FALSE)::INTEGER) AS points,
  concat_ws('; ', CASE WHEN seats = seats_ THEN 'matches seats' END, CASE WHEN abs_ = abs__ THEN 'matches abs' END, CASE WHEN size = size_ THEN 'matches size' END) AS reasons FROM c, q""")
def explicit_filter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and reasons for number columns that a request asks for by name; columns that the catalog lacks or that have rules of their own give none."""
    cars = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, 5.0).otherwise(7.0).alias("seats"), (F.col("p_size") % 2).alias("abs"), F.col("p_size").alias("size"), F.col("p_size").alias("Power"))
    asks = spark.createDataFrame([("a", {"seats": 5.0, "abs": 1.0, "absent": 1.0}), ("b", {"abs": 1.0, "size": 7.0, "Power": 7.0}), ("c", {})], "use string, asked map<string,double>")
    found = ranking.asked_rules("asked", ["seats", "abs", "size", "Power"])
    return cars.crossJoin(F.broadcast(asks)).select("use", "p_partkey", ranking.points(found).cast("double").alias("points"), F.array_join(ranking.reasons(found), "; ").alias("reasons"))  # a few requests


_SHOWN = """SELECT p_brand AS "Make", p_name AS "Model", NULL::VARCHAR AS "Variant", p_retailprice::DOUBLE AS "Ex-Showroom_Price", NULL::VARCHAR AS "Displacement", CASE WHEN p_partkey % 5 > 0 THEN p_size::DOUBLE END AS "Power", NULL::VARCHAR AS "ARAI_Certified_Mileage", NULL::VARCHAR AS "Transmission", NULL::VARCHAR AS "Fuel_Type", NULL::VARCHAR AS "carImage",
  NULL::VARCHAR AS "carDekhoLink", NULL::VARCHAR AS "carWaleLink", p_size::DOUBLE AS ranking_score, p_type AS match_reasons FROM part"""


@query(_SHOWN)
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen keys of a recommendation; NaN is null, columns that the catalog lacks are too."""
    power = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("double")).otherwise(float("nan"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("Make"), F.col("p_name").alias("Model"), F.col("p_retailprice").cast("double").alias("Ex-Showroom_Price"), power.alias("Power"), F.col("p_size").cast("double").alias("score"), F.col("p_type").alias("reasons"))
    return filters.response(rows)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand || '|' || CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE 'None' END END AS record_id, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE p_type END AS p_type, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 > 0 THEN 'inheritance_scope is required when inheritance_used is true' END, CASE WHEN p_size > 40 THEN 'field_confidence must be between 0 and 1' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part")
def record_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids, values set where they are filled, and errors of candidates' own form."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.when(k % 4 == 0, k).alias("version_id"), F.when(k % 3 > 0, F.col("p_type")).alias("t"), F.when(k % 5 > 0, F.col("p_name")).otherwise("").alias("new"), "p_size")
    named = rows.withColumn("record_id", rules.identified(rows, ["p_brand", "t"]))
    errors = rules.candidate_errors(k % 2 == 0, F.when(k % 6 == 0, "MODEL_LEVEL"), F.col("p_size") / 40)
    return filters.set_if_filled(named, "p_type", F.col("new")).select("p_partkey", "record_id", "p_type", F.array_join(errors, "; ").alias("errors"))


@query(
    """WITH c AS (SELECT c_custkey AS k, ['petrol', 'CNG', 'electric', NULL][c_nationkey % 4 + 1] AS fuel, field, CASE WHEN (c_custkey + length(field)) % 3 = 0 THEN 'v' END AS value, (c_custkey + length(field)) % 5 = 0 AS found
  FROM customer, (VALUES ('kerb_weight_kg'), ('boot_space_litres'), ('fuel_tank_capacity_litres'), ('engine_cc'), ('battery_capacity_kwh')) f(field))
SELECT k AS c_custkey, field, CASE WHEN field = 'kerb_weight_kg' THEN 'FIELD_NOT_PUBLISHED' WHEN field IN ('boot_space_litres', 'fuel_tank_capacity_litres') AND fuel = 'CNG' THEN 'UNSAFE_TO_INHERIT' ELSE 'SOURCE_UNAVAILABLE' END AS null_reason
FROM c WHERE value IS NULL AND NOT found AND NOT (field IN ('engine_cc', 'fuel_tank_capacity_litres') AND coalesce(fuel, '') = 'electric') AND NOT (field = 'battery_capacity_kwh' AND coalesce(fuel, '') <> 'electric')"""
)
def unfilled_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why cells are still empty after a merge that fills a fifth of them; cells that don't apply aren't told."""
    k = F.col("c_custkey")
    fuel = F.array(F.lit("petrol"), F.lit("CNG"), F.lit("electric"), F.lit(None))[(F.col("c_nationkey") % 4).cast("int")]
    names = ["kerb_weight_kg", "boot_space_litres", "fuel_tank_capacity_litres", "engine_cc", "battery_capacity_kwh"]
    before = table(spark, sf_dir, "customer").select("c_custkey", fuel.alias("fuel"), F.explode(F.array(*map(F.lit, names))).alias("field"))
    before = before.withColumn("value", F.when((k + F.length("field")) % 3 == 0, "v"))
    after = before.withColumn("value", F.coalesce("value", F.when((k + F.length("field")) % 5 == 0, "found")))
    return build.still_missing(before, after, "c_custkey").select("c_custkey", "field", "null_reason")
