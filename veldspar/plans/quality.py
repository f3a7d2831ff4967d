"""Queries of candidates, rules, audits, pages and listings on the driver's tables, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import model, pages, text
from veldspar.operators import build, listings, records, rules
from veldspar.plans.registry import registered
from veldspar.session import table

QUERIES, ORACLES, query = registered()

_GROUP = ["l_partkey", "l_suppkey"]
# A line item as a candidate for a (part, supplier) cell: every fourth holds a flag, the others a number.
_CANDIDATE = """c AS (SELECT l_partkey, l_suppkey, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS unit,
  CASE WHEN l_linenumber % 4 = 0 THEN l_quantity > 25 END AS value_bool, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity END AS value_num,
  CASE WHEN l_linenumber % 3 = 0 THEN 'MODEL_LEVEL' WHEN l_linenumber % 3 = 1 THEN 'VARIANT_LEVEL' END AS scope, 1 - l_discount AS confidence,
  ['official_variant', 'trusted_portal', 'official_brochure', 'blog'][l_suppkey % 4 + 1] AS kind, 'source ' || l_suppkey % 4 AS source, l_tax FROM lineitem)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey") % 4
    kind = F.array(*map(F.lit, ["official_variant", "trusted_portal", "official_brochure", "blog"]))[s.cast("int")]
    return table(spark, sf_dir, "lineitem").select(
        *_GROUP, (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + n).alias("seq"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("unit"),
        F.when(n % 4 == 0, F.col("l_quantity") > 25).alias("value_bool"), F.when(n % 4 > 0, F.col("l_quantity")).alias("value_num"),
        F.when(n % 3 == 0, "MODEL_LEVEL").when(n % 3 == 1, "VARIANT_LEVEL").alias("scope"), (1 - F.col("l_discount")).alias("confidence"), kind.alias("kind"), F.concat(F.lit("source "), s.cast("string")).alias("source"), "l_tax",
    )


_REASON = """CASE WHEN a.unit <> '' AND b.unit <> '' AND a.unit <> b.unit THEN 'unit mismatch' WHEN a.value_bool IS NOT NULL OR b.value_bool IS NOT NULL THEN CASE WHEN a.value_bool IS DISTINCT FROM b.value_bool THEN 'boolean disagreement' END
  WHEN a.value_num <> b.value_num AND abs(a.value_num - b.value_num) > 0.02 * greatest(abs(a.value_num), abs(b.value_num), 1.0) THEN 'numeric values differ beyond tolerance'
  WHEN a.scope = 'MODEL_LEVEL' AND b.scope = 'VARIANT_LEVEL' THEN 'model-level vs variant-level contradiction' END"""
_PAIRS = f"p AS (SELECT a.l_partkey, a.l_suppkey, {_REASON} AS reason FROM c a JOIN c b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.seq < b.seq)"


@query(f"WITH {_CANDIDATE}, {_PAIRS} SELECT reason, count(*) AS n FROM p WHERE reason IS NOT NULL GROUP BY reason")
def conflict_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.conflicts(_candidates(spark, sf_dir), _GROUP, "seq").groupBy("reason").agg(F.count("*").alias("n"))


_RANK = "CASE kind WHEN 'official_variant' THEN 0 WHEN 'official_brochure' THEN 1 ELSE CASE WHEN kind = 'trusted_portal' AND confidence >= 0.9 THEN 2 WHEN scope = 'MODEL_LEVEL' THEN 3 ELSE 4 END END"


def _rank() -> list:
    rank = records.source_rank(F.lit(None).cast("string"), F.col("kind"), F.col("confidence"), F.col("scope") == "MODEL_LEVEL")
    return [rank, F.desc("confidence"), F.col("seq"), F.col("l_tax")]


@query(f"WITH {_CANDIDATE}, w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_RANK}, confidence DESC, seq, l_tax) AS n FROM c) SELECT l_partkey, l_suppkey, seq, kind FROM w WHERE n = 1")
def source_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source rank, then confidence, then place."""
    return records.winners(_candidates(spark, sf_dir), _GROUP, _rank()).select(*_GROUP, "seq", "kind")


@query(
    f"""WITH {_CANDIDATE}, {_PAIRS}, v AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_RANK}, confidence DESC, seq, l_tax) AS n FROM c WHERE confidence >= 0.95),
g AS (SELECT DISTINCT l_partkey, l_suppkey FROM c), x AS (SELECT DISTINCT l_partkey, l_suppkey FROM p WHERE reason IS NOT NULL)
SELECT g.l_partkey, g.l_suppkey, CASE WHEN x.l_partkey IS NOT NULL THEN 'unresolved_conflict' WHEN v.seq IS NULL THEN 'manual_review' ELSE 'accepted' END AS status, CASE WHEN x.l_partkey IS NULL THEN v.seq END AS seq
FROM g LEFT JOIN x ON g.l_partkey = x.l_partkey AND g.l_suppkey = x.l_suppkey LEFT JOIN v ON g.l_partkey = v.l_partkey AND g.l_suppkey = v.l_suppkey AND v.n = 1"""
)
def resolve_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, in conflict or for review: candidates of confidence 0.95 count as valid."""
    rows = _candidates(spark, sf_dir).withColumn("status", F.when(F.col("confidence") >= 0.95, "VALID").otherwise("INVALID"))
    return records.resolved(rows, _GROUP, _rank(), records.conflicted(rows, _GROUP, "seq"))


@query(
    f"""WITH {_CANDIDATE}, w AS (SELECT l_partkey, value_num, unit, seq, row_number() OVER v AS n, first_value(seq) OVER v AS f FROM c WINDOW v AS (PARTITION BY l_partkey, value_num, unit ORDER BY seq, l_suppkey, confidence))
SELECT seq, l_partkey, CASE WHEN n > 1 THEN f END AS duplicate_of FROM w"""
)
def duplicate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("seq"), F.col("l_suppkey"), F.col("confidence")]
    return records.duplicates_marked(_candidates(spark, sf_dir), ["l_partkey", "value_num", "unit"], order, "seq").select("seq", "l_partkey", "duplicate_of")


# Candidates of a part's cells: the supplier is the source, and every seventh part has a value already.
_CELL = """d AS (SELECT l_partkey AS rid, l_linenumber AS field, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax, l_quantity, l_extendedprice, l_shipdate) AS seq, l_returnflag AS unit, CAST(NULL AS BOOLEAN) AS value_bool, floor(l_quantity / 10) AS value_num,
  CAST(NULL AS VARCHAR) AS scope, 1 - l_discount AS confidence, l_suppkey % 3 AS source, l_quantity > 48 AS bad, CASE WHEN l_partkey % 7 = 0 THEN 'kept' END AS existing FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY rid, field, source, value_num ORDER BY seq) AS k, first_value(seq) OVER (PARTITION BY rid, field, source, value_num ORDER BY seq) AS first FROM d),
f AS (SELECT *, CASE WHEN k > 1 THEN 'DUPLICATE_CANDIDATE' WHEN bad THEN 'REJECTED_VALIDATION' WHEN confidence < 0.92 THEN 'REJECTED_LOW_CONFIDENCE' END AS early FROM e),
v AS (SELECT *, row_number() OVER (PARTITION BY rid, field ORDER BY confidence DESC, seq) AS n FROM f WHERE early IS NULL),
x AS (SELECT DISTINCT a.rid, a.field FROM v a JOIN v b ON a.rid = b.rid AND a.field = b.field AND a.seq < b.seq WHERE a.unit <> b.unit OR abs(a.value_num - b.value_num) > 0.02 * greatest(a.value_num, b.value_num, 1.0)),
r AS (SELECT f.*, w.seq AS winner_, coalesce(early, CASE WHEN x.rid IS NOT NULL THEN 'CONFLICT_UNRESOLVED' WHEN existing IS NOT NULL THEN 'EXISTING_VALUE_PRESERVED' WHEN f.seq = w.seq THEN 'ACCEPTED' ELSE 'SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE' END) AS terminal_status
  FROM f LEFT JOIN x ON f.rid = x.rid AND f.field = x.field LEFT JOIN (SELECT rid, field, seq FROM v WHERE n = 1) w ON f.rid = w.rid AND f.field = w.field)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", "l_quantity", "l_extendedprice", "l_shipdate"]
    out = rules.numbered(rows, [F.col(c) for c in order], "", 12).withColumn("seq", F.col("candidate_id").cast("int"))
    return out.select(
        F.col("l_partkey").alias("rid"), F.col("l_linenumber").alias("field"), "seq", F.col("l_returnflag").alias("unit"), F.lit(None).cast("boolean").alias("value_bool"), F.floor(F.col("l_quantity") / 10).cast("double").alias("value_num"), F.lit(None).cast("string").alias("scope"), (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_suppkey") % 3).alias("source"), F.array_compact(F.array(F.when(F.col("l_quantity") > 48, "too large"))).alias("errors"), F.when(F.col("l_partkey") % 7 == 0, "kept").alias("existing"),
    )


def _disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dispositions(_cells(spark, sf_dir), ["rid", "field"], ["rid", "field", "source", "value_num"], [F.desc("confidence"), F.col("seq")], "seq", 0.92)


@query(f"WITH {_CELL} SELECT CAST(seq AS INTEGER) AS seq, rid, field, terminal_status, CAST(CASE terminal_status WHEN 'DUPLICATE_CANDIDATE' THEN first WHEN 'SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE' THEN winner_ END AS INTEGER) AS winner FROM r")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One terminal status for every candidate."""
    return _disposed(spark, sf_dir).select("seq", "rid", "field", "terminal_status", "winner")


@query(f"WITH {_CELL} SELECT CAST(source AS BIGINT) AS source, terminal_status, count(*) AS n FROM r GROUP BY ALL")
def disposition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disposed(spark, sf_dir).groupBy("source", "terminal_status").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('unknown status', CAST(0 AS BIGINT)), ('missing dispositions', CAST(0 AS BIGINT))) t(kind, n)")
def dispositions_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many dispositions as candidates, all of known statuses."""
    return records.reconciled(_disposed(spark, sf_dir), table(spark, sf_dir, "lineitem"))


@query(f"WITH {_CELL} SELECT rid, field, n_sources, n_values, has_accepted, n_values = 1 AS agree FROM (SELECT rid, field, count(DISTINCT source) AS n_sources, count(DISTINCT value_num) AS n_values, bool_or(terminal_status = 'ACCEPTED') AS has_accepted FROM r GROUP BY 1, 2) WHERE n_sources > 1")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.overlap(_disposed(spark, sf_dir).withColumnRenamed("value_num", "value"), ["rid", "field"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, 'VSAFE-' || lpad(CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax) AS VARCHAR), 6, '0') AS candidate_id FROM lineitem")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded places in an order, without one task for all."""
    order = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")]
    return rules.numbered(table(spark, sf_dir, "lineitem"), order, "VSAFE-").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "candidate_id")


_CUSTOMER = "r AS (SELECT c_custkey, c_mktsegment, c_nationkey AS nation, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS c_nationkey, ['petrol', 'diesel', 'cng', 'electric'][c_nationkey % 4 + 1] AS fuel FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nulls (negative balances, every fifth nation) and a fuel by nation."""
    rows, n = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    fuel = F.array(*map(F.lit, ["petrol", "diesel", "cng", "electric"]))[n % 4]
    return rows.select("c_custkey", "c_mktsegment", n.alias("nation"), "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(n % 5 > 0, n).alias("c_nationkey"), fuel.alias("fuel"))


@query(f"WITH {_CUSTOMER}, u AS (SELECT c_mktsegment AS grp, 'c_acctbal' AS field, CAST(c_acctbal AS VARCHAR) AS v FROM r UNION ALL SELECT c_mktsegment, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM r) SELECT field, grp, count(*) AS n, count(v) AS n_populated, count(*) - count(v) AS n_missing, count(DISTINCT v) AS n_distinct, round(100 * count(v) / count(*), 2) AS pct FROM u GROUP BY field, grp")
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.coverage(_customers(spark, sf_dir), "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment")


# Cells of customers as fields of records, and their policy.
_FIELDS = ["make", "power_bhp", "engine_cc", "battery_capacity_kwh", "reliability_score"]
_POLICY = [("make", "CORE_REQUIRED", 5, None, "Official site", "Portal", False, "low", "model"), ("power_bhp", "HIGH_VALUE", 4, ["petrol", "diesel", "cng"], "Portal", None, True, "medium", "model"), ("engine_cc", "HIGH_VALUE", 4, ["ALL"], "Official brochure", "Portal", True, "high", "model"), ("battery_capacity_kwh", "SPECIALIST", 3, None, "Portal", None, False, None, "model"), ("reliability_score", "SUBJECTIVE_OR_DERIVED", 1, None, "Survey", None, False, "high", "model")]
_ROWS = f"""{_CUSTOMER}, m AS (SELECT c_custkey, c_mktsegment AS model, fuel, CASE WHEN nation % 6 > 0 THEN c_name ELSE '' END AS make, c_acctbal AS power_bhp, c_nationkey AS engine_cc, CASE WHEN nation % 3 = 0 THEN nation END AS battery_capacity_kwh, CAST(NULL AS INTEGER) AS reliability_score FROM r),
cells AS (SELECT c_custkey, model, fuel, 'make' AS field, make AS value FROM m UNION ALL SELECT c_custkey, model, fuel, 'power_bhp', CAST(power_bhp AS VARCHAR) FROM m UNION ALL SELECT c_custkey, model, fuel, 'engine_cc', CAST(engine_cc AS VARCHAR) FROM m
  UNION ALL SELECT c_custkey, model, fuel, 'battery_capacity_kwh', CAST(battery_capacity_kwh AS VARCHAR) FROM m UNION ALL SELECT c_custkey, model, fuel, 'reliability_score', NULL FROM m),
why AS (SELECT *, CASE WHEN value IS NOT NULL THEN NULL WHEN field = 'power_bhp' AND fuel = 'electric' THEN 'NOT_APPLICABLE' WHEN field = 'reliability_score' THEN 'SUBJECTIVE_REQUIRES_DERIVATION' WHEN field = 'engine_cc' AND fuel = 'electric' THEN 'NOT_APPLICABLE'
  WHEN field = 'battery_capacity_kwh' AND fuel <> 'electric' THEN 'NOT_APPLICABLE' ELSE 'NOT_YET_ENRICHED' END AS reason FROM cells),
kept AS (SELECT *, CASE field WHEN 'make' THEN 5 WHEN 'power_bhp' THEN 3 WHEN 'engine_cc' THEN 3 WHEN 'battery_capacity_kwh' THEN 2 ELSE 0 END AS w, coalesce(value <> '', FALSE) AS ok FROM why WHERE reason IS DISTINCT FROM 'NOT_APPLICABLE'),
score AS (SELECT c_custkey, sum(w) AS total, sum(CASE WHEN ok THEN w ELSE 0 END) AS got, bool_or(field = 'make' AND NOT ok) AS core FROM kept GROUP BY 1),
done AS (SELECT c_custkey, CAST(total AS BIGINT) AS weighted_total, CAST(got AS BIGINT) AS weighted_populated, round(100.0 * got / total, 2)::DOUBLE AS score, CASE WHEN core THEN 'BASIC_READY' WHEN round(100.0 * got / total, 2) >= 90 THEN 'SPECIALIST_READY' WHEN round(100.0 * got / total, 2) >= 78 THEN 'STRONG_RECOMMENDATION_READY' WHEN round(100.0 * got / total, 2) >= 60 THEN 'PARTIALLY_ENRICHED' ELSE 'BASIC_READY' END AS tier FROM score)"""


def _record_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, policy) of customers as records."""
    n = F.col("nation")
    rows = _customers(spark, sf_dir).select("c_custkey", F.col("c_mktsegment").alias("model"), "fuel", F.when(n % 6 > 0, F.col("c_name")).otherwise("").alias("make"), F.col("c_acctbal").alias("power_bhp"), F.col("c_nationkey").alias("engine_cc"), F.when(n % 3 == 0, n).alias("battery_capacity_kwh"), F.lit(None).cast("int").alias("reliability_score"))
    policy = spark.createDataFrame(_POLICY, "field string, category string, importance int, fuels array<string>, source string, fallback string, inheritable boolean, difficulty string, variant string")
    return records.cells(rows, "c_custkey", _FIELDS, ["model", "fuel"]), policy


@query(f"WITH {_ROWS} SELECT * FROM done")
def weighted_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of applicable cells by category, and the readiness tier."""
    return rules.completeness(*_record_cells(spark, sf_dir), "c_custkey")


@query(f"WITH {_ROWS} SELECT tier, count(*) AS n FROM done GROUP BY 1")
def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.completeness(*_record_cells(spark, sf_dir), "c_custkey").groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH {_ROWS}, j AS (SELECT score, c_mktsegment, fuel FROM done JOIN r USING (c_custkey)) SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS grp, count(*) AS n, round(avg(score), 6) AS average, min(score) AS least, max(score) AS most FROM j GROUP BY 2 UNION ALL SELECT 'fuel', fuel, count(*), round(avg(score), 6), min(score), max(score) FROM j GROUP BY 2")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rules.completeness(*_record_cells(spark, sf_dir), "c_custkey").join(_customers(spark, sf_dir), "c_custkey")
    return records.group_means(scores, ["c_mktsegment", "fuel"])


@query(f"WITH {_ROWS} SELECT round(avg(score), 6) AS average, min(score) AS least, max(score) AS most FROM done")
def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary(rules.completeness(*_record_cells(spark, sf_dir), "c_custkey"))


@query(f"WITH {_ROWS} SELECT field, CAST(sum(w) AS BIGINT) AS missing_weight FROM kept WHERE NOT ok AND w > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def missing_weight_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, policy = _record_cells(spark, sf_dir)
    w = F.coalesce(*(F.when(F.col("category") == c, v) for c, v in rules.WEIGHTS.items()))
    return rules.missing_queue(cells, policy).withColumn("w", w).where("w > 0").groupBy("field").agg(F.sum("w").cast("bigint").alias("missing_weight")).orderBy(F.desc("missing_weight"), "field").limit(25)


@query(
    f"""WITH {_ROWS}, q AS (SELECT c_custkey, field, model, CASE field WHEN 'make' THEN 5 WHEN 'power_bhp' THEN 4 WHEN 'engine_cc' THEN 4 WHEN 'battery_capacity_kwh' THEN 3 ELSE 1 END AS importance, count(*) OVER (PARTITION BY field) AS frequency,
  CASE WHEN field IN ('make', 'engine_cc') THEN 0 ELSE 1 END AS official, CASE WHEN field IN ('power_bhp', 'engine_cc') THEN 0 ELSE 1 END AS inh, CASE field WHEN 'make' THEN 0 WHEN 'engine_cc' THEN 2 WHEN 'reliability_score' THEN 2 ELSE 1 END AS hard FROM kept WHERE NOT ok)
SELECT c_custkey, field, frequency, CAST(row_number() OVER (ORDER BY importance DESC, frequency DESC, official, inh, hard, model, c_custkey) AS INTEGER) AS place FROM q ORDER BY place LIMIT 100"""
)
def missing_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred empty applicable cells by priority."""
    top = rules.missing_queue(*_record_cells(spark, sf_dir)).orderBy(*rules.priority_order(), "c_custkey").limit(100)
    place = F.row_number().over(Window.orderBy(*rules.priority_order(), "c_custkey"))  # of a hundred rows
    return top.select("c_custkey", "field", "frequency", place.alias("place"))


@query(f"WITH {_ROWS} SELECT c_custkey, field, reason FROM why WHERE reason IS NOT NULL")
def null_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, policy = _record_cells(spark, sf_dir)
    reason = rules.null_reason(F.col("field"), F.col("fuel"), F.col("value"), F.col("fuels"))
    return cells.join(F.broadcast(policy), "field").select("c_custkey", "field", reason.alias("reason")).where("reason is not null")


@query(f"WITH {_CUSTOMER}, o AS (SELECT o_custkey, max(o_totalprice) AS value FROM orders GROUP BY 1) SELECT c_custkey, coalesce(c_acctbal, value) AS c_acctbal, c_acctbal IS NULL AND value IS NOT NULL AS filled, CASE WHEN c_acctbal IS NULL AND value IS NOT NULL THEN 'orders' END AS source FROM r LEFT JOIN o ON c_custkey = o_custkey")
def merge_fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written only where there was none, with their provenance."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value")).withColumn("source", F.lit("orders"))
    out = records.filled(_customers(spark, sf_dir), "c_custkey", "c_acctbal", found)
    return out.select("c_custkey", "c_acctbal", "filled", F.col("provenance.source").alias("source"))


@query(f"WITH {_CUSTOMER} SELECT r.c_custkey, 'c_acctbal' AS field FROM r JOIN customer c USING (c_custkey) WHERE r.c_acctbal IS DISTINCT FROM c.c_acctbal UNION ALL SELECT r.c_custkey, 'c_nationkey' FROM r JOIN customer c USING (c_custkey) WHERE r.c_nationkey IS DISTINCT FROM c.c_nationkey")
def protected_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.changed(table(spark, sf_dir, "customer"), _customers(spark, sf_dir), "c_custkey", ["c_acctbal", "c_nationkey", "c_name"]).select("c_custkey", "field")


@query(f"WITH {_CUSTOMER}, o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey, 'c_acctbal' AS field, CASE WHEN o_custkey IS NOT NULL THEN 'UNRESOLVED_CONFLICT' ELSE 'FIELD_NOT_PUBLISHED' END AS null_reason FROM r LEFT JOIN o ON c_custkey = o_custkey WHERE c_acctbal IS NULL")
def unresolved_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = records.cells(_customers(spark, sf_dir), "c_custkey", ["c_acctbal"])
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("c_acctbal").alias("field"))
    return records.unresolved(held, seen, "c_custkey").select("c_custkey", "field", "null_reason")


_VARIANTS = ["VX (O) Diesel", "VX o diesel dark edition", "VX+ Petrol Dual Tone", "Vx Plus petrol", "VX AMT", "vx"]
_GEARS = ["Manual", "5-Speed MT", "Automatic (AMT)", "AMT", "CVT", "Torque Converter"]


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs, n: F.array(*map(F.lit, xs))[(n % len(xs)).cast("int")]
    side = lambda n: F.struct(F.concat(F.lit("Make "), (n % 2).cast("string")).alias("make"), F.lit("Model-X").alias("model"), F.lit("Petrol").alias("fuel_type"), pick(_GEARS, n).alias("transmission"), pick(_VARIANTS, n).alias("variant"), (n % 3).alias("engine_cc"))
    return table(spark, sf_dir, "part").select("p_partkey", side(k).alias("ours"), side(k + F.when(k % 5 == 0, 0).otherwise(1) + F.when(k % 3 == 0, 1).otherwise(0)).alias("theirs"))


@query(
    """WITH i AS (SELECT p_partkey, p_partkey AS a, p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS b FROM part),
v(id, family, special, base) AS (VALUES (0, 'manual', '', 'o,vx'), (1, 'manual', 'dark', 'o,vx'), (2, 'amt', 'dual tone', 'plus,vx'), (3, 'amt', '', 'plus,vx'), (4, 'cvt', '', 'vx'), (5, 'tc', '', 'vx'))
SELECT p_partkey, CASE WHEN a % 2 <> b % 2 OR x.family <> y.family OR x.special <> y.special THEN 'MISMATCH' WHEN x.base = y.base THEN 'EXACT' WHEN x.base LIKE '%vx' THEN 'HIGH_CONFIDENCE' ELSE 'AMBIGUOUS' END AS status, x.special AS special, x.base AS base
FROM i JOIN v x ON x.id = a % 6 JOIN v y ON y.id = b % 6"""
)
def variant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, _ = rules.variant_match("ours", "theirs")
    return _identities(spark, sf_dir).select("p_partkey", status.alias("status"), F.array_join(text.special_editions(F.col("ours.variant")), ",").alias("special"), F.array_join(text.base_tokens(F.col("ours.variant")), ",").alias("base"))


@query(
    """WITH i AS (SELECT p_partkey, p_partkey % 4 AS t, p_partkey AS a, p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS b FROM part)
SELECT p_partkey, CASE WHEN t = 3 THEN 'inheritance not allowed by policy' WHEN t = 2 AND p_partkey % 8 = 2 THEN 'scope VARIANT_LEVEL is not a valid inheritance source' WHEN a % 2 <> b % 2 THEN 'make/model mismatch' WHEN t = 0 AND a % 3 <> b % 3 THEN 'powertrain mismatch on engine_cc' WHEN t = 0 AND a % 6 <> b % 6 THEN 'powertrain mismatch on transmission'
  WHEN t = 1 AND a % 6 <> b % 6 THEN 'trim-level inheritance requires explicit trim-family evidence' ELSE 'policy conditions satisfied' END AS reason FROM i"""
)
def inheritance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    scope = F.array(*map(F.lit, ["POWERTRAIN_LEVEL", "TRIM_FAMILY_LEVEL", "VARIANT_LEVEL", "MODEL_LEVEL"]))[(k % 4).cast("int")]
    scopes = F.when(k % 8 == 2, F.array(F.lit("MODEL_LEVEL"))).otherwise(F.array(*map(F.lit, ["POWERTRAIN_LEVEL", "TRIM_FAMILY_LEVEL", "VARIANT_LEVEL"])))
    same = {c: F.col(f"ours.{c}").eqNullSafe(F.col(f"theirs.{c}")) for c in ("make", "model", "fuel_type", "engine_cc", "transmission", "variant")}
    _, reason, _ = rules.inheritance(k % 4 < 3, scope, scopes, same)
    return _identities(spark, sf_dir).select("p_partkey", reason.alias("reason"))


# Parts as records with some values out of range or against their fuel.
_RECORD = """r AS (SELECT p_partkey, ['Petrol', 'CNG', 'Electric', ' diesel '][p_partkey % 4 + 1] AS fuel_type, p_brand AS make, CASE WHEN p_partkey % 11 > 0 THEN p_name END AS model, 'x' AS variant, p_retailprice * 1000 * CASE WHEN p_partkey % 13 = 0 THEN 100 ELSE 1 END AS price_ex_showroom, 'Manual' AS transmission, p_type AS body_type,
  p_size % 12 AS seating_capacity, p_size * 10 AS power_bhp, CAST(100 AS DOUBLE) AS torque_nm, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS mileage_arai_kmpl, CASE WHEN p_partkey % 4 = 1 THEN 20 END AS mileage_arai_km_per_kg, CASE WHEN p_partkey % 4 = 2 THEN 300 END AS claimed_ev_range_km, CASE WHEN p_partkey % 3 = 0 THEN 1200 END AS engine_cc, 6 AS airbags, TRUE AS abs FROM part)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    fuel = F.array(*map(F.lit, ["Petrol", "CNG", "Electric", " diesel "]))[(k % 4).cast("int")]
    return table(spark, sf_dir, "part").select(
        "p_partkey", fuel.alias("fuel_type"), F.col("p_brand").alias("make"), F.when(k % 11 > 0, F.col("p_name")).alias("model"), F.lit("x").alias("variant"), (F.col("p_retailprice") * 1000 * F.when(k % 13 == 0, 100).otherwise(1)).alias("price_ex_showroom"), F.lit("Manual").alias("transmission"), F.col("p_type").alias("body_type"), (s % 12).alias("seating_capacity"), (s * 10).alias("power_bhp"), F.lit(100.0).alias("torque_nm"),
        F.when(k % 2 == 0, s).alias("mileage_arai_kmpl"), F.when(k % 4 == 1, 20).alias("mileage_arai_km_per_kg"), F.when(k % 4 == 2, 300).alias("claimed_ev_range_km"), F.when(k % 3 == 0, 1200).alias("engine_cc"), F.lit(6).alias("airbags"), F.lit(True).alias("abs"),
    )


_ISSUES = """s AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN price_ex_showroom NOT BETWEEN 100000 AND 10000000 THEN 'price_ex_showroom' END, CASE WHEN seating_capacity NOT BETWEEN 2 AND 9 THEN 'seating_capacity' END, CASE WHEN power_bhp NOT BETWEEN 20 AND 800 THEN 'power_bhp' END,
  CASE WHEN mileage_arai_kmpl NOT BETWEEN 3 AND 45 THEN 'mileage_arai_kmpl' END, CASE WHEN p_partkey % 4 = 2 AND engine_cc IS NOT NULL THEN 'engine_cc' END, CASE WHEN p_partkey % 4 = 2 AND mileage_arai_kmpl IS NOT NULL THEN 'mileage' END, CASE WHEN p_partkey % 4 = 1 AND mileage_arai_kmpl IS NOT NULL THEN 'mileage_arai_kmpl' END], lambda x: x IS NOT NULL))) AS issues,
  list_filter([CASE WHEN model IS NULL THEN 'model' END, CASE WHEN p_partkey % 4 = 3 OR (p_partkey % 4 = 0 AND mileage_arai_kmpl IS NULL) THEN 'fuel_specific_efficiency' END], lambda x: x IS NOT NULL) AS missing FROM r),
t AS (SELECT p_partkey, CASE WHEN len(missing) = 0 AND len(issues) = 0 THEN 'recommendation_ready' WHEN list_contains(missing, 'model') THEN 'blocked' ELSE 'partially_ready' END AS status, array_to_string(list_concat(missing, issues), ',') AS blockers FROM s)"""


@query(f"WITH {_RECORD}, {_ISSUES} SELECT * FROM t")
def record_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    status, blockers = rules.readiness(rows)
    return rows.select("p_partkey", status.alias("status"), F.array_join(blockers, ",").alias("blockers"))


@query(
    f"""WITH {_RECORD} SELECT p_partkey, array_to_string(list_filter([CASE WHEN power_bhp NOT BETWEEN 20 AND 800 THEN 'power_bhp=' || power_bhp || ' outside range 20-800' END], lambda x: x IS NOT NULL), '; ') AS power,
  array_to_string(list_filter([CASE WHEN mileage_arai_kmpl NOT BETWEEN 3 AND 45 THEN 'mileage_arai_kmpl=' || mileage_arai_kmpl || ' outside range 3-45' END, CASE WHEN mileage_arai_kmpl IS NULL THEN NULL WHEN p_partkey % 4 = 2 THEN 'mileage_arai_kmpl should be null for EV' WHEN p_partkey % 4 = 1 THEN 'CNG mileage must not be stored as km/l' END], lambda x: x IS NOT NULL), '; ') AS mileage FROM r"""
)
def value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.array_join(rules.errors(F.lit(c), F.col("fuel_type"), F.col(c)), "; ")
    return _records(spark, sf_dir).select("p_partkey", said("power_bhp").alias("power"), said("mileage_arai_kmpl").alias("mileage"))


@query(f"WITH {_RECORD} SELECT p_partkey, round(100.0 * (CASE WHEN model IS NULL THEN 0 ELSE 1 END + CASE WHEN mileage_arai_kmpl IS NULL THEN 0 ELSE 1 END + CASE WHEN engine_cc IS NULL THEN 0 ELSE 1 END + 2) / 6, 2)::DOUBLE AS pct FROM r")
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return rows.select("p_partkey", records.filled_share(rows, ["make", "model", "mileage_arai_kmpl", "engine_cc", "abs", "kerb_weight_kg"]).alias("pct"))


_DECISION = "q AS (SELECT l_partkey AS p_partkey, arg_max(CASE WHEN l_partkey % 2 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 'accept_with_nullable_fields' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'reject' ELSE 'accept_after_review' END END, l_orderkey * 10 + l_linenumber) AS decision FROM lineitem GROUP BY 1)"
_ROUTED = f"{_RECORD}, {_ISSUES}, {_DECISION}, o AS (SELECT t.p_partkey, decision, CASE WHEN decision = 'accept_with_nullable_fields' THEN 'nullable_usable' WHEN decision IN ('quarantine', 'reject') THEN 'excluded' WHEN status = 'recommendation_ready' THEN 'recommendation_ready' ELSE 'excluded' END AS subset FROM t LEFT JOIN q USING (p_partkey))"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    decision = F.array(*map(F.lit, ["accept_with_nullable_fields", "quarantine", "reject", "accept_after_review"]))[n % 4]
    said = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_partkey") % 2 == 0, decision).alias("decision"), (F.col("l_orderkey") * 10 + n).alias("seq"))
    rows = _records(spark, sf_dir)
    return records.routed(rows, rules.readiness(rows)[0], said, "p_partkey")


@query(f"WITH {_ROUTED} SELECT * FROM o")
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("p_partkey", "decision", "subset")


@query(
    f"""WITH {_ROUTED}, n AS (SELECT 'duplicate canonical identities' AS failure, count(*) AS n FROM (SELECT 1 FROM r GROUP BY make, model, variant, fuel_type, transmission HAVING count(*) > 1)
UNION ALL SELECT 'missing required fields', count(*) FROM r WHERE model IS NULL UNION ALL SELECT 'implausible values', count(*) FROM s WHERE len(issues) > 0
UNION ALL SELECT 'excluded record in ready output', count(*) FROM (SELECT p_partkey FROM o WHERE subset = 'recommendation_ready' INTERSECT SELECT p_partkey FROM o WHERE subset = 'excluded')) SELECT * FROM n WHERE n > 0"""
)
def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir)
    ids = lambda s: rows.where(F.col("subset") == s).select("p_partkey")
    twice = rows.groupBy("make", "model", "variant", "fuel_type", "transmission").agg(F.count("*").alias("n")).where("n > 1")
    return records.violations({"duplicate canonical identities": twice, "missing required fields": rows.where("model is null"), "implausible values": rows.where(F.size(rules.record_issues(rows)) > 0), "excluded record in ready output": ids("recommendation_ready").intersect(ids("excluded"))})


@query(f"WITH {_RECORD} SELECT r.p_partkey, CASE WHEN engine_cc IS NULL THEN 'applied' ELSE 'agreement' END AS status FROM r JOIN (SELECT l_partkey, min(l_orderkey) AS k FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey WHERE k % 3 = 0 AND (engine_cc IS NULL OR k % 2 = 0)")
def accept_after_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed values for records whose whole identity agrees: written where null, kept where they agree."""
    named = ["make", "model", "variant", "fuel_type", "transmission", "price_ex_showroom"]
    firsts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("k"))
    said = _records(spark, sf_dir).select("p_partkey", *named).join(firsts, "p_partkey").withColumn("make", F.when(F.col("k") % 3 == 0, F.col("make")).otherwise("other")).withColumn("new", F.when(F.col("k") % 2 == 0, 1200.0).otherwise(1300.0))
    rows = records.with_decisions(_records(spark, sf_dir), said.drop("k"), "p_partkey", named)
    rows = rows.where(F.col("engine_cc").isNull() | text.values_agree(F.col("engine_cc").cast("string"), F.col("new").cast("string")))
    return rows.select("p_partkey", F.when(F.col("engine_cc").isNull(), "applied").otherwise("agreement").alias("status"))


@query("SELECT 'both' AS kind, p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'only part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return part.join(seen, "p_partkey", "left_semi").select(F.lit("both").alias("kind"), "p_partkey").union(part.join(seen, "p_partkey", "left_anti").select(F.lit("only part"), "p_partkey"))


@query("SELECT field, CAST(sum(c) AS BIGINT) AS n, max(c) AS most_common, sum(c) >= 10 AND max(c) / sum(c) >= 0.95 AND field <> 'currency' AS suspicious FROM (SELECT 'status' AS field, o_orderstatus AS v, count(*) AS c FROM orders GROUP BY 2 UNION ALL SELECT 'fixed', 'x', count(*) FROM orders UNION ALL SELECT 'currency', 'x', count(*) FROM orders) GROUP BY 1")
def mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit("x").alias("fixed"), F.lit("x").alias("currency"))
    return rules.repeated_value(records.cells(rows, "o_orderkey", ["status", "fixed", "currency"]))


@query("SELECT p_brand, array_to_string(list_transform(list_sort(list((p_partkey, p_name)))[1:5], lambda x: x[2]), ',') AS examples FROM part GROUP BY 1")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.examples(table(spark, sf_dir, "part"), ["p_brand"], "p_name", [F.col("p_partkey")])
    return out.select("p_brand", F.array_join("examples", ",").alias("examples"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, min(p_partkey) LIMIT 10")
def most_common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ties to the value seen first."""
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(10).select("p_name", "n")


@query("SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT 'sources' AS what, count(DISTINCT source) AS n, count(DISTINCT source) = 1 AS constant FROM documents UNION ALL SELECT 'languages', count(DISTINCT lang), count(DISTINCT lang) = 1 FROM documents")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold one value, null included."""
    docs = table(spark, sf_dir, "documents")
    kinds = lambda c: F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))
    one = lambda c, n: docs.agg(kinds(c).alias("n")).select(F.lit(n).alias("what"), "n", (F.col("n") == 1).alias("constant"))
    return one("source", "sources").union(one("lang", "languages"))


@query("SELECT count(*) * 2 AS total, CAST(sum(CASE WHEN (doc_id % 3 = 0)::INT = toxic THEN 1 ELSE 0 END + CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(sum(CASE WHEN (doc_id % 3 = 0)::INT = toxic THEN 1 ELSE 0 END + CASE WHEN quality = 1 THEN 1 ELSE 0 END) / (count(*) * 2), 6) AS accuracy FROM labels")
def parser_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled against guessed entries."""
    want = F.create_map(F.lit("toxic"), F.col("toxic"), F.lit("quality"), F.col("quality"))
    got = F.create_map(F.lit("toxic"), (F.col("doc_id") % 3 == 0).cast("int"), F.lit("quality"), F.lit(1))
    return records.accuracy(table(spark, sf_dir, "labels").select(want.alias("want"), got.alias("got")), "want", "got")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS heading, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, url LIKE 'https://example.com/%' AS allowed, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)?', 1), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || substr(sha256(url), 1, 12) || '.html' AS cache_key FROM pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, h = F.col("url"), F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pages.heading(h).alias("heading"), pages.title(h).alias("title"), text.url_allowed(u, "example.com").alias("allowed"), text.cache_key(u).alias("cache_key"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS power, CASE WHEN p_partkey % 3 < 2 THEN 'yes {' || p_name || '}' END AS sunroof, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 1000 AS VARCHAR) END AS price FROM part"""
)
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels looked up in the tree of a page's embedded state, and the price of its linked data."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    tree = said('{"specsFeaturesMaster":[{"name":"Engine","subCategories":[{"name":"Power","items":[{"itemName":"Max Power!","value":"', n, '"},{"itemName":"Torque","value":""}]}]}],"versionDetail":{"featureSpecs":[{"itemName":"Electric  Sun-Roof","value":"","renderedTemplates":{"a":"yes {', F.col("p_name"), '}"}}]}}')
    state = F.when(k % 3 == 0, said("<script>window.__INITIAL_STATE__ = ", tree, "; var x = {}</script>")).when(k % 3 == 1, said('<script>var a = "}"; window.__INITIAL_STATE__=', tree, "</script>")).otherwise("<script>window.__INITIAL_STATE__ = {broken</script>")
    offer = F.when(k % 2 == 0, said('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"name":"x"},{"offers":{"price":"', (F.col("p_size") * 1000).cast("string"), '"}}]}</script>')).otherwise("")
    rows = pages.with_state(table(spark, sf_dir, "part").select("p_partkey", F.concat(state, offer).alias("html")))
    aliases = spark.createDataFrame([("power", 0, "Maximum Power"), ("power", 1, "max power"), ("sunroof", 0, "sun roof")], "field string, at int, label string")
    looked = pages.looked_up(pages.items(rows, "p_partkey", "state"), "p_partkey", aliases)
    made = pages.assembled(looked, "p_partkey", {"power": F.col("value"), "sunroof": F.col("value")})
    return rows.select("p_partkey", pages.offer(pages.linked_data(F.col("html")))["price"].alias("price")).join(made, "p_partkey", "left")


_TITLES = ["2019 Maruti Swift VXI", "Hyundai Creta AMT", "Honda City manual", "Tata car diesel", "Toyota Innova automatic", "Unknown thing 2020"]


@query(
    """WITH l AS (SELECT p_partkey, p_partkey % 50 AS req, p_partkey % 6 AS t, CASE WHEN p_partkey % 4 = 0 THEN 'petrol' ELSE '' END AS fuel FROM part),
k AS (SELECT *, CASE WHEN (req % 3 = 1 AND t IN (1, 4)) OR (req % 2 = 0 AND t = 3) THEN 3 WHEN t = 1 THEN 1 WHEN t IN (3, 5) THEN 2 ELSE 3 END AS tier FROM l),
b AS (SELECT *, min(tier) OVER (PARTITION BY req) AS best FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY tier, p_partkey) AS rk FROM b WHERE tier < 3 OR best = 3)
SELECT req, p_partkey, tier, CAST(rk AS INTEGER) AS rk, ['2019', NULL, NULL, NULL, NULL, '2020'][t + 1] AS year, CASE p_partkey % 3 WHEN 0 THEN 'https://x/b.jpg' WHEN 1 THEN 'http://x/c.jpg' ELSE '/static/pic.avif' END AS image FROM r WHERE rk <= 10"""
)
def listing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by how they fit requests for an SUV (some manual, some petrol), with year and image."""
    k = F.col("p_partkey")
    title = F.array(*map(F.lit, _TITLES))[(k % 6).cast("int")]
    srcset = F.when(k % 3 == 0, "https://x/a.jpg 1x, https://x/b.jpg 2x, data:image/png;base64,xx 3x")
    raw = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), F.when(k % 4 == 0, "petrol").alias("fuel"), listings.image(srcset, F.lit("https://x/placeholder.png"), F.when(k % 3 == 1, "http://x/c.jpg")).alias("image"))
    rows = raw.select("p_partkey", (k % 50).alias("req"), "title", F.coalesce("fuel", F.lit("")).alias("fuel"), F.lit("").alias("transmission"), F.lit("").alias("location"), "image")
    req = F.col("req")
    out = listings.relevant(rows, "req", "p_partkey", F.array().cast("array<string>"), F.lit("suv"), F.when(req % 3 == 1, "manual"), F.when(req % 2 == 0, "petrol"))
    return out.select("req", "p_partkey", "tier", "rk", listings.year(F.col("title")).alias("year"), "image")


@query(
    f"""WITH {_ROWS}, bad AS (SELECT *, value IS NOT NULL AND value <> '' AND ((field = 'power_bhp' AND TRY_CAST(value AS DOUBLE) NOT BETWEEN 20 AND 800) OR (field = 'engine_cc' AND (TRY_CAST(value AS DOUBLE) NOT BETWEEN 600 AND 6000 OR fuel = 'electric')) OR (field = 'battery_capacity_kwh' AND (TRY_CAST(value AS DOUBLE) NOT BETWEEN 5 AND 250 OR fuel <> 'electric'))) AS wrong FROM (SELECT *, coalesce(value <> '', FALSE) AS ok FROM why) w)
SELECT field, count(*) FILTER (reason IS DISTINCT FROM 'NOT_APPLICABLE') AS applicable, count(*) FILTER (ok) AS populated, count(*) FILTER (NOT ok AND reason IS DISTINCT FROM 'NOT_APPLICABLE') AS missing, count(*) FILTER (reason = 'NOT_APPLICABLE') AS not_applicable, count(DISTINCT CASE WHEN ok THEN value END) AS "distinct",
  count(*) FILTER (wrong) AS invalid, round(100.0 * count(*) FILTER (ok) / count(*) FILTER (reason IS DISTINCT FROM 'NOT_APPLICABLE'), 2)::DOUBLE AS pct FROM bad GROUP BY 1"""
)
def field_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicable, filled, missing, distinct and invalid cells of each field."""
    return build.audit(*_record_cells(spark, sf_dir))


@query(f"WITH {_ROWS}, p AS (SELECT model, field, avg(CASE WHEN coalesce(value <> '', FALSE) THEN 100.0 ELSE 0.0 END) AS c FROM cells GROUP BY 1, 2) SELECT model, round(avg(c), 6) AS mean_coverage FROM p GROUP BY 1")
def model_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.model_means(_record_cells(spark, sf_dir)[0], "model")


@query(f"WITH {_ROWS} SELECT CASE field WHEN 'make' THEN 'Official site' WHEN 'engine_cc' THEN 'Official brochure' ELSE 'Portal' END AS source, count(*) AS n FROM kept WHERE NOT ok AND field <> 'reliability_score' GROUP BY 1")
def pilot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.pilot(rules.missing_queue(*_record_cells(spark, sf_dir)), ["CORE_REQUIRED", "HIGH_VALUE", "SPECIALIST"])


@query(f"WITH {_ROWS} SELECT c_custkey, field, 'SOURCE_UNAVAILABLE' AS null_reason FROM cells WHERE coalesce(value, '') = '' AND NOT (field = 'make' AND c_custkey % 2 = 0) AND NOT (fuel = 'electric' AND field = 'engine_cc' AND value IS NULL) AND NOT (fuel <> 'electric' AND field = 'battery_capacity_kwh' AND value IS NULL)")
def missing_source_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that were empty before a merge (which fills the make of every other record) and still are."""
    cells, _ = _record_cells(spark, sf_dir)
    after = cells.withColumn("value", F.when((F.col("field") == "make") & (F.col("c_custkey") % 2 == 0), "filled").otherwise(F.col("value")))
    return build.still_missing(cells, after, "c_custkey").select("c_custkey", "field", "null_reason")


@query(
    """WITH i AS (SELECT p_partkey, 'Make ' || p_partkey % 2 AS make, ['Manual', '5-Speed MT', 'Automatic (AMT)', 'AMT', 'CVT', 'Torque Converter'][p_partkey % 6 + 1] AS gear, p_partkey % 3 AS cc FROM part)
SELECT p_partkey, 'length_mm' AS field, CASE WHEN make = 'Make 0' THEN '4000' ELSE '4200' END AS value, 'MODEL_LEVEL' AS scope, 'OEM' AS source FROM i
UNION ALL SELECT p_partkey, 'cylinders', CASE WHEN cc = 1 THEN '3' ELSE '4' END, 'POWERTRAIN_LEVEL', 'OEM powertrain' FROM i WHERE make = 'Make 0' OR cc = 1
UNION ALL SELECT p_partkey, 'gearbox_speeds', CASE WHEN gear LIKE '%5-Speed%' THEN '5' WHEN gear LIKE '%AMT%' THEN '6' END, 'POWERTRAIN_LEVEL', 'gearbox' FROM i WHERE gear LIKE '%5-Speed%' OR gear LIKE '%AMT%'"""
)
def spec_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of model, powertrain (first fitting rule, nulls fit all) and gearbox tables."""
    rows = _identities(spark, sf_dir).select("p_partkey", "ours.*")
    models = spark.createDataFrame([("Make 0", "Model-X", "length_mm", "4000"), ("Make 1", "Model-X", "length_mm", "4200")], "make string, model string, field string, value string")
    trains = spark.createDataFrame([(0, "Make 0", "Model-X", None, 1, None, "cylinders", "3"), (1, "Make 0", "Model-X", "Petrol", None, None, "cylinders", "4"), (2, "Make 1", "Model-X", None, 1, None, "cylinders", "3"), (3, "Make 0", "Model-X", "Diesel", None, None, "cylinders", "9")], "priority int, make string, model string, fuel_type string, engine_cc int, transmission string, field string, value string")
    sources = {"OEM": build.model_candidates(rows, models, "p_partkey"), "OEM powertrain": build.powertrain_candidates(rows, trains, "p_partkey"), "gearbox": build.gearbox_candidates(rows, [("5-Speed", 5), ("AMT", 6)], "p_partkey")}
    return build.of_all(sources)


_SHARED = """d AS (SELECT l_partkey AS rid, l_linenumber AS field, l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS seq, l_returnflag AS unit, CAST(NULL AS BOOLEAN) AS value_bool, floor(l_quantity / 10) AS value_num, CAST(NULL AS VARCHAR) AS scope, 1 - l_discount AS confidence, l_suppkey % 3 AS source,
  l_quantity > 48 AS bad, l_suppkey % 5 = 0 AS blocked, CASE WHEN l_partkey % 7 = 0 THEN '2' END AS existing, CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS VARCHAR) AS value FROM lineitem)"""


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = F.floor(F.col("l_quantity") / 10)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("rid"), F.col("l_linenumber").alias("field"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("unit"), F.lit(None).cast("boolean").alias("value_bool"), ten.cast("double").alias("value_num"), F.lit(None).cast("string").alias("scope"), (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_suppkey") % 3).cast("string").alias("source"), F.array_compact(F.array(F.when(F.col("l_quantity") > 48, "too large"))).alias("errors"), (F.col("l_suppkey") % 5 == 0).alias("blocked"), F.when(F.col("l_partkey") % 7 == 0, "2").alias("existing"), ten.cast("string").alias("value"), F.lit(False).alias("needs_bool"),
    )


_MERGED = f"""{_SHARED}, v AS (SELECT * FROM d WHERE NOT bad AND NOT blocked),
x AS (SELECT DISTINCT a.rid, a.field FROM v a JOIN v b ON a.rid = b.rid AND a.field = b.field AND a.seq < b.seq WHERE a.unit <> b.unit OR abs(a.value_num - b.value_num) > 0.02 * greatest(a.value_num, b.value_num, 1.0)),
w AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.rid, v.field ORDER BY confidence DESC, source, seq) AS n FROM v LEFT JOIN x ON v.rid = x.rid AND v.field = x.field WHERE x.rid IS NULL) WHERE n = 1)"""


@query(
    f"""WITH {_MERGED} SELECT rid, field, 'accepted' AS outcome, value FROM w WHERE existing IS NULL UNION ALL SELECT rid, field, 'candidate validation failed', NULL FROM d WHERE bad OR blocked
UNION ALL SELECT rid, field, 'unresolved candidate conflict', NULL FROM x UNION ALL SELECT rid, field, 'existing value conflict', NULL FROM w WHERE existing IS NOT NULL AND existing <> value"""
)
def shared_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, review = build.shared_merge(_shared(spark, sf_dir), ["rid", "field"], "seq")
    return accepted.select("rid", "field", F.lit("accepted").alias("outcome"), "value").union(review.select("rid", "field", "reason", F.lit(None).cast("string")))


@query(
    f"""WITH {_MERGED}, e AS (SELECT d.*, row_number() OVER (PARTITION BY d.rid, d.field, d.source, d.value ORDER BY d.seq) AS k, w.value AS merged, w.rid IS NOT NULL AND w.existing IS NULL AS wrote FROM d LEFT JOIN w ON d.rid = w.rid AND d.field = w.field),
y AS (SELECT DISTINCT a.rid, a.field FROM d a JOIN d b ON a.rid = b.rid AND a.field = b.field AND a.seq < b.seq WHERE a.unit <> b.unit OR abs(a.value_num - b.value_num) > 0.02 * greatest(a.value_num, b.value_num, 1.0)),
s AS (SELECT e.rid, e.field, CASE WHEN k > 1 THEN 'DUPLICATE_CANDIDATE' WHEN y.rid IS NOT NULL THEN 'CONFLICT_UNRESOLVED' WHEN bad THEN 'REJECTED_VALIDATION' WHEN blocked THEN 'REJECTED_INHERITANCE_POLICY' WHEN confidence < 0.92 THEN 'REJECTED_LOW_CONFIDENCE' WHEN existing IS NOT NULL THEN 'EXISTING_VALUE_PRESERVED'
  WHEN wrote AND merged = value THEN 'ACCEPTED' WHEN bool_or(wrote AND merged = value) OVER (PARTITION BY e.rid, e.field) THEN 'SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE' ELSE 'REJECTED_SCOPE_MISMATCH' END AS terminal_status FROM e LEFT JOIN y ON e.rid = y.rid AND e.field = y.field)
SELECT terminal_status, count(*) AS n FROM s GROUP BY 1"""
)
def shared_disposition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's status after the merge, counted."""
    rows = _shared(spark, sf_dir)
    accepted, _ = build.shared_merge(rows, ["rid", "field"], "seq")
    rows = rows.join(accepted.select("rid", "field", F.col("value").alias("merged"), F.lit(True).alias("written")), ["rid", "field"], "left")
    out = build.shared_dispositions(rows, ["rid", "field"], ["rid", "field", "source", "value"], "seq", 0.92)
    return out.groupBy("terminal_status").agg(F.count("*").alias("n"))


@query("SELECT 'source ' || l_suppkey % 4 AS source, p_brand AS model, count(DISTINCT l_partkey) AS matched, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand) - count(DISTINCT l_partkey) AS unmatched, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS fields, coalesce(bool_or(CASE WHEN l_linenumber % 4 = 0 THEN l_quantity <= 25 END), FALSE) AS negatives FROM lineitem JOIN part p ON l_partkey = p_partkey GROUP BY 1, 2")
def acquisition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source offers for each model."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("field"), F.concat(F.lit("source "), (F.col("l_suppkey") % 4).cast("string")).alias("source"), F.when(F.col("l_linenumber") % 4 == 0, F.col("l_quantity") > 25).alias("value_bool"))
    out = build.manifest(found, table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("model")), "p_partkey")
    return out.select("source", "model", "matched", "unmatched", F.array_join("fields", ",").alias("fields"), "negatives")


@query("WITH l AS (SELECT l_partkey, min(l_orderkey) AS k FROM lineitem GROUP BY 1) SELECT p_partkey, CASE WHEN k % 3 = 0 THEN 1500 WHEN p_partkey % 3 = 0 THEN 1200 END AS engine_cc, coalesce(k % 3 = 0, FALSE) AS applied FROM part LEFT JOIN l ON l_partkey = p_partkey")
def engine_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed displacement replaces the value where the identity agrees."""
    named = ["make", "model", "variant", "fuel_type", "transmission", "price_ex_showroom"]
    firsts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("k"))
    said = _records(spark, sf_dir).select("p_partkey", *named).join(firsts, "p_partkey").withColumn("make", F.when(F.col("k") % 3 == 0, F.col("make")).otherwise("other")).withColumn("new", F.lit(1500))
    return build.overwritten(_records(spark, sf_dir), said, "p_partkey", "engine_cc", named).select("p_partkey", "engine_cc", "applied")


@query("SELECT p_partkey, coalesce(s, '') AS conflicts FROM part LEFT JOIN (SELECT l_partkey, string_agg(l_linenumber || ':' || CAST(l_quantity AS INTEGER), ',' ORDER BY l_orderkey * 10 + l_linenumber, l_linenumber, l_quantity) AS s FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey")
def conflict_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what two sources say, in order."""
    found = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_linenumber").alias("field"), F.col("l_quantity").cast("int").alias("ours"), F.lit(0).alias("theirs"), F.lit("").alias("rationale"))
    out = build.with_conflicts(table(spark, sf_dir, "part").select("p_partkey"), found, "p_partkey")
    said = F.transform(F.coalesce("conflict_metadata", F.expr("cast(array() as array<struct<seq:bigint,field:int,status:string,ours:int,theirs:int,rationale:string>>)")), lambda x: F.concat_ws(":", x["field"].cast("string"), x["ours"].cast("string")))
    return out.select("p_partkey", F.array_join(said, ",").alias("conflicts"))


@query("SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN arg_max(l_quantity, l_orderkey * 10000000 + l_suppkey * 10 + l_linenumber) END AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def decisions_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part beside its last line item, or none."""
    seq = F.col("l_orderkey") * 10000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), seq.alias("seq"), "l_quantity")
    out = build.with_evidence(table(spark, sf_dir, "part").select("p_partkey"), seen, "p_partkey", "seq")
    return out.select("p_partkey", F.col("evidence.l_quantity").alias("quantity"))


@query(None)
def intent_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained labels of requests that orders make: (target, total, correct) over the whole table.

    The models are fitted on generated texts; an order's request uses the same words in another
    order, with words that no template has.
    """
    models = model.trained_all(model.generated(spark))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda on, words: F.array(*map(F.lit, [*words, "unknown"]))[(on % (len(words) + 1)).cast("int")]
    labels = {"body_type": pick(c, model.VALUES["body"]), "fuel_type": pick(k, model.VALUES["fuel"]), "transmission": pick(c + k, model.VALUES["gear"]), "use_case": pick(F.floor(c / 5), model.VALUES["use"])}
    rows = table(spark, sf_dir, "orders").select(*(v.alias(n) for n, v in labels.items()))
    word = lambda n: F.when(F.col(n) != "unknown", F.col(n))
    requests = rows.withColumn("query", F.concat_ws(" ", F.lit("please find"), word("transmission"), word("body_type"), word("fuel_type"), F.lit("for"), word("use_case")))
    got = model.predicted_all(models, requests)
    each = F.array(*(F.struct(F.lit(t).alias("target"), (F.col(f"guess_{t}") == F.col(t)).cast("bigint").alias("ok")) for t in model.TARGETS))
    return got.select(F.explode(each).alias("e")).groupBy("e.target").agg(F.count("*").alias("total"), F.sum("e.ok").alias("correct"))
