"""Rules about fields of a record: applicability, ranges, readiness, inheritance, variant matches.

``cell`` tables have one row for each (record, field): field, fuel and value columns; the
field policy is a small table (field, category, importance, scope, fuels, source, fallback,
inheritable, scopes, difficulty), a row for each field, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import text as T
from veldspar.session import written

# Fixed values: (field, least, most).
RANGES = [
    ("price_ex_showroom", 100000, 10000000),
    ("engine_cc", 600, 6000),
    ("power_bhp", 20, 800),
    ("torque_nm", 40, 1500),
    ("airbags", 0, 12),
    ("mileage_arai_kmpl", 3, 45),
    ("mileage_arai_km_per_kg", 5, 45),
    ("claimed_ev_range_km", 50, 1000),
    ("battery_capacity_kwh", 5, 250),
    ("seating_capacity", 2, 9),
    ("boot_space_litres", 0, 1000),
    ("ground_clearance_mm", 100, 300),
    ("fuel_tank_capacity_litres", 15, 120),
    ("length_mm", 2500, 6000),
    ("width_mm", 1200, 2500),
    ("height_mm", 1000, 2500),
    ("wheelbase_mm", 1500, 3500),
    ("kerb_weight_kg", 500, 3500),
    ("turning_radius_metres", 3, 8),
]
# Fields whose ranges are looked at in whole records.
RECORD_RANGES = ["price_ex_showroom", "seating_capacity", "airbags", "mileage_arai_kmpl", "mileage_arai_km_per_kg", "power_bhp", "torque_nm", "engine_cc"]
# Fields that only some fuels have.
NOT_ELECTRIC = ["engine_cc", "cylinders", "fuel_tank_capacity_litres", "mileage_arai_kmpl", "mileage_arai_km_per_kg"]
ONLY_ELECTRIC = ["battery_capacity_kwh", "claimed_ev_range_km", "charging_time_ac_hours", "charging_time_dc_minutes"]
SUBJECTIVE = ["reliability_score", "resale_value_score", "service_network_score"]
# Fields that a record needs to be recommended, the core first.
CORE = ["make", "model", "variant", "price_ex_showroom", "fuel_type", "transmission"]
REQUIRED = [*CORE, "body_type", "seating_capacity", "power_bhp", "torque_nm", "fuel_specific_efficiency", "airbags", "abs"]
# Reasons of empty fields.
NULL_REASONS = ["NOT_APPLICABLE", "NOT_YET_ENRICHED", "SOURCE_UNAVAILABLE", "FIELD_NOT_PUBLISHED", "UNRESOLVED_CONFLICT", "LOW_CONFIDENCE_MATCH", "UNSAFE_TO_INHERIT", "EXTRACTION_FAILED", "SUBJECTIVE_REQUIRES_DERIVATION", "DEFERRED_FIELD"]
# Weights of field categories.
WEIGHTS = {"CORE_REQUIRED": 5, "HIGH_VALUE": 3, "SPECIALIST": 2, "OPTIONAL": 1, "SUBJECTIVE_OR_DERIVED": 0, "DEFER_OR_REMOVE": 0}


def _fuel(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def filled(c: Column) -> Column:
    """Neither null nor empty; false and 0 count."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def range_error(field: Column, value: Column) -> Column:
    """The text of a value out of its field's range or no number; null where all is well."""
    n, out = value.try_cast("double"), F.lit(None).cast("string")
    for name, low, high in RANGES:
        said = F.when(n.isNull(), f"{name} is not numeric").when(~n.between(low, high), F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(f" outside range {low}-{high}")))
        out = F.when(field == name, said).otherwise(out)
    return F.when(filled(value), out)


def fuel_error(field: Column, fuel: Column, value: Column) -> Column:
    """The first rule that a filled field breaks by the record's fuel."""
    f = _fuel(fuel)
    out = F.when((f == "electric") & field.isin(*NOT_ELECTRIC, "turbocharged"), F.concat(field, F.lit(" should be null for EV")))
    out = out.when((f != "electric") & field.isin(ONLY_ELECTRIC), F.concat(field, F.lit(" applies only to EV records")))
    out = out.when((f == "cng") & (field == "mileage_arai_kmpl"), "CNG mileage must not be stored as km/l")
    out = out.when((f != "cng") & (field == "mileage_arai_km_per_kg"), "km/kg mileage applies only to CNG")
    return F.when(filled(value), out)


def errors(field: Column, fuel: Column, value: Column) -> Column:
    """All errors of a value: range first, then fuel."""
    return F.array_compact(F.array(range_error(field, value), fuel_error(field, fuel, value)))


def null_reason(field: Column, fuel: Column, value: Column, fuels: Column | None = None) -> Column:
    """Why a field is empty; null for a filled one.  ``fuels``: those that the policy allows, null for all."""
    f = _fuel(fuel)
    out = F.when(value.isNotNull(), None)
    if fuels is not None:
        kinds = F.transform(fuels, F.lower)
        limited = fuels.isNotNull() & (F.size(fuels) > 0) & ~F.array_contains(kinds, "all")
        out = out.when(F.coalesce(limited & (f != "") & ~F.array_contains(kinds, f), F.lit(False)), "NOT_APPLICABLE")
    out = out.when(field.isin(SUBJECTIVE), "SUBJECTIVE_REQUIRES_DERIVATION").when((f == "electric") & field.isin(NOT_ELECTRIC), "NOT_APPLICABLE")
    return out.when((f != "electric") & field.isin(ONLY_ELECTRIC), "NOT_APPLICABLE").otherwise("NOT_YET_ENRICHED")


def applicable(field: Column, fuel: Column, value: Column, fuels: Column | None = None) -> Column:
    return F.coalesce(null_reason(field, fuel, value, fuels) != "NOT_APPLICABLE", F.lit(True))


def null_envelope(reason: Column, notes: Column) -> Column:
    """(value, null_reason, notes) of an empty field; a reason outside the vocabulary is an error."""
    known = F.when(reason.isin(NULL_REASONS), reason).otherwise(F.raise_error(F.concat(F.lit("Unsupported null reason: "), F.coalesce(reason, F.lit("null")))).cast("string"))
    return F.struct(F.lit(None).cast("string").alias("value"), known.alias("null_reason"), notes.alias("notes"))


def record_issues(records: DataFrame) -> Column:
    """Sorted distinct fields of a record that are out of range or contradict its fuel; columns that are missing have no issue."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("double")
    f, out = _fuel(F.col("fuel_type")), []
    for name, low, high in RANGES:
        if name in RECORD_RANGES:
            n = T.finite(has(name).try_cast("double"))
            out.append(F.when(~n.between(low, high), name))
    out.append(F.when((f == "electric") & has("engine_cc").isNotNull(), "engine_cc"))
    out.append(F.when((f == "electric") & (has("mileage_arai_kmpl").isNotNull() | has("mileage_arai_km_per_kg").isNotNull()), "mileage"))
    out.append(F.when((f == "cng") & has("mileage_arai_kmpl").isNotNull(), "mileage_arai_kmpl"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))


def readiness(records: DataFrame) -> tuple[Column, Column]:
    """(status, blockers) of a record: ready, blocked without a core field, else partly ready."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    efficiency = T.effective_efficiency(F.col("fuel_type"), has("mileage_arai_kmpl"), has("mileage_arai_km_per_kg"), has("claimed_ev_range_km"))
    value = lambda c: efficiency if c == "fuel_specific_efficiency" else has(c)
    missing = F.array_compact(F.array(*(F.when(~filled(value(c)), c) for c in REQUIRED)))
    issues = record_issues(records)
    status = F.when((F.size(missing) == 0) & (F.size(issues) == 0), "recommendation_ready").when(F.arrays_overlap(missing, F.array(*map(F.lit, CORE))), "blocked").otherwise("partially_ready")
    return status, F.concat(missing, issues)


def tier(score: Column, lacks_core: Column) -> Column:
    return F.when(lacks_core, "BASIC_READY").when(score >= 90, "SPECIALIST_READY").when(score >= 78, "STRONG_RECOMMENDATION_READY").when(score >= 60, "PARTIALLY_ENRICHED").otherwise("BASIC_READY")


def completeness(cells: DataFrame, policy: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """(key, score, weighted_total, weighted_populated, tier) of each record.

    Cells that do not apply are left out; a cell weighs as its category does, or ``weight`` (of
    the policy's columns); a record without weight scores 100.
    """
    w = F.coalesce(*(F.when(F.col("category") == c, v) for c, v in WEIGHTS.items()), F.lit(0)) if weight is None else weight
    rows = cells.join(F.broadcast(policy), "field").where(applicable(F.col("field"), F.col("fuel"), F.col("value"), F.col("fuels")))  # a row for each field
    rows = rows.withColumn("__w", w).withColumn("__ok", filled(F.col("value")))
    per = rows.groupBy(key).agg(F.sum("__w").cast("bigint").alias("weighted_total"), F.sum(F.when(F.col("__ok"), F.col("__w")).otherwise(0)).cast("bigint").alias("weighted_populated"), F.max(F.coalesce((F.col("category") == "CORE_REQUIRED") & ~F.col("__ok"), F.lit(False))).alias("__core"))
    score = F.when(F.col("weighted_total") > 0, F.round(100.0 * F.col("weighted_populated") / F.col("weighted_total"), 2)).otherwise(100.0)
    return per.withColumn("score", score).withColumn("tier", tier(F.col("score"), F.col("__core"))).drop("__core")


def missing_queue(cells: DataFrame, policy: DataFrame, **only: str) -> DataFrame:
    """Applicable empty cells with their policy and ``frequency`` (how often the field is
    missing), and the columns that order them (``priority_order``).

    ``only``: model, field, category, or source (preferred or fallback).
    """
    rows = cells.join(F.broadcast(policy), "field").where(~filled(F.col("value")) & applicable(F.col("field"), F.col("fuel"), F.col("value"), F.col("fuels")))
    for name in ("model", "field", "category"):
        if name in only:
            rows = rows.where(F.col(name) == only[name])
    if "source" in only:
        rows = rows.where((F.col("source") == only["source"]) | (F.col("fallback") == only["source"]))
    counts = rows.groupBy("field").agg(F.count("*").alias("frequency"))
    return rows.join(F.broadcast(counts), "field")  # a row for each field


def priority_order() -> list[Column]:
    """Importance, how often missing, official sources, inheritable fields, difficulty, model, variant."""
    hard = F.when(F.col("difficulty") == "low", 0).when(F.col("difficulty") == "high", 2).otherwise(1)
    official = F.when(F.col("source").startswith("Official"), 0).otherwise(1)
    return [F.desc("importance"), F.desc("frequency"), official, F.when(F.col("inheritable"), 0).otherwise(1), hard, F.coalesce("model", F.lit("")), F.coalesce("variant", F.lit(""))]


def inheritance(policy_ok: Column, scope: Column, scopes: Column, same: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(allowed, reason, confidence adjustment) of taking a value over from another record.

    ``same``: whether source and target agree in make, model, fuel_type, engine_cc,
    transmission and variant.
    """
    reason = F.when(~F.coalesce(policy_ok, F.lit(False)), "inheritance not allowed by policy")
    reason = reason.when(~F.coalesce(F.array_contains(scopes, scope), F.lit(False)), F.concat(F.lit("scope "), F.coalesce(scope, F.lit("None")), F.lit(" is not a valid inheritance source")))
    reason = reason.when(~(same["make"] & same["model"]), "make/model mismatch")
    for field in ("fuel_type", "engine_cc", "transmission"):
        reason = reason.when((scope == "POWERTRAIN_LEVEL") & ~same[field], f"powertrain mismatch on {field}")
    reason = reason.when((scope == "TRIM_FAMILY_LEVEL") & ~same["variant"], "trim-level inheritance requires explicit trim-family evidence")
    good = "policy conditions satisfied"
    reason = reason.otherwise(good)
    return reason == good, reason, F.when(reason == good, F.when(scope != "VARIANT_LEVEL", -0.05).otherwise(0.0))


def variant_match(ours: str, theirs: str) -> tuple[Column, Column]:
    """(status, components) of two identities, struct columns with make, model, fuel_type, transmission and variant."""
    a, b = (lambda c: F.col(f"{ours}.{c}")), (lambda c: F.col(f"{theirs}.{c}"))
    same = {f"{n}_match": T.variant_text(a(c)) == T.variant_text(b(c)) for n, c in (("make", "make"), ("model", "model"), ("fuel", "fuel_type"))}
    same["transmission_match"] = T.transmission_family(a("transmission")) == T.transmission_family(b("transmission"))
    same["special_edition_match"] = T.special_editions(a("variant")) == T.special_editions(b("variant"))
    x, y = T.base_tokens(a("variant")), T.base_tokens(b("variant"))
    every = F.lit(True)
    for c in same.values():
        every = every & c
    within = (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    status = F.when(~every, "MISMATCH").when(x == y, "EXACT").when(within, "HIGH_CONFIDENCE").otherwise("AMBIGUOUS")
    return status, F.struct(*(c.alias(n) for n, c in same.items()), (x == y).alias("variant_tokens_match"))


def candidate_errors(inherited: Column, scope: Column, confidence: Column) -> Column:
    """Errors of a candidate's own form."""
    return F.array_compact(F.array(F.when(F.coalesce(inherited, F.lit(False)) & ~filled(scope), "inheritance_scope is required when inheritance_used is true"), F.when(~confidence.between(0, 1), "field_confidence must be between 0 and 1")))


def missing_keys(rows: DataFrame, keys: list[str]) -> list[str]:
    """Keys that a table lacks altogether, in order."""
    return [k for k in keys if k not in rows.columns]


def unresolved_reason(field: Column, fuel: Column) -> Column:
    """The null reason of a cell that no source has filled."""
    f = F.lower(F.coalesce(fuel, F.lit("")))
    out = F.when(field == "kerb_weight_kg", "FIELD_NOT_PUBLISHED").when(field.isin("boot_space_litres", "fuel_tank_capacity_litres") & (f == "cng"), "UNSAFE_TO_INHERIT")
    return out.when((field == "fuel_tank_capacity_litres") & (f == "electric"), "NOT_APPLICABLE").otherwise("SOURCE_UNAVAILABLE")


def repeated_value(cells: DataFrame, share: float = 0.95, least: int = 10) -> DataFrame:
    """(field, n, most_common, suspicious): whether one value makes up nearly all of a field."""
    # Fields in which one value is no sign of an error.
    exempt = ["body_type", "source", "currency"]
    counts = cells.where(filled(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("c"))
    per = counts.groupBy("field").agg(F.sum("c").cast("bigint").alias("n"), F.max("c").cast("bigint").alias("most_common"))
    return per.withColumn("suspicious", (F.col("n") >= least) & (F.col("most_common") / F.col("n") >= share) & ~F.col("field").isin(exempt))


def identified(records: DataFrame, columns: list[str], version: str = "version_id") -> Column:
    """A record's id: its version, or its identity joined by bars."""
    return F.coalesce(F.nullif(F.col(version).cast("string"), F.lit("")), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns)))


def numbered(rows: DataFrame, order: list[Column], prefix: str, width: int = 6) -> DataFrame:
    """``candidate_id``: a prefix and the row's place, padded.

    Places come from a count of each range of the order and the place within it, so no task
    sees all rows.
    """
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that ranges and places are settled before they are counted
    cut = written(cut.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))  # a row for each partition
    place = F.col("__before") + F.col("__at") - F.col("__first") + 1
    out = cut.join(F.broadcast(before.drop("__n")), "__part").withColumn("candidate_id", F.concat(F.lit(prefix), F.lpad(place.cast("string"), width, "0")))
    return out.drop("__part", "__at", "__before", "__first")
