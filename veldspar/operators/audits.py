"""Whole-batch checks and reports: many groupings, checks and metrics from one pass each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from veldspar.operators import records, rules


def coverage_sets(rows: DataFrame, key: str, fields: list[str], by: list[str]) -> DataFrame:
    """(field, column, grp, n, n_populated, pct): coverage of each field by each of several
    columns, from one scan and one shuffle.

    ``grp`` is the column's value, blanks as one group; the groupings are sets over the same
    cells, so a further column costs no further pass.
    """
    held = rows.select(key, *(records.group_key(F.col(c)).alias(f"__g{i}") for i, c in enumerate(by)), *(F.col(f"`{f}`").cast("string").alias(f) for f in fields))
    groups = [f"__g{i}" for i in range(len(by))]
    cells = held.unpivot([key, *groups], fields, "field", "value")
    full = F.sum(F.when(records.populated(F.col("value")), 1).otherwise(0))
    which = [F.when(F.grouping(g) == 0, F.struct(F.lit(c).alias("column"), F.col(g).alias("grp"))) for g, c in zip(groups, by, strict=True)]
    out = cells.groupingSets([["field", g] for g in groups], "field", *groups).agg(F.count("*").alias("n"), full.alias("n_populated"), F.coalesce(*which).alias("__w"))
    return out.select("field", "__w.column", "__w.grp", "n", "n_populated", F.round(100.0 * F.col("n_populated") / F.col("n"), 2).alias("pct"))


def extremes(coverage: DataFrame, most: int = 15, value: str = "pct") -> DataFrame:
    """(end, place, field, pct): the poorest and the best fields of a coverage table (a row a field), ties by name."""
    low = coverage.orderBy(value, "field").limit(most).select(F.lit("poorest").alias("end"), "field", value)
    high = coverage.orderBy(F.desc(value), "field").limit(most).select(F.lit("best").alias("end"), "field", value)
    struct = F.struct("field", value)  # ``most`` of each end
    order = lambda down: F.array_sort(F.collect_list(struct), lambda a, b: F.when(a[value] != b[value], F.when((a[value] < b[value]) != F.lit(down), -1).otherwise(1)).otherwise(F.when(a["field"] < b["field"], -1).otherwise(1)))
    sides = [side.groupBy("end").agg(order(down).alias("x")) for side, down in ((low, False), (high, True))]
    return sides[0].union(sides[1]).select("end", F.posexplode("x").alias("place", "f")).select("end", (F.col("place") + 1).alias("place"), "f.field", f"f.{value}")


def weakest_fields(cells: DataFrame, group: str, most: int = 5) -> DataFrame:
    """(group, mean_coverage, weakest): of each group its mean coverage and its weakest fields, ties by name."""
    per = cells.groupBy(group, "field").agg(F.round(F.avg(F.when(rules.filled(F.col("value")), 100.0).otherwise(0.0)), 6).alias("c"))
    held = F.array_sort(F.collect_list(F.struct("c", "field")))  # a schema's fields
    return per.groupBy(group).agg(F.round(F.avg("c"), 6).alias("mean_coverage"), F.transform(F.slice(held, 1, most), lambda x: x["field"]).alias("weakest"))


# The checks of an output and the failures that they are called; unknown columns are told, but fail nothing.
FAILURES = {
    "duplicate": "duplicate canonical identities", "required": "missing required fields", "numeric": "numeric type errors", "boolean": "boolean type errors",
    "implausible": "implausible values", "protected": "protected field changes", "provenance": "missing resolution provenance", "ready": "excluded record in ready output",
}


def output_violations(outputs: DataFrame, source: DataFrame, key: str, identity: list[str], required: list[str], numeric: list[str], boolean: list[str], protected: list[str], known: list[str], provenance: str | None = None) -> DataFrame:
    """(check, key, field, detail): every violation of the eight checks over a build's outputs.

    ``outputs`` has ``subset`` and, as ``provenance``, a map from fields to structs with
    source_url and raw_value.  A number is wrong if it is a text that is none; a flag if it is
    neither null nor 0 or 1.  Electric records have no displacement and no mileage, others none
    out of range, gas ones no km/l.  Protected fields are compared with ``source`` (null-safe)
    where it has the record.  Per-record checks are one expression over one scan; identities
    and ids are counted.
    """
    kinds = {f.name: f.dataType for f in outputs.schema.fields}
    c = lambda n: F.col(f"`{n}`")
    have = lambda n: c(n) if n in kinds else F.lit(None).cast("string")
    entry = lambda check, field, detail, on: F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(check).alias("check"), (F.lit(field) if isinstance(field, str) else field).alias("field"), detail.cast("string").alias("detail")))
    filled = lambda n: rules.filled(have(n).cast("string"))
    lacks = F.array_compact(F.array(*(F.when(~F.coalesce(filled(n), F.lit(False)), F.lit(n)) for n in required)))
    found = [entry("required", F.array_join(lacks, ","), F.lit(None), F.size(lacks) > 0)]
    found += [entry("numeric", n, c(n), (c(n) != "") & c(n).try_cast("double").isNull()) for n in numeric if isinstance(kinds.get(n), StringType)]
    for n in boolean:
        if n in kinds and not isinstance(kinds[n], BooleanType):
            wrong = ~c(n).isin(0, 1) if isinstance(kinds[n], NumericType) else F.lit(True)
            found.append(entry("boolean", n, c(n), c(n).isNotNull() & wrong))
    fuel, engine = F.lower(F.coalesce(have("fuel_type"), F.lit(""))), have("engine_cc").cast("string").try_cast("double")
    kmpl, kmkg = have("mileage_arai_kmpl"), have("mileage_arai_km_per_kg")
    found.append(entry("implausible", "engine_cc", F.lit("EV has engine_cc"), (fuel == "electric") & have("engine_cc").isNotNull()))
    found.append(entry("implausible", "engine_cc", engine, (fuel != "electric") & ~engine.between(600, 6000)))
    found.append(entry("implausible", "mileage", F.lit("EV mileage contamination"), (fuel == "electric") & (kmpl.isNotNull() | kmkg.isNotNull())))
    found.append(entry("implausible", "mileage_arai_kmpl", F.lit("CNG km/kg in km/l field"), (fuel == "cng") & kmpl.isNotNull()))
    before = source.select(F.col(key), F.struct(*(F.col(f"`{p}`").cast("string").alias(p) for p in protected)).alias("__before")) if protected else None
    rows = outputs.join(before.dropDuplicates([key]), key, "left") if protected else outputs
    found += [entry("protected", p, F.concat_ws(" -> ", F.coalesce(F.col(f"__before.`{p}`"), F.lit("null")), F.coalesce(have(p).cast("string"), F.lit("null"))), F.col("__before").isNotNull() & ~F.col(f"__before.`{p}`").eqNullSafe(have(p).cast("string"))) for p in protected]
    each = F.array_compact(F.array(*found))
    if provenance:
        lost = F.filter(F.map_entries(c(provenance)), lambda e: ~(F.coalesce(e["value"]["source_url"] != "", F.lit(False)) & F.coalesce(e["value"]["raw_value"] != "", F.lit(False))))
        each = F.concat(each, F.coalesce(F.transform(lost, lambda e: F.struct(F.lit("provenance").alias("check"), e["key"].alias("field"), F.lit(None).cast("string").alias("detail"))), F.array().cast("array<struct<check:string,field:string,detail:string>>")))
    told = rows.select(F.col(key).cast("string").alias("key"), F.explode(each).alias("v")).select("v.check", "key", "v.field", "v.detail")
    twice = outputs.groupBy(*identity).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("check"), F.concat_ws("|", *(F.coalesce(F.col(i).cast("string"), F.lit("")) for i in identity)).alias("key"), F.lit(None).cast("string").alias("field"), F.col("n").cast("string").alias("detail"))
    is_ = lambda s: F.bool_or(F.col("subset") == s)
    both = outputs.groupBy(key).agg(is_("recommendation_ready").alias("a"), is_("excluded").alias("b")).where("a and b").select(F.lit("ready").alias("check"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("detail"))
    unknown = [n for n in outputs.columns if n not in known]
    extra = outputs.sparkSession.createDataFrame([("unknown", None, n, None) for n in unknown], "check string, key string, field string, detail string")
    return reduce(DataFrame.unionByName, [told, twice, both, extra])


def rollup_of(violations: DataFrame) -> DataFrame:
    """(failure, n) of the checks that fail; none is a pass."""
    names = F.create_map(*(F.lit(x) for pair in FAILURES.items() for x in pair))
    return violations.where(F.col("check").isin(*FAILURES)).groupBy(F.element_at(names, F.col("check")).alias("failure")).agg(F.count("*").alias("n"))


def union_of_outputs(ready: DataFrame, nullable: DataFrame, excluded: DataFrame) -> DataFrame:
    """All three outputs as one bag with ``subset``; columns that one lacks are null there."""
    named = {"recommendation_ready": ready, "nullable_usable": nullable, "excluded": excluded}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("subset", F.lit(n)) for n, rows in named.items()])


def _teller(block: str) -> Callable[[Column], Column]:
    """Of an entry its parts and the block's name."""
    return lambda e: F.struct(e["field"].alias("field"), e["value"].alias("value"), e["source"].alias("source"), F.lit(block).alias("block"))


def provenance_blocks(rows: DataFrame, blocks: list[str], field: Column) -> Column:
    """All entries about a field in a record's provenance blocks, in the blocks' order, each with its ``block``.

    A block is a map from fields to an entry or to a list of them; an entry has ``field`` and
    ``value``, ``source``.  A list under the field's own name counts whole; single entries
    count under their name and, as the results to match have it, once more by the field that
    they name.  Missing blocks have none.
    """
    kinds = dict(rows.dtypes)
    entry = "struct<field:string,value:string,source:string,block:string>"
    none = F.expr(f"cast(array() as array<{entry}>)")
    parts = []
    for b in blocks:
        told = _teller(b)
        own = F.try_element_at(F.col(b), field)
        if kinds[b].startswith("map<string,array"):
            found = F.transform(own, told)
        else:
            named = F.filter(F.map_values(F.col(b)), lambda e: F.coalesce(e["field"] == field, F.lit(False)))
            found = F.concat(F.when(own.isNotNull(), F.array(told(own))).otherwise(none), F.transform(named, told))
        parts.append(F.coalesce(found, none))
    return F.concat(*parts)


def first_provenance(blocks: list[Column]) -> Column:
    """One map over all fields of several maps of entries: the first block that has a field wins; null maps are empty."""
    empty = F.expr("cast(map() as map<string,struct<field:string,value:string,source:string>>)")
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y)), [F.coalesce(b, empty) for b in blocks], empty)


def inheritance_decision(inherited: Column, policy_ok: Column, scope: Column, scopes: Column, same: dict[str, Column]) -> Column:
    """(allowed, blocked, reason, source_scope, confidence_adjustment): direct assignments are allowed, others by policy."""
    allowed, reason, change = rules.inheritance(policy_ok, scope, scopes, same)
    used = F.coalesce(inherited, F.lit(False))
    ok = ~used | allowed
    return F.struct(ok.alias("allowed"), (~ok).alias("blocked"), F.when(used, reason).otherwise("direct exact-record assignment").alias("reason"), F.when(used & allowed, scope).alias("source_scope"), F.when(used & allowed, change.cast("double")).alias("confidence_adjustment"))


# Cases that a policy must decide: name, field, then make, model, fuel, displacement and transmission of source and target.
POLICY_CASES = [
    ("petrol_to_diesel", "boot_space_litres", ("Tata", "Nexon", "Petrol", 1199, "Manual"), ("Tata", "Nexon", "Diesel", 1497, "Manual")),
    ("petrol_to_cng", "boot_space_litres", ("Tata", "Nexon", "Petrol", 1199, "Manual"), ("Tata", "Nexon", "CNG", 1199, "Manual")),
    ("ice_to_ev", "drivetrain", ("MG", "Windsor EV", "Petrol", 1199, "Manual"), ("MG", "Windsor EV", "Electric", None, "Automatic")),
    ("manual_to_automatic_gearbox", "gearbox_speeds", ("Tata", "Nexon", "Petrol", 1199, "Manual"), ("Tata", "Nexon", "Petrol", 1199, "Automatic (DCT)")),
    ("automatic_gearbox_type_mismatch", "gearbox_speeds", ("Tata", "Nexon", "Petrol", 1199, "Automatic (AMT)"), ("Tata", "Nexon", "Petrol", 1199, "Automatic (DCT)")),
    ("model_dimensions_cross_model", "length_mm", ("Hyundai", "Creta", "Petrol", None, None), ("Tata", "Nexon", "Petrol", None, None)),
]


def policy_cases(spark: SparkSession, policy: DataFrame, cases: list[tuple] = POLICY_CASES) -> DataFrame:
    """(case, field, decision) of each case by ``policy`` (field, allowed, expected_scope, valid_source_scopes); fields without a policy are blocked."""
    side = "struct<make:string,model:string,fuel_type:string,engine_cc:int,transmission:string,variant:string>"
    rows = spark.createDataFrame([(name, f, (*a, None), (*b, None)) for name, f, a, b in cases], f"case string, field string, a {side}, b {side}")
    same = {n: F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in ("make", "model", "fuel_type", "engine_cc", "transmission", "variant")}
    decision = inheritance_decision(F.lit(True), F.col("allowed"), F.col("expected_scope"), F.col("valid_source_scopes"), same)
    return rows.join(policy, "field", "left").select("case", "field", decision.alias("decision"))


def scope_totals(dispositions: DataFrame) -> DataFrame:
    """(terminal_status, scope, n): how many dispositions have each status and scope, each status in
    all, and all (both null), by one ROLLUP; and the sum of all statuses that begin with REJECTED."""
    scope = F.when(~F.coalesce(F.col("inherited"), F.lit(False)), "direct exact-record assignment").otherwise(F.coalesce("scope", F.lit("UNKNOWN")))
    held = dispositions.select("terminal_status", scope.alias("scope"))
    per = held.rollup("terminal_status", "scope").agg(F.count("*").alias("n"), F.count_if(F.col("terminal_status").startswith("REJECTED")).alias("r"))
    whole = per.where("terminal_status is null and scope is null").select(F.lit("REJECTED*").alias("terminal_status"), F.lit(None).cast("string").alias("scope"), F.col("r").alias("n"))
    return per.drop("r").unionByName(whole)


def written_with_metrics(rows: DataFrame, path: str, metrics: dict[str, Column]) -> dict[str, object]:
    """Writes ``rows`` and returns the metrics, taken on the way: a report costs no further job."""
    seen = Observation()
    rows.observe(seen, *(m.alias(n) for n, m in metrics.items())).write.mode("overwrite").parquet(path)
    return seen.get


def batch_report(before: DataFrame, after: DataFrame, candidates: DataFrame, key: str, fields: list[str], path: str, most: float = 0.9) -> DataFrame:
    """(section, name, value) of an enrichment batch, whose records it writes to ``path``.

    Records, filled cells of each field and mean completeness before and after come from
    metrics on the write; candidates (source, scope, confidence, status) from one aggregate.
    """
    filled = lambda p, f: rules.filled(F.col(f"{p}.`{f}`").cast("string"))
    both = after.select(key, F.struct(*(F.col(f"`{f}`") for f in fields)).alias("__after")).join(before.select(key, F.struct(*(F.col(f"`{f}`") for f in fields)).alias("__before")), key, "left")
    full = after.join(both.select(key, "__before", "__after"), key)
    n = lambda on: F.count_if(F.coalesce(on, F.lit(False)))
    share = lambda p: F.avg(100.0 * sum((F.when(filled(p, f), 1).otherwise(0) for f in fields), F.lit(0)) / len(fields))
    metrics = {"records": F.count(F.lit(1)), "completeness before": share("__before"), "completeness after": share("__after")}
    for p, side in (("__before", "before"), ("__after", "after")):
        metrics |= {f"{f} {side}": n(filled(p, f)) for f in fields}
    seen = written_with_metrics(full, path, metrics)
    told = [("totals", k, float(seen[k])) for k in ("records", "completeness before", "completeness after")]
    told += [(f"coverage {side}", f, float(seen[f"{f} {side}"])) for side in ("before", "after") for f in fields]
    told += [("gained", f, float(seen[f"{f} after"] - seen[f"{f} before"])) for f in fields if seen[f"{f} after"] > seen[f"{f} before"]]
    report = before.sparkSession.createDataFrame(told, "section string, name string, value double")
    said = candidates.groupBy("source", "scope").agg(F.count("*").alias("n"), n(F.col("status") == "ACCEPTED").alias("ok"), n(F.coalesce("confidence", F.lit(0.0)) < most).alias("low"))
    each = F.array(*(F.struct(F.lit(s).alias("section"), F.coalesce(name, F.lit("none")).alias("name"), F.col(v).alias("value")) for s, name, v in (("candidates by source", F.col("source"), "n"), ("accepted by source", F.col("source"), "ok"), ("accepted by scope", F.col("scope"), "ok"), ("totals", F.lit("candidates"), "n"), ("totals", F.lit("accepted"), "ok"), ("totals", F.lit("low confidence"), "low"))))
    counts = said.select(F.explode(each).alias("e")).groupBy("e.section", "e.name").agg(F.sum("e.value").cast("double").alias("value"))
    return report.unionByName(counts)


# Answers that say nothing, by field.
UNINFORMATIVE = {"body_type": ["unknown"], "fuel_type": ["unknown"], "transmission": ["unknown"], "use_case": ["unknown", "general"]}


def informative(values: dict[str, Column], flags: dict[str, Column] | None = None) -> Column:
    """A map of the entries that say something: no nulls, no uninformative answers, flags only where they hold."""
    held = [F.when(v.isNotNull() & ~v.cast("string").isin(UNINFORMATIVE.get(k, [])), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in values.items()]
    held += [F.when(F.coalesce(v, F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit("true").alias("v"))) for k, v in (flags or {}).items()]
    return F.map_from_entries(F.array_compact(F.array(*held)))


def field_accuracy(pairs: DataFrame, expected: str, found: str) -> DataFrame:
    """(field, total, correct, accuracy) of each expected field and, as ``all``, of all together, from one pass over two map columns."""
    each = pairs.select(F.explode(expected).alias("field", "want"), F.col(found).alias("got"))
    ok = F.coalesce(F.try_element_at("got", F.col("field")) == F.col("want"), F.lit(False))
    out = each.select("field", ok.cast("int").alias("ok")).rollup("field").agg(F.count("*").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"))
    return out.select(F.coalesce("field", F.lit("all")).alias("field"), "total", "correct", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 6)).otherwise(0.0).alias("accuracy"))
