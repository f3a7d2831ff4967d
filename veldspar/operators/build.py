"""Building enriched records: candidates from specification tables, merges, reviews, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators import records, rules


def model_candidates(rows: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """(key, field, value, scope) of specifications (make, model, field, value) that all variants of a model share."""
    return rows.join(specs, ["make", "model"]).select(key, "field", "value", F.lit("MODEL_LEVEL").alias("scope"))


def powertrain_candidates(rows: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """The same by powertrain: of the rules of a model (fuel_type, engine_cc, transmission, null for
    any) the first that fits, by ``priority``."""
    r = specs.select(*(F.col(c).alias(f"r_{c}") for c in specs.columns))
    fits = (F.col("make") == F.col("r_make")) & (F.col("model") == F.col("r_model"))
    for c in ("fuel_type", "engine_cc", "transmission"):
        fits = fits & (F.col(f"r_{c}").isNull() | (F.col(c) == F.col(f"r_{c}")))
    found = rows.join(r, fits)
    first = found.groupBy(key).agg(F.min("r_priority").alias("r_priority"))
    return found.join(first, [key, "r_priority"]).select(key, F.col("r_field").alias("field"), F.col("r_value").alias("value"), F.lit("POWERTRAIN_LEVEL").alias("scope"))


def gearbox_candidates(rows: DataFrame, patterns: list[tuple[str, int]], key: str) -> DataFrame:
    """gearbox_speeds of the first pattern that a transmission fits, else 1 for electric records."""
    speeds = F.coalesce(*(F.when(F.col("transmission").rlike(p), n) for p, n in patterns), F.when(F.lower("fuel_type") == "electric", 1))
    return rows.select(key, F.lit("gearbox_speeds").alias("field"), speeds.cast("string").alias("value"), F.lit("POWERTRAIN_LEVEL").alias("scope")).where("value is not null")


# Gearboxes of models by their variant's and transmission's text, first match wins.
GEARBOX_RULES = [
    ("Tata", "Nexon", r"5 Speed Manual", 5), ("Tata", "Nexon", r"6 Speed Manual", 6), ("Tata", "Nexon", r"Automatic \(AMT\)", 6), ("Tata", "Nexon", r"Automatic \(DCT\)", 7),
    ("Hyundai", "Creta", r"Manual", 6), ("Hyundai", "Creta", r"Automatic \(DCT\)", 7), ("Hyundai", "Creta", r"Automatic \(TC\)", 6),
    ("Maruti Suzuki", "Swift", r"Manual", 5), ("Maruti Suzuki", "Swift", r"Automatic \(AMT\)|Automatic$", 5),
    ("Mahindra", "XUV 3XO", r"Manual", 6), ("Mahindra", "XUV 3XO", r"Automatic \(AMT\)", 6), ("Mahindra", "XUV 3XO", r"Automatic \(TC\)", 6),
]


def gearbox_rules(spark: SparkSession, rules: list[tuple[str, str, str, int]] = GEARBOX_RULES, compat: bool = True) -> DataFrame:
    """(make, model, priority, pattern, speeds): a rule table.

    With ``compat`` brackets are escaped once too often, as in the results to match: such a
    pattern wants a backslash in the text, so bracketed labels like ``Automatic (AMT)`` fit none.
    """
    once = lambda p: p.replace("\\", "\\\\") if compat else p
    return spark.createDataFrame([(make, model, i, once(p), n) for i, (make, model, p, n) in enumerate(rules)], "make string, model string, priority int, pattern string, speeds int")


def gearbox_rule_candidates(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """gearbox_speeds of the first rule of a record's make and model that fits its variant and
    transmission (any case), else 1 for electric records.

    ``table``: (make, model, priority, pattern, speeds), of any length; rules meet records by
    make and model, so only a model's own patterns are tried.
    """
    text = F.concat_ws(" ", F.coalesce("variant", F.lit("")), F.coalesce("transmission", F.lit("")))
    held = rows.select(key, "make", "model", text.alias("__text"))
    found = held.join(table, ["make", "model"]).where(F.rlike("__text", F.concat(F.lit("(?i)"), F.col("pattern"))))
    first = found.groupBy(key).agg(F.min_by("speeds", "priority").alias("__speeds"))
    speeds = F.coalesce("__speeds", F.when(F.lower("fuel_type") == "electric", 1))
    out = rows.select(key, "fuel_type").join(first, key, "left")
    return out.select(key, F.lit("gearbox_speeds").alias("field"), speeds.cast("string").alias("value"), F.lit("POWERTRAIN_LEVEL").alias("scope")).where("value is not null")


def rule_candidates(rows: DataFrame, table: list[tuple[str, str, str, bool]], key: str) -> DataFrame:
    """Booleans of exact variants from a rule table: (model, condition, field, value)."""
    parts = [rows.where((F.col("model") == m) & F.expr(when)).select(key, F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit("VARIANT_LEVEL").alias("scope")) for m, when, f, v in table]
    return reduce(DataFrame.union, parts)


def of_all(sources: dict[str, DataFrame]) -> DataFrame:
    """The candidates of all adapters with their ``source``; an adapter without any adds none."""
    return reduce(DataFrame.unionByName, [rows.withColumn("source", F.lit(name)) for name, rows in sources.items()])


def targeted(candidates: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(candidates whose record is there, those for review whose record is not)."""
    ids = rows.select(key).distinct()
    return candidates.join(ids, key, "left_semi"), candidates.join(ids, key, "left_anti").withColumn("reason", F.lit("candidate target record not found"))


def variant_errors(allowed: list[str], same: Column) -> Column:
    """Errors of a candidate for one exact variant: its field, inheritance, match status, components, value and identity."""
    c = F.col
    parts = [F.when(~c("match").getField(n), f"{n} failed") for n in ("make_match", "model_match", "fuel_match", "transmission_match", "special_edition_match")]
    found = F.array(
        F.when(~c("field").isin(allowed), "field is outside variant-safety target set"),
        F.when(F.coalesce(c("inherited"), F.lit(False)), "inheritance is forbidden for variant-level safety batch"),
        F.when(rules.filled(c("scope")), "inheritance scope must be null for direct variant evidence"),
        F.when(~F.coalesce(c("match_status").isin("EXACT", "HIGH_CONFIDENCE"), F.lit(False)), F.concat(F.lit("variant match status "), F.coalesce(c("match_status"), F.lit("None")), F.lit(" is not mergeable"))),
        *parts,
        F.when(c("value_bool").isNull(), "normalized boolean value must be explicit true/false"),
        F.when(~rules.filled(c("proposed")), "raw source value missing; missing text must remain null"),
        F.when(~same, "candidate identity does not match target record"),
    )
    return F.array_compact(found)


def shared_merge(candidates: DataFrame, group: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """(accepted: group, seq, value; review: group, reason) of a merge that never overwrites.

    ``candidates`` has errors (array), blocked, confidence, source, value, existing, needs_bool
    and the columns of a conflict.  A conflict is looked for among the valid ones only.
    """
    bad = candidates.where((F.size("errors") > 0) | F.col("blocked"))
    valid = candidates.where((F.size("errors") == 0) & ~F.col("blocked"))
    apart = records.conflicted(valid, group, seq)
    first = records.winners(valid.join(apart, group, "left_anti"), group, [F.desc_nulls_last("confidence"), F.coalesce("source", F.lit("")), F.col(seq)])
    kept = records.populated(F.col("existing"))
    explicit = ~F.col("needs_bool") | F.col("value_bool").isNotNull()
    accepted = first.where(~F.coalesce(kept, F.lit(False)) & explicit).select(*group, seq, "value")
    why = F.when(kept & (F.col("existing") != F.col("value")), "existing value conflict").when(~F.coalesce(kept, F.lit(False)) & ~explicit, "boolean candidate is not explicit bool")
    review = bad.select(*group, F.lit("candidate validation failed").alias("reason")).union(apart.select(*group, F.lit("unresolved candidate conflict")))
    return accepted, review.union(first.select(*group, why.alias("reason")).where("reason is not null"))


def shared_dispositions(candidates: DataFrame, group: list[str], same: list[str], seq: str, least: float = 0.9) -> DataFrame:
    """``terminal_status`` of every candidate after a merge: a repeat, in conflict (any candidate
    counts), invalid, blocked by policy, low confidence, kept out, accepted, superseded, or out of scope.

    ``existing`` is the value before the merge, ``merged`` the one after it, ``written`` whether
    the merge has written it.
    """
    rows = records.duplicates_marked(candidates, same, [F.col(seq)], seq)
    apart = records.conflicted(candidates, group, seq).withColumn("__bad", F.lit(True))
    rows = rows.join(apart, group, "left")
    took = F.coalesce(F.col("written") & (F.col("merged") == F.col("value")), F.lit(False))
    some = rows.where(took).select(*group).distinct().withColumn("__won", F.lit(True))
    rows = rows.join(some, group, "left")
    status = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE_CANDIDATE").when(F.col("__bad"), "CONFLICT_UNRESOLVED").when(F.size("errors") > 0, "REJECTED_VALIDATION").when(F.col("blocked"), "REJECTED_INHERITANCE_POLICY")
    status = status.when(F.coalesce("confidence", F.lit(0.0)) < least, "REJECTED_LOW_CONFIDENCE").when(records.populated(F.col("existing")), "EXISTING_VALUE_PRESERVED").when(took, "ACCEPTED")
    return rows.withColumn("terminal_status", status.when(F.col("__won"), "SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE").otherwise("REJECTED_SCOPE_MISMATCH")).drop("__bad", "__won")


def with_evidence(decisions: DataFrame, evidence: DataFrame, key: str, seq: str) -> DataFrame:
    """Decisions beside the last evidence of their record, or none."""
    names = [c for c in evidence.columns if c not in (key, seq)]
    last = evidence.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("evidence"))
    return decisions.join(last, key, "left")


def resolution(field: str, old: Column, new: Column, url: Column, raw: Column, decision: Column, applied_at: Column) -> Column:
    """The provenance of a reviewed value."""
    return F.struct(F.lit(field).alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), url.alias("source_url"), raw.alias("raw_value"), decision.alias("review_decision"), applied_at.alias("applied_at"))


def overwritten(rows: DataFrame, resolved: DataFrame, key: str, field: str, identity: list[str]) -> DataFrame:
    """``rows`` with the resolved values (key, identity, new) of records whose identity agrees; ``applied`` tells which."""
    named = records.with_decisions(rows, resolved.select(key, *identity, "new"), key, identity).select(key, F.col("new").alias("__new"))
    out = rows.join(named, key, "left")
    return out.withColumn("applied", F.col("__new").isNotNull()).withColumn(field, F.coalesce("__new", field)).drop("__new")


def with_conflicts(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``conflict_metadata``: what two sources say about fields that keep their value."""
    entry = F.struct("seq", "field", F.lit("unresolved").alias("status"), "ours", "theirs", "rationale")
    held = found.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("conflict_metadata"))  # of one record
    return rows.join(held, key, "left")


def audit(cells: DataFrame, policy: DataFrame) -> DataFrame:
    """(field, applicable, populated, missing, not_applicable, distinct, invalid, pct) of every field."""
    reason = rules.null_reason(F.col("field"), F.col("fuel"), F.col("value"), F.col("fuels"))
    rows = cells.join(F.broadcast(policy.select("field", "fuels")), "field").withColumn("__no", F.coalesce(reason == "NOT_APPLICABLE", F.lit(False))).withColumn("__ok", rules.filled(F.col("value")))
    n = lambda on: F.sum(F.when(on, 1).otherwise(0)).cast("bigint")
    wrong = F.size(rules.errors(F.col("field"), F.col("fuel"), F.col("value"))) > 0
    out = rows.groupBy("field").agg(n(~F.col("__no")).alias("applicable"), n(F.col("__ok")).alias("populated"), n(~F.col("__no") & ~F.col("__ok")).alias("missing"), n(F.col("__no")).alias("not_applicable"), F.countDistinct(F.when(F.col("__ok"), F.col("value"))).alias("distinct"), n(wrong).alias("invalid"))
    return out.withColumn("pct", F.when(F.col("applicable") > 0, F.round(100.0 * F.col("populated") / F.col("applicable"), 2)).otherwise(100.0))


def model_means(cells: DataFrame, group: str) -> DataFrame:
    """(group, mean_coverage) of the coverage of each field within each group, the weakest first."""
    per = cells.groupBy(group, "field").agg(F.avg(F.when(rules.filled(F.col("value")), 100.0).otherwise(0.0)).alias("c"))
    return per.groupBy(group).agg(F.round(F.avg("c"), 6).alias("mean_coverage")).orderBy("mean_coverage", group)


def manifest(candidates: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(source, model, fields, matched, unmatched, negatives) of each source and model: fields
    and records that it has candidates for, records without any, and whether a value is false."""
    named = candidates.join(rows.select(key, "model"), key)
    per = named.groupBy("source", "model").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.countDistinct(key).alias("matched"), F.coalesce(F.bool_or(~F.col("value_bool")), F.lit(False)).alias("negatives"))
    return per.join(rows.groupBy("model").agg(F.count("*").alias("__n")), "model").withColumn("unmatched", F.col("__n") - F.col("matched")).drop("__n")


def still_missing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Cells (key, field, fuel, value) that apply and are empty before and after a merge, with the reason of each."""
    empty = after.where(~rules.filled(F.col("value"))).select(key, "field")
    rows = before.where(~rules.filled(F.col("value")) & rules.applicable(F.col("field"), F.col("fuel"), F.col("value"))).join(empty, [key, "field"], "left_semi")
    return rows.withColumn("null_reason", rules.unresolved_reason(F.col("field"), F.col("fuel")))


def sidecar(cells: DataFrame, key: str) -> DataFrame:
    """One map of null envelopes for each record, over its empty fields."""
    reason = rules.null_reason(F.col("field"), F.col("fuel"), F.col("value"))
    entry = F.struct("field", rules.null_envelope(reason, F.lit(None).cast("string")).alias("e"))
    held = cells.where(F.col("value").isNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("nulls"))  # the fields of one record
    return cells.select(key).distinct().join(held, key, "left")


def pilot(queue: DataFrame, categories: list[str], most: int = 10) -> DataFrame:
    """(source, n): how many queued cells of some categories each preferred source would fill, the most first."""
    return queue.where(F.col("category").isin(categories)).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(most)
