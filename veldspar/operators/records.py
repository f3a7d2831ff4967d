"""Candidates, conflicts, dispositions, merges and audits over (record, field) cells.

A candidate's value is typed: ``value_bool``, ``value_num`` or ``value_str``, the others null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import numbers_conflict


def cells(records: DataFrame, key: str, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """(key, kept columns, field, value): one row for each field of each record."""
    kept = [key, *keep]
    return records.select(*kept, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(kept, fields, "field", "value")


def populated(value: Column) -> Column:
    """Not null and not empty; false and 0 count."""
    return value.isNotNull() & (value != "")


def group_key(c: Column) -> Column:
    """A grouping value, blanks as one group."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("UNKNOWN"))


def conflict_reason(a: str, b: str) -> Column:
    """The first reason that the candidates in two struct columns (unit, value_bool, value_num, scope) contradict each other."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    filled = lambda c: c.isNotNull() & (c != "")
    either = x("value_bool").isNotNull() | y("value_bool").isNotNull()
    out = F.when(filled(x("unit")) & filled(y("unit")) & (x("unit") != y("unit")), "unit mismatch")
    out = out.when(either, F.when(~x("value_bool").eqNullSafe(y("value_bool")), "boolean disagreement"))
    out = out.when(numbers_conflict(x("value_num"), y("value_num")), "numeric values differ beyond tolerance")
    return out.when((x("scope") == "MODEL_LEVEL") & (y("scope") == "VARIANT_LEVEL"), "model-level vs variant-level contradiction")


def conflicts(candidates: DataFrame, group: list[str], seq: str) -> DataFrame:
    """(group, left, right, reason) of pairs of candidates of one cell that contradict each other, ``left`` before ``right`` by ``seq``.

    Equal candidates of a cell are one kind; only kinds of cells that can hold a conflict are
    paired, and their members are joined to the pairs that do.
    """
    kind = ["unit", "value_bool", "value_num", "scope"]
    held = candidates.select(*group, F.col(seq).alias("__seq"), *kind).withColumn("__kind", F.struct(*kind))
    first, last = F.min("__kind"), F.max("__kind")
    open_ = held.groupBy(*group).agg(first.alias("a"), last.alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select(*group)
    kinds = held.select(*group, "__kind").distinct().join(open_, group)
    both = kinds.withColumnRenamed("__kind", "x").join(kinds.withColumnRenamed("__kind", "y"), group)
    both = both.withColumn("reason", conflict_reason("x", "y")).where("reason is not null")
    left = held.select(*group, F.col("__kind").alias("x"), F.col("__seq").alias("left"))
    right = held.select(*group, F.col("__kind").alias("y"), F.col("__seq").alias("right"))
    on = lambda side: [F.col(f"p.{g}") == F.col(f"{side}.{g}") for g in group]
    joined = both.alias("p").join(left.alias("l"), [*on("l"), F.col("p.x").eqNullSafe(F.col("l.x"))]).join(right.alias("r"), [*on("r"), F.col("p.y").eqNullSafe(F.col("r.y"))])
    return joined.where("left < right").select(*(F.col(f"p.{g}") for g in group), "left", "right", "reason")


def conflicted(candidates: DataFrame, group: list[str], seq: str) -> DataFrame:
    """The cells (group) in which some pair of :func:`conflicts` is, from aggregates alone.

    A cell has a conflict if two units are named; else if one candidate has a flag that another
    lacks or contradicts; else, without any flag, if the least and the greatest number conflict
    (no two can be further apart, and the tolerance grows slower than the difference), or if a
    model-level candidate comes before a variant-level one.  ``seq`` tells candidates apart.
    One row a cell leaves each task, whatever its members are.
    """
    c = F.col
    unit = F.nullif(c("unit"), F.lit(""))
    num = F.when(F.isnan(c("value_num").cast("double")) | (F.abs(c("value_num").cast("double")) == float("inf")), None).otherwise(c("value_num"))  # these conflict with nothing
    per = candidates.groupBy(*group).agg(
        F.min(unit).alias("u0"), F.max(unit).alias("u1"), F.min("value_bool").alias("b0"), F.max("value_bool").alias("b1"), F.bool_or(c("value_bool").isNull()).alias("open"),
        F.min(num).alias("n0"), F.max(num).alias("n1"), F.min(F.when(c("scope") == "MODEL_LEVEL", c(seq))).alias("model"), F.max(F.when(c("scope") == "VARIANT_LEVEL", c(seq))).alias("variant"),
    )
    flags = c("b0").isNotNull() & (c("open") | (c("b0") != c("b1")))
    plain = c("b0").isNull() & (F.coalesce(numbers_conflict(c("n0"), c("n1")), F.lit(False)) | F.coalesce(c("model") < c("variant"), F.lit(False)))
    return per.where(F.coalesce(c("u0") != c("u1"), F.lit(False)) | flags | plain).select(*group)


def conflict_counts(candidates: DataFrame, group: list[str], seq: str) -> DataFrame:
    """(group, n): how many pairs of :func:`conflicts` each cell has, where it has any.

    Members are counted by kind, and kinds are paired, never members: two kinds that contradict
    each other either way have as many pairs as the product of their counts.  Where only the
    order makes the conflict (model-level before variant-level), the model-level members before
    each variant-level one come from a running count over the two kinds.
    """
    kind = ["unit", "value_bool", "value_num", "scope"]
    held = candidates.select(*group, F.col(seq).alias("__seq"), F.struct(*kind).alias("k")).join(conflicted(candidates, group, seq), group, "left_semi")
    kinds = held.groupBy(*group, "k").agg(F.count("*").alias("c"))
    kinds = kinds.withColumn("id", F.xxhash64("k"))
    left, right = (kinds.select(*group, F.col("k").alias(f"{s}k"), F.col("c").alias(f"{s}c"), F.col("id").alias(f"{s}id")) for s in ("x", "y"))
    both = left.join(right, group)
    apart = "model-level vs variant-level contradiction"
    both = both.withColumn("reason", conflict_reason("xk", "yk")).where("reason is not null")
    ordered = F.col("reason") == apart
    products = both.where(~ordered & (F.col("xid") < F.col("yid"))).select(*group, (F.col("xc") * F.col("yc")).alias("n"))
    scopes = both.where(ordered).select(*group, "xk", "yk", "xid", "yid")
    rows = held.withColumn("id", F.xxhash64("k"))
    first = scopes.join(rows.select(*group, F.col("id").alias("xid"), "__seq"), [*group, "xid"]).select(*group, "xid", "yid", "__seq", F.lit(1).alias("x"))
    last = scopes.join(rows.select(*group, F.col("id").alias("yid"), "__seq"), [*group, "yid"]).select(*group, "xid", "yid", "__seq", F.lit(0).alias("x"))
    before = F.sum("x").over(Window.partitionBy(*group, "xid", "yid").orderBy("__seq").rangeBetween(Window.unboundedPreceding, -1))
    counted = first.unionByName(last).withColumn("n", before).where("x = 0").select(*group, F.coalesce("n", F.lit(0)).alias("n"))
    return products.unionByName(counted).groupBy(*group).agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


def conflict_ids(candidates: DataFrame, group: list[str], seq: str, prefix: str = "SSCONFLICT") -> DataFrame:
    """(group, conflict_id): of a cell's conflicts, numbered from 1, the last one's id stays."""
    parts = [F.lit(prefix), *(F.col(g).cast("string") for g in group), F.col("n").cast("string")]
    return conflict_counts(candidates, group, seq).select(*group, F.concat_ws("-", *parts).alias("conflict_id"))


# Resolution methods in their order.
METHODS = ["exact official variant source", "exact official brochure", "exact trusted portal match", "safe powertrain/model inheritance", "manual review", "unresolved conflict"]


def source_rank(method: Column, kind: Column, match: Column, inherited: Column) -> Column:
    """A candidate's rank: its method's place, else by its source type, match confidence and inheritance."""
    said = F.coalesce(F.nullif(method, F.lit("")), kind, F.lit(""))
    out = F.when(said.contains(METHODS[0]), 0)
    for i, m in enumerate(METHODS[1:], 1):
        out = out.when(said.contains(m), i)
    out = out.when(kind == "official_variant", 0).when(kind == "official_brochure", 1).when((match >= 0.9) & (kind == "trusted_portal"), 2)
    return out.when(F.coalesce(inherited, F.lit(False)), 3).otherwise(4)


def winners(candidates: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each cell."""
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__n = 1").drop("__n")


def resolved(candidates: DataFrame, group: list[str], order: list[Column], conflicted: DataFrame | None = None) -> DataFrame:
    """(group, status, seq): accepted with the first valid candidate, manual_review without one, unresolved_conflict where ``conflicted`` has the cell."""
    valid = F.col("status").isin("VALID", "UNVALIDATED")
    all_cells = candidates.select(*group).distinct()
    first = winners(candidates.where(valid), group, order).select(*group, F.col("seq").alias("__seq"))
    out = all_cells.join(first, group, "left")
    bad = conflicted.select(*group).distinct().withColumn("__bad", F.lit(True)) if conflicted is not None else None
    out = out.join(bad, group, "left") if bad is not None else out.withColumn("__bad", F.lit(None).cast("boolean"))
    status = F.when(F.col("__bad"), "unresolved_conflict").when(F.col("__seq").isNull(), "manual_review").otherwise("accepted")
    return out.select(*group, status.alias("status"), F.when(status == "accepted", F.col("__seq")).alias("seq"))


def evaluated(candidates: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Validation, conflicts and resolution in one: ``candidates`` has errors (array) and ``seq``; conflicts count among the valid ones."""
    rows = candidates.withColumn("status", F.when(F.size("errors") == 0, "VALID").otherwise("INVALID"))
    return resolved(rows, group, order, conflicted(rows.where("status = 'VALID'"), group, "seq"))


def duplicates_marked(candidates: DataFrame, same: list[str], order: list[Column], seq: str) -> DataFrame:
    """``duplicate_of``: the first of exact repeats; null for that one."""
    w = Window.partitionBy(*same).orderBy(*order)
    return candidates.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, F.first(seq).over(w)))


def dispositions(candidates: DataFrame, group: list[str], same: list[str], order: list[Column], seq: str, least: float = 0.9) -> DataFrame:
    """Every candidate with one terminal status: ``terminal_status`` and ``winner``.

    ``candidates`` has errors (array), confidence, existing (the record's own value as text)
    and the columns of :func:`conflict_reason`.  In this order: a repeat, invalid, low
    confidence, in conflict with another valid one, kept out by an existing value, accepted,
    superseded.
    """
    rows = duplicates_marked(candidates, same, [F.col(seq)], seq)
    early = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE_CANDIDATE").when(F.size("errors") > 0, "REJECTED_VALIDATION").when(F.coalesce("confidence", F.lit(0.0)) < least, "REJECTED_LOW_CONFIDENCE")
    rows = rows.withColumn("__early", early)
    valid = rows.where("__early is null")
    bad = conflicted(valid, group, seq).withColumn("__bad", F.lit(True))
    first = winners(valid, group, order).select(*group, F.col(seq).alias("winner"))
    rows = rows.join(bad, group, "left").join(first, group, "left")
    status = F.coalesce("__early", F.when(F.col("__bad"), "CONFLICT_UNRESOLVED").when(populated(F.col("existing")), "EXISTING_VALUE_PRESERVED").when(F.col(seq) == F.col("winner"), "ACCEPTED").otherwise("SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE"))
    rows = rows.withColumn("terminal_status", status)
    return rows.withColumn("winner", F.when(F.col("terminal_status") == "SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE", F.col("winner")).when(F.col("terminal_status") == "DUPLICATE_CANDIDATE", F.col("duplicate_of"))).drop("__early", "__bad")


# The terminal statuses.
STATUSES = ["DUPLICATE_CANDIDATE", "REJECTED_VALIDATION", "REJECTED_LOW_CONFIDENCE", "REJECTED_INHERITANCE_POLICY", "REJECTED_SCOPE_MISMATCH", "CONFLICT_UNRESOLVED", "EXISTING_VALUE_PRESERVED", "ACCEPTED", "SUPERSEDED_BY_HIGHER_PRIORITY_SOURCE"]


def reconciled(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(kind, n): dispositions without a known status, and by how many their number misses the candidates'."""
    unknown = found.where(~F.coalesce(F.col("terminal_status").isin(STATUSES), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("unknown status").alias("kind"), "n")
    apart = found.agg(F.count("*").alias("a")).crossJoin(candidates.agg(F.count("*").alias("b")))  # one row each
    return unknown.union(apart.select(F.lit("missing dispositions"), F.abs(F.col("a") - F.col("b"))))


def overlap(found: DataFrame, group: list[str]) -> DataFrame:
    """Cells with several sources: how many sources and values, and whether they agree."""
    per = found.groupBy(*group).agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("value").alias("n_values"), F.max(F.coalesce(F.col("terminal_status") == "ACCEPTED", F.lit(False))).alias("has_accepted"))
    return per.where("n_sources > 1").withColumn("agree", F.col("n_values") == 1)


def coverage(records: DataFrame, key: str, fields: list[str], by: str | None = None) -> DataFrame:
    """Populated and missing cells of each field, and their percentage, for all or by a column."""
    rows = records.select(key, *([F.col(by).alias("grp")] if by else []), *(F.col(f).cast("string").alias(f) for f in fields))
    held = rows.unpivot([key, *(["grp"] if by else [])], fields, "field", "value")
    n, full = F.count("*"), F.sum(F.when(populated(F.col("value")), 1).otherwise(0))
    return held.groupBy("field", *(["grp"] if by else [])).agg(n.alias("n"), full.alias("n_populated"), (n - full).alias("n_missing"), F.countDistinct("value").alias("n_distinct"), F.round(100 * full / n, 2).alias("pct"))


def filled_share(rows: DataFrame, fields: list[str]) -> Column:
    """Percentage of the fields of a schema that are filled; fields that the table lacks are empty."""
    there = [F.when(populated(F.col(f"`{f}`").cast("string")), 1).otherwise(0) for f in fields if f in rows.columns]
    return F.round(100.0 * sum(there, F.lit(0)) / len(fields), 2)


def group_means(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """(column, grp, n, average, least, most) of a score by each of some columns, from one pass."""
    held = scores.select(value, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), group_key(F.col(c)).alias("grp")) for c in by))).alias("g"))
    return held.groupBy("g.column", "g.grp").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("average"), F.min(value).alias("least"), F.max(value).alias("most"))


def summary(scores: DataFrame, value: str = "score") -> DataFrame:
    """One row: mean, least and most; 0 for an empty table."""
    return scores.agg(*(F.coalesce(f(value), F.lit(0.0)).alias(n) for n, f in (("average", lambda c: F.round(F.avg(c), 6)), ("least", F.min), ("most", F.max))))


def examples(held: DataFrame, group: list[str], value: str, order: list[Column], most: int = 5) -> DataFrame:
    """(group, examples): the first values of each group, in order."""
    top = held.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= most)
    got = F.array_sort(F.collect_list(F.struct("__n", value)))  # ``most`` of them
    return top.groupBy(*group).agg(F.transform(got, lambda x: x[value]).alias("examples"))


def accuracy(pairs: DataFrame, expected: str, found: str) -> DataFrame:
    """(total, correct, accuracy) over all entries of map columns; 0 without any."""
    each = pairs.select(F.explode(expected).alias("k", "v"), F.col(found).alias("f")).select(F.coalesce(F.try_element_at("f", F.col("k")).eqNullSafe(F.col("v")), F.lit(False)).alias("ok"))
    out = each.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("ok").cast("bigint")), F.lit(0)).alias("correct"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 6)).otherwise(0.0))


def filled(records: DataFrame, key: str, field: str, candidates: DataFrame) -> DataFrame:
    """``records`` with the candidates' values where the field is null; known values stay.

    ``candidates``: (key, value) and, if there, source and confidence, which become the
    ``provenance`` of a value that was written.
    """
    more = [c for c in ("source", "confidence") if c in candidates.columns]
    found = candidates.select(key, F.col("value").alias("__new"), *(F.col(c).alias(f"__{c}") for c in more))
    out = records.join(found, key, "left")
    took = F.col(field).isNull() & F.col("__new").isNotNull()
    out = out.withColumn("filled", took)
    if more:
        out = out.withColumn("provenance", F.when(F.col("filled"), F.struct(F.lit(field).alias("field"), F.col("__new").alias("value"), *(F.col(f"__{c}").alias(c) for c in more))))
    return out.withColumn(field, F.coalesce(field, "__new")).drop("__new", *(f"__{c}" for c in more))


def unresolved(held: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Empty cells after a merge: UNRESOLVED_CONFLICT where a candidate was there, else FIELD_NOT_PUBLISHED."""
    seen = candidates.select(key, "field").distinct().withColumn("__seen", F.lit(True))
    out = held.where(F.col("value").isNull()).join(seen, [key, "field"], "left")
    return out.withColumn("null_reason", F.when(F.col("__seen"), "UNRESOLVED_CONFLICT").otherwise("FIELD_NOT_PUBLISHED")).drop("__seen")


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of cells that differ, null-safe."""
    old = cells(before, key, fields).withColumnRenamed("value", "before")
    new = cells(after, key, fields).withColumnRenamed("value", "after")
    return old.join(new, [key, "field"]).where(~F.col("before").eqNullSafe(F.col("after")))


def with_decisions(records: DataFrame, decisions: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Records whose decision names their identity too (null-safe), with the decision's other columns."""
    other = [c for c in decisions.columns if c != key and c not in identity]
    named = decisions.select(key, *(F.col(c).alias(f"__{c}") for c in identity), *other)
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return records.join(named, key).where(same).drop(*(f"__{c}" for c in identity))


def routed(records: DataFrame, status: Column, decisions: DataFrame, key: str) -> DataFrame:
    """``subset`` of each record: nullable_usable, excluded or recommendation_ready, by its last decision, then by its status."""
    last = decisions.groupBy(key).agg(F.max_by("decision", "seq").alias("decision"))
    out = records.join(last, key, "left")
    subset = F.when(F.col("decision") == "accept_with_nullable_fields", "nullable_usable").when(F.col("decision").isin("quarantine", "reject"), "excluded")
    return out.withColumn("subset", subset.when(status == "recommendation_ready", "recommendation_ready").otherwise("excluded"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(failure, n) of each named check that has rows."""
    out = None
    for name, rows in checks.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("failure"), "n")
        out = n if out is None else out.union(n)
    return out.where("n > 0")
