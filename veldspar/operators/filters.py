"""Filters over a catalog: fixed ones, families of one-hot columns, and what the columns decide.

Conditions that depend on which columns a table has are settled from its schema before any
job.  A null never passes a condition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.ranking import any_positive, squashed_name

# Range columns, and columns that have filters of their own.
RANGES = ["ARAI_Certified_Mileage", "Displacement", "Power", "Torque"]
OWN = ["Ex-Showroom_Price", "Seating_Capacity", "Fuel_Type", "Drivetrain", "Transmission_Automatic", "Transmission_Manual", "Make", "Body_Type", *RANGES]

# Requested features that no catalog holds, and the parts of column names that stand for the others.
UNSUPPORTED = ["Sunroof", "Ventilated_Seats"]
HARD_FEATURES = {
    "Airbags": ["airbag", "airbags", "numberofairbags"],
    "ABS_(Anti-lock_Braking_System)": ["abs", "antilock", "antilockbrakingsystem"],
    "Cruise_Control": ["cruisecontrol"],
    "Android_Auto": ["androidauto"],
    "Apple_CarPlay": ["applecarplay", "carplay"],
}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def within(c: Column, asked, scalar_is: str = "most") -> Column:
    """A pair is both bounds, included (null is open); a number alone the most or the least."""
    if isinstance(asked, (list, tuple)):
        low, high = asked
        parts = [c >= low] * (low is not None) + [c <= high] * (high is not None)
        return parts[0] & parts[-1] if parts else F.lit(True)
    return c <= asked if scalar_is == "most" else c >= asked


def members(rows: DataFrame, column: str, asked: Iterable[str], codes: DataFrame | None = None) -> DataFrame:
    """Rows whose ``column`` is one of the asked labels; ``codes`` (label, code) translates
    them first, and labels without a code match nothing."""
    if codes is None:
        return rows.where(_c(column).isin(list(asked)))
    wanted = codes.where(F.col("label").isin(list(asked))).select(F.col("code").alias("__code")).distinct()
    return rows.join(F.broadcast(wanted), _c(column) == F.col("__code"), "left_semi")  # at most as many as asked


def family_any(rows: DataFrame, part: str) -> DataFrame:
    """Rows where a column whose name holds ``part`` equals 1; all rows if there is no such column."""
    found = [c for c in rows.columns if part in c]
    if not found:
        return rows
    return rows.where(F.greatest(*(F.coalesce(_c(c) == 1, F.lit(False)) for c in found)) if len(found) > 1 else _c(found[0]) == 1)


def same_text(rows: DataFrame, column: str, asked: str) -> DataFrame:
    """Rows of the asked text in any case; all rows if the column is missing."""
    return rows.where(F.upper(_c(column)) == asked.upper()) if column in rows.columns else rows


def filtered(rows: DataFrame, asked: dict, codes: DataFrame | None = None) -> DataFrame:
    """All asked filters on a catalog; keys that are no columns and have no filter do nothing.

    Features are asked as 1 and pass where the column is above 0.
    """
    out = rows
    if "Ex-Showroom_Price" in asked:
        out = out.where(within(_c("Ex-Showroom_Price"), asked["Ex-Showroom_Price"]))
    if "price_min_only" in asked:
        out = out.where(_c("Ex-Showroom_Price") >= asked["price_min_only"])
    if "Make" in asked:
        out = members(out, "Make", asked["Make"], codes)
    if "Body_Type" in asked:
        out = family_any(out, asked["Body_Type"])
    if "Seating_Capacity" in asked:
        out = out.where(_c("Seating_Capacity") == asked["Seating_Capacity"])
    for kind in ("Transmission_Automatic", "Transmission_Manual"):
        if asked.get(kind) == 1:
            out = out.where(_c(kind) == 1)
            break
    for name in ("Fuel_Type", "Drivetrain"):
        if name in asked:
            out = same_text(out, name, asked[name])
    for name in RANGES:
        if name in asked and name in rows.columns:
            out = out.where(within(_c(name), asked[name], "least"))
    for name, value in asked.items():
        if name in rows.columns and name not in OWN:
            out = out.where(_c(name).isin(list(value)) if isinstance(value, (list, tuple)) else _c(name) > 0 if name in HARD_FEATURES and value == 1 else _c(name) == value)
    return out


def hard_features(rows: DataFrame, asked: dict) -> tuple[DataFrame, list[str]]:
    """(rows that have every asked feature, the features that the table cannot tell).

    A feature's columns are those whose squashed name holds one of its parts; values that are
    no numbers count as 0.
    """
    missing = sorted(f for f in UNSUPPORTED if asked.get(f) == 1)
    out = rows
    for feature, parts in HARD_FEATURES.items():
        if asked.get(feature) != 1:
            continue
        if any(p in squashed_name(c) for c in rows.columns for p in parts):
            out = out.where(any_positive(rows.columns, parts))
        else:
            missing.append(feature)
    return out, sorted(missing)


def gated(rows: DataFrame, asked: dict) -> tuple[DataFrame, str | None]:
    """As :func:`hard_features`, but no rows and a message where a feature cannot be told."""
    out, missing = hard_features(rows, asked)
    if not missing:
        return out, None
    return rows.limit(0), f"Your query requested {', '.join(missing)}, but this dataset does not contain reliable information for that feature."


def conformed(rows: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """The fields of a schema (name, type) in its order: unknown columns go, missing ones are null."""
    return rows.select(*((_c(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


def json_safe(rows: DataFrame) -> DataFrame:
    """NaN and infinities of all number columns as null."""
    safe = {n: F.when(F.isnan(_c(n)) | (F.abs(_c(n)) == float("inf")), None).otherwise(_c(n)) for n, t in rows.dtypes if t in ("float", "double")}
    return rows.withColumns(safe) if safe else rows


# The keys of a recommendation in the response, in their order.
RESPONSE = ["Make", "Model", "Variant", "Ex-Showroom_Price", "Displacement", "Power", "ARAI_Certified_Mileage", "Transmission", "Fuel_Type", "carImage", "carDekhoLink", "carWaleLink", "ranking_score", "match_reasons"]


def response(rows: DataFrame, score: str = "score", reasons_: str = "reasons") -> DataFrame:
    """The fourteen keys of a recommendation: columns that the catalog lacks are null, NaN and infinities too."""
    named = {"ranking_score": score, "match_reasons": reasons_}
    columns = [F.col(f"`{named.get(n, n)}`").alias(n) if named.get(n, n) in rows.columns else F.lit(None).cast("string").alias(n) for n in RESPONSE]
    return json_safe(rows.select(*columns))


def set_if_filled(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """``column`` replaced where the value is neither null nor empty."""
    return rows.withColumn(column, F.when(value.isNotNull() & (value.cast("string") != ""), value).otherwise(_c(column)))


def decoded(rows: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Codes of some columns replaced by their labels (label, code); unknown codes are null."""
    for name, table in codes.items():
        pair = table.select(F.col("code").alias("__code"), F.col("label").alias("__label"))
        out = rows.join(F.broadcast(pair) if table.count() <= 100_000 else pair, _c(name) == F.col("__code"), "left")
        rows = out.withColumn(name, F.col("__label")).drop("__code", "__label")
    return rows
