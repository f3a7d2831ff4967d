"""Additive rule scores with reasons, diversified top lists and similarity blends.

Rules are data; they become sums of conditional columns, so a whole catalog (or many requests
against it) is scored in one pass without a UDF.  Columns that rules read: price, mileage,
power, torque, seats (numbers), make, model, body, fuel, transmission (texts), airbags, abs,
sunroof, ventilated_seats, cruise_control, android_auto, apple_carplay (booleans); of the
request: use, cap, and asked_* (booleans or texts).  Nulls never match and never score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Share of the cap that a use case aims at; 0.70 for any other.
AIMS = {"budget": 0.55, "student": 0.55, "premium": 0.92, "highway": 0.88, "enthusiast": 0.88, "family": 0.78, "parents": 0.78}

# Fixed values: (uses, least and most share of the cap, points, reason); a null bound is open.
SPENDING = [
    (["premium"], 0.75, 0.98, 18, "uses premium budget well"),
    (["premium"], None, 0.60, -22, "penalized for underusing premium budget"),
    (["highway", "enthusiast"], 0.70, 0.98, 12, "uses budget well for performance use"),
    (["family", "parents"], 0.60, 0.95, 6, "uses budget well for practical use"),
    (["family", "parents", "highway", "premium"], None, 0.40, -12, "penalized for being too basic for this use-case"),
]

# Parts of model names that a use case counts against.
TOO_SMALL = {
    "family": ["nano", "redi-go", "redi go", "alto 800", "eon", "kwid", "qute"],
    "parents": ["nano", "redi-go", "redi go", "kwid", "eon", "re60", "qute"],
    "highway": ["nano", "redi-go", "redi go", "kwid", "alto", "eon"],
}

# Fixed values: (use cases, condition, points, reason), in the order of the reasons.
USE_RULES = [
    (["family"], "seats >= 5", 6, "suitable seating for family"),
    (["family"], "seats >= 6", 7, "extra seating capacity"),
    (["family"], "body in ('suv', 'mpv', 'muv')", 12, "very practical family body type"),
    (["family"], "body = 'sedan'", 9, "comfortable family sedan"),
    (["family"], "body = 'hatchback'", 3, "usable family hatchback"),
    (["family"], "airbags", 10, "airbags for safety"),
    (["family"], "abs", 8, "ABS for safety"),
    (["family"], "mileage >= 17", 4, "family-friendly mileage"),
    (["parents"], "transmission = 'automatic'", 12, "automatic is easier for parents"),
    (["parents"], "airbags", 10, "airbags for safety"),
    (["parents"], "abs", 8, "ABS for safety"),
    (["parents"], "body in ('hatchback', 'sedan', 'suv')", 5, "practical body type for parents"),
    (["parents"], "mileage >= 14", 3, "reasonable mileage for parents"),
    (["highway"], "body in ('suv', 'sedan')", 10, "good highway body type"),
    (["highway"], "power >= 90", 8, "adequate highway power"),
    (["highway"], "power >= 110", 4, "stronger highway performance"),
    (["highway"], "torque >= 180", 7, "good torque for highway use"),
    (["highway"], "fuel = 'diesel'", 6, "diesel suits highway driving"),
    (["highway"], "abs", 7, "ABS useful for highway safety"),
    (["highway"], "airbags", 7, "airbags useful for highway safety"),
    (["highway"], "cruise_control", 5, "cruise control useful for highway driving"),
    (["city", "commute"], "body in ('hatchback', 'sedan', 'suv')", 6, "practical for city/commute"),
    (["city", "commute"], "transmission = 'automatic'", 7, "automatic helps in traffic"),
    (["city", "commute"], "mileage >= 17", 8, "efficient for daily use"),
    (["city", "commute"], "price < 1000000", 3, "reasonable daily-use price"),
    (["student"], "mileage >= 18", 10, "student-friendly mileage"),
    (["student"], "body in ('hatchback', 'sedan')", 6, "student-friendly body type"),
    (["student"], "fuel in ('petrol', 'cng')", 5, "practical fuel choice"),
    (["student"], "price < 900000", 5, "student-friendly price"),
    (["budget"], "mileage >= 18", 10, "good mileage for budget buyer"),
    (["budget"], "fuel in ('petrol', 'cng', 'diesel')", 5, "practical budget fuel type"),
    (["budget"], "body in ('hatchback', 'sedan')", 6, "budget-friendly body type"),
    (["premium"], "sunroof", 8, "sunroof adds premium feel"),
    (["premium"], "ventilated_seats", 10, "ventilated seats add premium comfort"),
    (["premium"], "android_auto", 4, "has Android Auto"),
    (["premium"], "apple_carplay", 4, "has Apple CarPlay"),
    (["premium"], "cruise_control", 5, "has cruise control"),
    (["premium"], "body in ('suv', 'muv')", 10, "premium SUV-like body type"),
    (["premium"], "body = 'sedan'", 8, "premium sedan body type"),
    (["premium"], "power >= 120", 5, "premium-level power"),
    (["enthusiast"], "power >= 100", 10, "strong power output"),
    (["enthusiast"], "torque >= 180", 8, "strong torque output"),
    (["enthusiast"], "body in ('sedan', 'suv', 'sports', 'coupe')", 6, "enthusiast-friendly body type"),
]
TOO_SMALL_POINTS = {
    "family": (-18, "penalized as too small/basic for family use"),
    "parents": (-15, "penalized as too basic for parents"),
    "highway": (-20, "penalized as weak for highway use"),
}

# Requested features, their points if present and if missing, and their names.
FEATURES = [
    ("sunroof", 15, -50, "sunroof"),
    ("ventilated_seats", 15, -50, "ventilated seats"),
    ("cruise_control", 8, -10, "cruise control"),
    ("android_auto", 8, -10, "Android Auto"),
    ("apple_carplay", 8, -10, "Apple CarPlay"),
    ("abs", 8, -10, "ABS"),
    ("airbags", 8, -10, "airbags"),
]

# Makes and parts of model names that are marked down.
OLD_MAKES = ["unknown", "premier", "fiat", "bajaj"]
OLD_MODELS = ["rio", "nano", "redi-go", "redi go", "eon", "punto", "punto evo", "qute", "re60"]

# Fixed values: (use case, parts of model names, points, reason).
CURATED = [
    ("family", ["ertiga", "triber", "venue", "nexon", "xuv300", "brezza", "amaze", "dzire", "aspire", "xcent", "verito", "baleno"], 10, "strong family-friendly model match"),
    ("highway", ["venue", "nexon", "xuv300", "creta", "seltos", "kicks", "duster", "ecosport", "brezza", "scorpio", "xuv500", "harrier", "compass"], 10, "strong highway-friendly model match"),
    ("parents", ["amaze", "dzire", "aspire", "xcent", "yaris", "baleno", "i20", "tiago", "venue", "nexon"], 10, "strong parents-friendly model match"),
    ("premium", ["compass", "hector", "harrier", "seltos", "creta", "xuv500", "xuv700", "tucson", "kodiaq", "zs ev", "hexa", "octavia", "passat", "a3", "civic"], 18, "strong premium model match"),
    ("premium", ["brezza", "wr-v", "terrano", "duster", "ecosport", "kwid", "alto", "s-presso", "redi-go", "redi go"], -14, "penalized as less premium for this query"),
]

# Labels of columns in reasons.
LABELS = {
    "Transmission_Automatic": "automatic transmission",
    "Transmission_Manual": "manual transmission",
    "Body_Type_SUV": "SUV body type",
    "Body_Type_Sedan": "sedan body type",
    "Body_Type_Hatchback": "hatchback body type",
    "ARAI_Certified_Mileage": "good mileage",
    "Ex-Showroom_Price": "within budget",
    "Fuel_Type_Diesel": "diesel fuel preference",
    "Fuel_Type_Petrol": "petrol fuel preference",
    "ABS_(Anti-lock_Braking_System)": "ABS safety feature",
    "Android_Auto": "Android Auto",
    "Apple_CarPlay": "Apple CarPlay",
    "Cruise_Control": "cruise control",
}

Rule = tuple[Column, float, str | Column]


def points(rules: list[Rule]) -> Column:
    return sum((F.when(on, float(p)).otherwise(0.0) for on, p, _ in rules), F.lit(0.0))


def reasons(rules: list[Rule]) -> Column:
    """Texts of the rules that hold, in their order; a rule without a text gives none."""
    return F.array_compact(F.array(*(F.when(on, why if isinstance(why, Column) else F.lit(why)) for on, _, why in rules if why is not None)))


def budget(low: Column | None, high: Column | None) -> tuple[Column, Column]:
    """(least, most) of a price request: a pair, or a cap alone."""
    none = F.lit(None).cast("double")
    return (none if low is None else low), (none if high is None else high)


def _number(name: str) -> Column:
    """A number column with null, NaN and infinities as 0."""
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def price_rules(price: Column, cap: Column, use: Column) -> list[Rule]:
    there = F.coalesce((price > 0) & cap.isNotNull(), F.lit(False))
    over = there & (price > cap)
    u = price / cap
    bound = lambda lo, hi: (u >= lo) & (u <= hi) if lo is not None else u < hi
    return [(over, -100, "over budget"), (there & ~over, 0, "within budget"), *((there & ~over & use.isin(*uses) & bound(lo, hi), p, why) for uses, lo, hi, p, why in SPENDING)]


def price_points(price: Column, cap: Column, use: Column) -> Column:
    """40 points at the aimed price, fewer away from it, and the rules on what is spent; -100
    above the cap; 0 without a price above 0 or without a cap."""
    aim = F.coalesce(*(F.when(use == u, s) for u, s in AIMS.items()), F.lit(0.70)) * cap
    near = 40 * F.greatest(F.lit(0.0), 1 - F.abs(price - aim) / F.greatest(cap, F.lit(1.0)))
    return points(price_rules(price, cap, use)) + F.when((price > 0) & (price <= cap), near).otherwise(0.0)


def mileage_points(mileage: Column, use: Column, asked: Column) -> Column:
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    daily = F.when(use.isin("city", "commute", "family", "student", "budget"), clip((mileage - 12) / 12.0) * 5).otherwise(0.0)
    return F.when(mileage > 0, clip((mileage - 10) / 15.0) * 12 + F.when(asked, 6.0).otherwise(0.0) + daily).otherwise(0.0)


def mileage_rules(mileage: Column, asked: Column) -> list[Rule]:
    return [(mileage >= 18, 0, "good mileage"), ((mileage > 0) & asked, 0, "matches mileage preference")]


def feature_rules() -> list[Rule]:
    """Requested features (``asked_<feature>``) that a row has or lacks."""
    out: list[Rule] = []
    for name, hit, miss, label in FEATURES:
        have, want = F.coalesce(F.col(name), F.lit(False)), F.coalesce(F.col(f"asked_{name}"), F.lit(False))
        out += [(want & have, hit, f"has {label}"), (want & ~have, miss, f"missing requested {label}")]
    return out


def match_rules(have: Column, want: Column, hit: float, miss: float, good: str | Column, bad: str | Column) -> list[Rule]:
    """Points for an asked value; nothing asked, no rule holds."""
    same = F.coalesce(have == want, F.lit(False))
    return [(want.isNotNull() & same, hit, good), (want.isNotNull() & ~same, miss, bad)]


def match_points(have: Column, want: Column, hit: float = 12.0, miss: float = -8.0) -> Column:
    return points(match_rules(have, want, hit, miss, "", ""))


def request_rules() -> list[Rule]:
    """Fuel, body and transmission against ``asked_fuel``, ``asked_body`` and ``asked_transmission``."""
    fuel, body, gear = F.col("asked_fuel"), F.col("asked_body"), F.col("asked_transmission")
    out = match_rules(F.col("fuel"), fuel, 12, -8, F.concat(F.lit("matches requested "), fuel, F.lit(" fuel")), F.concat(F.lit("does not match requested "), fuel, F.lit(" fuel")))
    out += match_rules(F.col("body"), body, 12, -8, "matches requested body type", "does not match requested body type")
    for kind, hit, miss in (("automatic", 10, -8), ("manual", 8, -6)):
        out += match_rules(F.col("transmission"), F.when(gear == kind, gear), hit, miss, f"matches {kind} preference", f"does not match {kind} preference")
    return out


def _named(parts: list[str]) -> Column:
    """Whether the model's name holds one of some parts."""
    name = F.lower(F.coalesce("model", F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def use_rules(use: Column) -> list[Rule]:
    """The rules of the use cases; a use case's list of small models comes after its others."""
    out: list[Rule] = []
    for u in dict.fromkeys(u for uses, *_ in USE_RULES for u in uses):
        out += [(F.coalesce((use == u) & F.expr(when), F.lit(False)), p, why) for uses, when, p, why in USE_RULES if u in uses]
        if u in TOO_SMALL:
            p, why = TOO_SMALL_POINTS[u]
            out.append(((use == u) & _named(TOO_SMALL[u]), p, why))
    return out


def quality_rules(use: Column) -> list[Rule]:
    """Marks of makes and models, and the use cases' curated models."""
    make = F.lower(F.coalesce("make", F.lit("")))
    out: list[Rule] = [(make.isin(OLD_MAKES), -18, "penalized low-confidence/older make"), (_named(OLD_MODELS), -18, "penalized outdated/basic model")]
    return out + [((use == u) & _named(parts), p, why) for u, parts, p, why in CURATED]


def explicit_rules(asked: dict[str, float], columns: list[str]) -> list[Rule]:
    """5 points for each asked column that exists, is none of the excluded ones and has the asked number."""
    # Columns with rules of their own.
    excluded = ["Ex-Showroom_Price", "ARAI_Certified_Mileage", "Displacement", "Power", "Torque", "Body_Type"]
    return [(_number(f"`{c}`") == float(v), 5, f"matches {c}") for c, v in asked.items() if c in columns and c not in excluded]


def label(column: str) -> str:
    """The text for a column in reasons."""
    for kind, what in (("Body_Type_", "body type"), ("Fuel_Type_", "fuel preference")):
        if column.startswith(kind) and column not in LABELS:
            return f"{column.removeprefix(kind).lower()} {what}"
    return LABELS.get(column, column.replace("_", " ").strip())


def cleaned_reasons(texts: Column, body: Column, columns: list[str] = (), most: int = 5) -> Column:
    """Reasons renamed for readers, without blanks and repeats (by lower case), cut to ``most``.

    ``body``: the label of the asked body type, or null; ``columns``: names that may stand
    after ``matches``.
    """
    names = {f"matches {c}": label(c) for c in [*columns, *LABELS]}

    def renamed(x: Column) -> Column:
        t = F.trim(x)
        out = F.when(t == "matches requested body type", F.coalesce(body, F.lit("requested body type"))).when(t == "matches automatic preference", "automatic transmission")
        out = out.when(t == "matches manual preference", "manual transmission").when(t == "matches mileage preference", "good mileage")
        out = out.when(t.startswith("matches requested ") & t.endswith(" fuel"), F.concat(F.regexp_extract(t, "^matches requested (.*) fuel$", 1), F.lit(" fuel preference")))
        for text, name in names.items():
            out = out.when(t == text, name)
        return out.when(t.startswith("matches "), F.trim(F.translate(F.substring(t, 9, 1 << 20), "_", " "))).otherwise(t)

    held = F.filter(F.transform(texts, renamed), lambda t: t.isNotNull() & (t != ""))
    once = F.aggregate(held, F.array().cast("array<string>"), lambda seen, t: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.concat(seen, F.array(t))))
    return F.slice(once, 1, most)


def asked_rules(asked: str, columns: list[str]) -> list[Rule]:
    """:func:`explicit_rules` of requests that each bring a map from columns to numbers, ``asked``."""
    out: list[Rule] = []
    for c in columns:
        out += [(F.coalesce(_number(f"`{c}`") == F.try_element_at(F.col(asked), F.lit(c)), F.lit(False)), p, why) for _, p, why in explicit_rules({c: 0.0}, columns)]
    return out


def _components(rows: DataFrame, asked: str | None) -> tuple[Column, list[Rule]]:
    """(score, all rules in the order of their reasons)."""
    use = F.coalesce("use", F.lit("general"))
    price, mileage, cap = _number("price"), _number("mileage"), F.col("cap").cast("double")
    wanted = F.coalesce("asked_mileage", F.lit(False))
    numbers = [n for n, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and not n.startswith("asked_") and n not in ("cap", "score")]
    explicit = asked_rules(asked, numbers) if asked else []
    parts = [price_rules(price, cap, use), mileage_rules(mileage, wanted), feature_rules(), request_rules(), use_rules(use), explicit, quality_rules(use)]
    total = price_points(price, cap, use) + mileage_points(mileage, use, wanted) + points([r for p in parts[2:] for r in p])
    return F.round(total, 6), [r for p in parts for r in p]


def scored(rows: DataFrame, asked: str | None = None) -> DataFrame:
    """``rows`` (catalog and request columns side by side) with ``score`` and all ``reasons``, component by component.

    ``asked``: a map column of the request, from number columns of the catalog to the numbers
    that it asks for, if there is one.
    """
    score, every = _components(rows, asked)
    return rows.withColumn("score", score).withColumn("reasons", reasons(every))


def top_scored(rows: DataFrame, by: list[str], tie: str, most: int, asked: str | None = None) -> DataFrame:
    """The first ``most`` rows of each request with ``score``, ``rk`` and ``reasons``.

    Rows are ranked by score alone, and each task keeps ``most`` of a request before any row
    moves; texts are made for those that stay.
    """
    score, every = _components(rows, asked)
    return ranked(rows.withColumn("score", score), by, tie).where(F.col("rk") <= most).withColumn("reasons", reasons(every))


def first_positive(columns: dict[str, str], present: list[str], otherwise: str = "unknown") -> Column:
    """The first value whose column is there and above 0 (a one-hot family in its order)."""
    found = [F.when(_number(f"`{c}`") > 0, v) for v, c in columns.items() if c in present]
    return F.coalesce(*found, F.lit(otherwise))


def last_positive(prefix: str, present: list[str], otherwise: str = "Not specified") -> Column:
    """The title of the last column of a one-hot family that equals 1."""
    found = [F.when(_number(f"`{c}`") == 1, c.removeprefix(prefix).replace("_", " ").title()) for c in reversed(present) if c.startswith(prefix)]
    return F.coalesce(*found, F.lit(otherwise))


def squashed_name(name: str) -> str:
    return name.lower().translate(str.maketrans("", "", "_- ()/"))


def any_positive(present: list[str], parts: list[str]) -> Column:
    """Whether a column whose squashed name holds one of some parts is above 0."""
    out = F.lit(False)
    for c in present:
        if any(p in squashed_name(c) for p in parts):
            out = out | (F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) > 0)
    return out


def ranked(rows: DataFrame, by: list[str], tie: str) -> DataFrame:
    """``rk`` from 1 within ``by``: score descending, ties to the smaller key."""
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tie)))


def diversified(rows: DataFrame, make: str, model: str, tie: str, head: int = 20, per_make: int = 2, middle: int = 10, last: int = 4) -> DataFrame:
    """The first ``head`` by score, at most ``per_make`` of a make, ``middle`` of them, then the
    best of each model and the first ``last``."""
    order = [F.desc("score"), F.col(tie)]
    top = rows.orderBy(*order).limit(head)
    some = top.withColumn("n", F.row_number().over(Window.partitionBy(make).orderBy(*order))).where(F.col("n") <= per_make).drop("n")
    some = some.orderBy(*order).limit(middle)
    one = some.withColumn("n", F.row_number().over(Window.partitionBy(model).orderBy(*order))).where("n = 1").drop("n")
    return one.orderBy(*order).limit(last)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The dot product of the vectors at unit length; null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def blended(rank: Column, similarity: Column, weight: float = 0.15) -> Column:
    """Rule score and cosine, the cosine moved to 0..100; the rule score alone where there is no cosine."""
    w = min(1.0, max(0.0, weight))
    return F.coalesce((1 - w) * rank + w * 50 * (similarity + 1), rank)


def reranked(rows: DataFrame, similarity: Column, tie: str, n: int, weight: float = 0.15) -> DataFrame:
    """The first ``n`` rows by ``blended`` of score and similarity."""
    return rows.withColumn("blended", blended(F.col("score"), similarity, weight)).orderBy(F.desc("blended"), tie).limit(n)
