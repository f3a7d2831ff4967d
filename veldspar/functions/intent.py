"""Intent of many request texts at once: typed filters as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of each body, first match wins.
BODIES = [("suv", ["suv"]), ("sedan", ["sedan"]), ("hatchback", ["hatchback"]), ("mpv", ["mpv"]), ("muv", ["muv"]), ("coupe", ["coupe"]), ("convertible", ["convertible"]), ("pickup", ["pickup", "pick-up"]), ("wagon", ["wagon"]), ("crossover", ["crossover"]), ("sports", ["sports car", "sporty car"])]
# Words of each fuel, first match wins.
FUELS = [("diesel", ["diesel"]), ("petrol", ["petrol", "gasoline"]), ("cng", ["cng"]), ("electric", ["electric", "ev"]), ("hybrid", ["hybrid"])]
# Parts of texts of each use case, first match wins.
USES = [
    ("premium", ["premium", "luxury", "luxurious"]),
    ("family", ["family", "families"]),
    ("parents", ["parents", "elderly", "senior"]),
    ("highway", ["highway", "long drive", "road trip", "touring"]),
    ("student", ["student", "college"]),
    ("budget", ["budget", "cheap", "affordable", "low cost"]),
    ("city", ["city", "traffic", "commute", "daily use"]),
    ("enthusiast", ["enthusiast", "performance", "sporty", "fun to drive"]),
]
# Words of each feature.
FEATURES = [
    ("sunroof", ["sunroof", "sun roof", "panoramic roof", "moonroof", "moon roof"]),
    ("ventilated_seats", ["ventilated seat", "ventilated seats", "ventilated front seats", "seat ventilation", "cooled seat", "cooled seats", "cooling seats"]),
    ("airbags", ["airbag", "airbags"]),
    ("abs", ["abs", "anti-lock", "anti lock"]),
    ("cruise_control", ["cruise control"]),
    ("android_auto", ["android auto"]),
    ("apple_carplay", ["carplay"]),
]
# Words and names of makes.
MAKES = [
    ("tata", "Tata"), ("datsun", "Datsun"), ("renault", "Renault"), ("maruti", "Maruti Suzuki"), ("suzuki", "Maruti Suzuki"), ("hyundai", "Hyundai"), ("toyota", "Toyota"), ("nissan", "Nissan"),
    ("volkswagen", "Volkswagen"), ("ford", "Ford"), ("mahindra", "Mahindra"), ("fiat", "Fiat"), ("honda", "Honda"), ("skoda", "Skoda"), ("jeep", "Jeep"), ("mg", "Mg"), ("kia", "Kia"), ("volvo", "Volvo"),
    ("bmw", "Bmw"), ("audi", "Audi"), ("land rover", "Land Rover"), ("lexus", "Lexus"), ("jaguar", "Jaguar"), ("porsche", "Porsche"), ("maserati", "Maserati"), ("lamborghini", "Lamborghini"),
    ("bentley", "Bentley"), ("ferrari", "Ferrari"), ("aston martin", "Aston Martin"), ("isuzu", "Isuzu"),
]
# Words of an automatic transmission.
AUTOMATIC = ["automatic", "amt", "cvt", "dct", "auto"]
# Every word of the tables that counts as a whole one.
_WORDS = list(dict.fromkeys([w for _, ws in [*BODIES, *FUELS, *FEATURES] for w in ws] + [w for w, _ in MAKES] + [*AUTOMATIC, "manual"]))
# Words before a price or mileage.
MOST_WORDS = ["under", "below", "less than", "max", "maximum", "upto", "up to"]
LEAST_WORDS = ["above", "over", "more than", "min", "minimum"]
# Column names of bodies and features in filter maps.
BODY_COLUMNS = {"suv": "Body_Type_SUV", "sedan": "Body_Type_Sedan", "hatchback": "Body_Type_Hatchback", "mpv": "Body_Type_MPV", "muv": "Body_Type_MUV", "coupe": "Body_Type_Coupe", "convertible": "Body_Type_Convertible", "pickup": "Body_Type_Pick-up", "wagon": "Body_Type_Wagon", "crossover": "Body_Type_Crossover", "sports": "Body_Type_Sports"}
FEATURE_COLUMNS = {"sunroof": "Sunroof", "ventilated_seats": "Ventilated_Seats", "airbags": "Airbags", "abs": "ABS_(Anti-lock_Braking_System)", "cruise_control": "Cruise_Control", "android_auto": "Android_Auto", "apple_carplay": "Apple_CarPlay"}
_UNIT = r"\s*(lakhs|lakh|crore|cr)?"
_OTHER = r"(?![0-9])(?!\s*(?:kmpl|seater|-seater|km\b))"  # after a number that may be a price
_SECOND = r"to\s*([0-9]+)"  # the second number of a range
_SEATER = r"([0-9]+)[- ]?seater"
_KM_SPAN, _KM_LEAST = r"([0-9]+)\s*to\s*([0-9]+)\s*kmpl", r"(?:above|more than|at least|min|minimum)\s*([0-9]+)\s*kmpl"
_KM_MOST = r"(?:under|below|less than|max|maximum)\s*([0-9]+)\s*kmpl"


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def _word(words: list[str]) -> str:
    return rf"(?<![a-z0-9_])({_any(words)})(?![a-z0-9_])"  # [^a-z0-9_] takes Java's patterns ten times as long


def _part(q: Column, words: list[str]) -> Column:
    """Whether a text has one of some words, as parts of words too."""
    return reduce(or_, (q.contains(w) for w in words if not any(v in w for v in words if v != w)))


def _whole(q: Column, words: list[str]) -> Column:
    """Whether a text has one of some words as whole ones; the pattern is tried on texts that have it as a part."""
    return _part(q, words) & q.rlike(_word(words))


def _first(q: Column, classes: list[tuple[str, list[str]]], has: Callable[[Column, list[str]], Column] = _whole) -> Column:
    return F.coalesce(*(F.when(has(q, words), name) for name, words in classes))


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _heads(words: list[str]) -> list[str]:
    """First words of words and phrases, each once."""
    return list(dict.fromkeys(re.split(r"\W", w)[0] for w in words))


def _heads_in(q: Column) -> Column:
    """First words of ``_WORDS`` that a lower-case text has as whole ones, in their order; none of a
    null text.  The text is cut into words once, and they are looked up together."""
    return F.array_intersect(_texts(_heads(_WORDS)), F.split(F.coalesce(q, F.lit("")), r"\W+"))


def _phrase(words: str) -> str:
    """The pattern of ``_word`` for one phrase; a literal at its begin is found faster."""
    said = _any([words])
    return f"{said}(?<![a-z0-9_]{said})(?![a-z0-9_])"


def _said_in(q: Column, heads: Column) -> Column:
    """Those ``heads`` (of :func:`_heads_in`) that are words of ``_WORDS``, or that their phrases follow: ``land`` of ``land rover``."""
    phrases = {h: [w for w in _WORDS if _heads([w]) == [h]] for h in _heads([w for w in _WORDS if re.search(r"\W", w)])}
    absent = [F.when(F.array_contains(heads, h) & ~reduce(or_, (q.rlike(_phrase(w)) for w in words)), h) for h, words in phrases.items()]
    return F.array_except(heads, F.array(*absent))


def _one_said(said: Column, words: list[str]) -> Column:
    """Whether ``said`` (of :func:`_said_in`) has one of some words."""
    return reduce(or_, (F.array_contains(said, h) for h in _heads(words)))


def _extracted(q: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))


def _rupees(q: Column, pattern: str, number: int, unit: int) -> Column:
    scale = F.when(F.coalesce(_extracted(q, pattern, unit), F.lit("")).isin("cr", "crore"), 10_000_000).otherwise(100_000)
    return F.try_multiply(_extracted(q, pattern, number).try_cast("bigint"), scale)  # null beyond a long


def price_patterns(compat: bool = True) -> dict[str, tuple[list[str], str]]:
    """(words of which a text has one, pattern) of a range, a cap and a floor of prices.
    Unless ``compat``, numbers of kmpl, seats and km are no prices."""
    other = "" if compat else _OTHER
    return {
        "span": (["to"], rf"([0-9]+)\s*to\s*([0-9]+){other}{_UNIT}"),
        "cap": (MOST_WORDS, rf"(?:{_any(MOST_WORDS)})\s*([0-9]+){other}{_UNIT}"),
        "floor": (LEAST_WORDS, rf"(?:{_any(LEAST_WORDS)})\s*([0-9]+){other}{_UNIT}"),
    }


# (words of which a text has one, pattern) of seats and mileages.
_PATTERNS = {"seater": (["seater"], _SEATER), "km_span": (["kmpl"], _KM_SPAN), "km_least": (["kmpl"], _KM_LEAST), "km_most": (["kmpl"], _KM_MOST)}


def matches(q: Column, patterns: dict[str, tuple[list[str], str]]) -> dict[str, Column]:
    """The part of a lower-case text that each pattern matches, null or empty if none."""
    return {name: F.when(_part(q, words), F.regexp_extract(q, pattern, 0)) for name, (words, pattern) in patterns.items()}


def _number(match: Column, kind: str, pattern: str = "([0-9]+)") -> Column:
    return F.regexp_extract(match, pattern, 1).try_cast(kind)


def _price(match: Column, pattern: str = "([0-9]+)") -> Column:
    scale = F.when(match.endswith("cr") | match.endswith("crore"), 10_000_000).otherwise(100_000)
    return F.try_multiply(_number(match, "bigint", pattern), scale)  # null beyond a long


def price_bounds(found: dict[str, Column]) -> tuple[Column, Column]:
    """(least, most) rupees of the :func:`matches` of :func:`price_patterns`: a range, else a cap,
    else a floor; lakh where no unit is given."""
    ranged, capped = (F.coalesce(found[n] != "", F.lit(False)) for n in ("span", "cap"))
    low = F.when(ranged, _price(found["span"])).when(~capped, _price(found["floor"]))
    return low, F.when(ranged, _price(found["span"], _SECOND)).otherwise(_price(found["cap"]))


def seats(q: Column, found: Column) -> Column:
    return F.coalesce(_number(found, "int"), F.when(_part(q, ["large family", "big family"]), 7))


def transmission(said: Column) -> Column:
    auto, manual = _one_said(said, AUTOMATIC), _one_said(said, ["manual"])
    return F.when(auto & ~manual, "automatic").when(manual & ~auto, "manual")


def makes(said: Column) -> Column:
    """Named makes in the order of the table, each once."""
    return F.array_except(F.array(*(F.when(_one_said(said, [w]), name) for w, name in MAKES)), F.array(F.lit(None).cast("string")))


def mileage_bounds(q: Column, found: dict[str, Column]) -> tuple[Column, Column]:
    """(least, most) km/l of the :func:`matches` of ``_PATTERNS``: a range, else a least, else a most, else 18 for vague praise; null is open."""
    a, b = _number(found["km_span"], "double"), _number(found["km_span"], "double", _SECOND)
    c, d = (_number(found[n], "double") for n in ("km_least", "km_most"))
    vague = _part(q, ["good mileage", "fuel efficient", "high mileage"])
    low = F.when(a.isNotNull(), a).when(c.isNotNull(), c).when(d.isNotNull(), 0.0).when(vague, 18.0)
    return low, F.when(a.isNotNull(), b).when(c.isNull(), d)


def parsed(requests: DataFrame, text: str = "query", compat: bool = True, model: dict[str, str] | None = None) -> DataFrame:
    """``requests`` with one column for each part of the intent; a null text has none.

    ``model``: columns with a trained classifier's labels of body_type, fuel_type,
    transmission and use_case, which count where no word decides.
    """
    model, patterns = model or {}, price_patterns(compat) | _PATTERNS
    # What many parts read is a column, so that it is made once a row.
    q, heads, said_ = F.col("intent: text"), F.col("intent: heads"), F.col("intent: said")
    found = {n: F.col(f"intent: {n}") for n in patterns}
    rows = requests.select("*", F.lower(F.col(text)).alias("intent: text"))
    rows = rows.select("*", _heads_in(q).alias("intent: heads"), *(c.alias(f"intent: {n}") for n, c in matches(q, patterns).items()))
    rows = rows.select("*", _said_in(q, heads).alias("intent: said"))
    low, high = price_bounds(found)
    m_low, m_high = mileage_bounds(q, found)
    has = lambda _, words: _one_said(said_, words)
    said = {"body_type": _first(q, BODIES, has), "fuel_type": _first(q, FUELS, has), "transmission": transmission(said_), "use_case": _first(q, USES, _part)}
    said = {k: F.coalesce(v, F.col(model[k])) if k in model else v for k, v in said.items()}
    out = rows.select(
        "*",
        low.alias("price_min"),
        high.alias("price_max"),
        seats(q, found["seater"]).alias("seats"),
        *(said[k].alias(k) for k in ("body_type", "fuel_type", "transmission")),
        F.coalesce(said["use_case"], F.lit("general")).alias("use_case"),
        m_low.alias("mileage_min"),
        m_high.alias("mileage_max"),
        makes(said_).alias("makes"),
        F.array_compact(F.array(*(F.when(_one_said(said_, words), n) for n, words in FEATURES))).alias("features"),
    )
    return out.drop(*(c for c in out.columns if c.startswith("intent: ")))


def filter_map(intents: DataFrame) -> DataFrame:
    """``intents`` (of :func:`parsed`) with ``filters``, a map from filter names to texts: numbers, ``low..high`` or names joined by bars."""
    text = lambda c: c.cast("string")
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "unknown")
    low, high = F.col("price_min"), F.col("price_max")
    body = F.coalesce(*(F.when(F.col("body_type") == k, v) for k, v in BODY_COLUMNS.items()))
    pairs = [
        ("Ex-Showroom_Price", F.when(low.isNotNull() & high.isNotNull(), F.concat(text(low), F.lit(".."), text(high))).otherwise(text(high))),
        ("price_min_only", F.when(high.isNull(), text(low))),
        ("Make", F.when(F.size("makes") > 0, F.array_join("makes", "|"))),
        ("Body_Type", F.when(known("body_type"), body)),
        *((f"Transmission_{k.title()}", F.when(F.col("transmission") == k, "1")) for k in ("automatic", "manual")),
        ("Seating_Capacity", text(F.col("seats"))),
        ("ARAI_Certified_Mileage", F.when(F.col("mileage_min").isNotNull(), F.concat(text(F.col("mileage_min")), F.lit(".."), F.coalesce(text(F.col("mileage_max")), F.lit(""))))),
        *((f"Fuel_Type_{'CNG' if k == 'cng' else k.title()}", F.when(F.col("fuel_type") == k, "1")) for k, _ in FUELS),
        *((c, F.when(F.array_contains("features", k), "1")) for k, c in FEATURE_COLUMNS.items()),
    ]
    held = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(n).alias("k"), v.alias("v"))) for n, v in pairs)))
    return intents.withColumn("filters", F.map_from_entries(held))


# Makes that the plain parser finds as parts of a text.
PLAIN_MAKES = ["Tata", "Datsun", "Renault", "Maruti Suzuki", "Hyundai", "Premier", "Toyota", "Nissan", "Volkswagen", "Ford", "Mahindra", "Fiat", "Honda", "Force", "Skoda", "Jeep", "Mg", "Kia", "Mitsubishi", "Volvo", "Unknown", "Mini", "Bmw", "Audi", "Land Rover Rover", "Lexus", "Jaguar", "Porsche", "Land Rover", "Maserati", "Lamborghini", "Bentley", "Ferrari", "Aston Martin", "Bajaj", "Icml", "Isuzu", "Maruti Suzuki R", "Dc"]
PLAIN_BODIES = ["suv", "sedan", "hatchback", "mpv", "muv", "coupe", "convertible", "pickup", "wagon", "crossover", "sports"]
# Words of the plain parser's features; a number after the word is its value.
PLAIN_FEATURES = {
    "Cruise_Control": ["cruise control"], "ABS_(Anti-lock_Braking_System)": ["abs", "anti-lock braking system"], "Airbags": ["airbags", "safety airbags"], "Sunroof": ["sunroof", "panoramic roof"],
    "Android_Auto": ["android auto"], "Apple_CarPlay": ["apple carplay"], "Engine_CC": ["cc", "engine capacity"], "Torque": ["torque"], "Horsepower": ["bhp", "horsepower"],
}
PLAIN_TEXTS = {"Fuel_Type": ["petrol", "diesel", "cng", "electric"], "Drivetrain": ["fwd", "rwd", "awd", "4wd"]}


def plain(requests: DataFrame, text: str = "query") -> DataFrame:
    """The fallback parser, without a model: any number may be a budget.

    Adds price_min, price_max, seats, transmission, body_type, makes, mileage_min,
    mileage_max, and ``features``, a map from names to texts.
    """
    q = F.lower(F.col(text))
    unit = r"\s*(lakh|crore|cr)?"
    span, cap, any_ = rf"([0-9]+)\s*to\s*([0-9]+){unit}", rf"under ([0-9]+){unit}", rf"([0-9]+){unit}"
    ranged, capped = _extracted(q, span, 1).isNotNull(), _extracted(q, cap, 1).isNotNull()
    high = F.when(ranged, _rupees(q, span, 2, 3)).when(capped, _rupees(q, cap, 1, 2)).otherwise(_rupees(q, any_, 1, 2))
    auto, manual = q.contains("automatic"), q.contains("manual")
    km = r"(at least|above|more than|under|below|less than)?\s*([0-9]+)\s*kmpl"
    km_span = r"([0-9]+)\s*to\s*([0-9]+)\s*kmpl"
    both, one, how = _extracted(q, km_span, 1).try_cast("int"), _extracted(q, km, 2).try_cast("int"), F.regexp_extract(q, km, 1)
    less = how.isin("under", "below", "less than")

    def feature(words: list[str]) -> Column:  # the last word that is there decides
        found = [F.coalesce(_extracted(q, rf"(?:^|[^a-z0-9_]){re.escape(w)}\s*([0-9]+)(?:$|[^a-z0-9_])", 1), F.when(q.rlike(_word([w])), "1")) for w in reversed(words)]
        return F.coalesce(*found)

    entries = [(n, feature(w)) for n, w in PLAIN_FEATURES.items()] + [(n, F.coalesce(*(F.when(q.rlike(_word([w])), w.upper()) for w in reversed(ws)))) for n, ws in PLAIN_TEXTS.items()]
    held = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(n).alias("k"), v.alias("v"))) for n, v in entries)))
    return requests.select(
        "*",
        F.when(ranged, _rupees(q, span, 1, 3)).alias("price_min"),
        high.alias("price_max"),
        _extracted(q, r"([0-9]+)[- ]?seater", 1).try_cast("int").alias("seats"),
        F.when(auto & ~manual, "automatic").when(manual & ~auto, "manual").alias("transmission"),
        _first(q, [(b, [b]) for b in PLAIN_BODIES]).alias("body_type"),
        F.array_compact(F.array(*(F.when(q.contains(m.lower()), m) for m in PLAIN_MAKES))).alias("makes"),
        F.when(both.isNotNull(), both).when(one.isNotNull(), F.when(less, 0).otherwise(one)).alias("mileage_min"),
        F.when(both.isNotNull(), _extracted(q, km_span, 2).try_cast("int")).when(less, one).alias("mileage_max"),
        F.map_from_entries(held).alias("features"),
    )


# Words of requests for used vehicles, first match wins.
USED_CITIES = ["hyderabad", "mumbai", "delhi", "bangalore", "chennai", "pune", "kolkata"]
USED_FUELS = ["petrol", "diesel", "cng", "electric"]
USED_BODIES = ["suv", "sedan", "hatchback", "mpv"]
USED_MAKES = ["tata", "maruti", "suzuki", "hyundai", "honda", "mahindra", "toyota", "ford", "renault", "kia", "volkswagen", "nissan", "jeep", "mg", "skoda", "audi", "bmw", "ford", "datsun", "chevrolet", "volvo", "mercedes-benz", "porsche", "jaguar", "byd"]


def used(requests: DataFrame, text: str = "query") -> DataFrame:
    """Requests for used vehicles: price_min, price_max, city, fuel_type, body_type, transmission, makes, year_min and km_max; words count as parts of the text."""
    q = F.lower(F.col(text))
    span, cap = r"([0-9]+)\s*to\s*([0-9]+)\s*(lakh|crore|cr)?", r"under ([0-9]+)\s*(lakh|crore|cr)?"
    km = r"(?:under|less than|below)?\s*([0-9]+)(k)?\s*(?:km|kms|kilometers)"
    part = lambda words: F.coalesce(*(F.when(q.contains(w), w) for w in words))
    return requests.select(
        "*",
        _rupees(q, span, 1, 3).alias("price_min"),
        F.coalesce(_rupees(q, span, 2, 3), _rupees(q, cap, 1, 2)).alias("price_max"),
        part(USED_CITIES).alias("city"),
        part(USED_FUELS).alias("fuel_type"),
        part(USED_BODIES).alias("body_type"),
        part(["automatic", "manual"]).alias("transmission"),
        F.array_compact(F.array(*(F.when(q.contains(m), m) for m in USED_MAKES))).alias("makes"),
        _extracted(q, r"(20[0-2][0-9])", 1).try_cast("int").alias("year_min"),
        F.try_multiply(_extracted(q, km, 1).try_cast("bigint"), F.when(_extracted(q, km, 2).isNotNull(), 1000).otherwise(1)).alias("km_max"),
    )
