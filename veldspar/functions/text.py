"""Text, number and unit normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return _or_null(F.regexp_extract(c, pattern, group))


def squashed(c: Column) -> Column:
    """Lower case without ``_ - space ( ) /``."""
    return F.translate(F.lower(c), "_- ()/", "")


def label(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def variant_text(c: Column) -> Column:
    """Lower case, a plus sign as the word, brackets, commas, dots, slashes, underscores and
    dashes as spaces, runs of blanks as one; null is empty."""
    t = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[()\[\],./_-]+", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    """Lower case with a dash for every space; null is ``unknown``."""
    return F.coalesce(F.replace(F.lower(c), F.lit(" "), F.lit("-")), F.lit("unknown"))


def token_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")


# Words that do not tell variants apart.
VARIANT_DROP = ["petrol", "diesel", "cng", "ev", "electric", "manual", "automatic", "amt", "dct", "cvt", "tc", "speed", "turbo", "dual", "tone", "dark", "red", "knight", "edition", "1", "2l", "5l", "15l", "12l"]
# Phrases of special editions.
SPECIAL_EDITIONS = ["dual tone", "dark", "red dark", "knight", "n line", "sport", "performance"]


def base_tokens(c: Column, dropped: list[str] = VARIANT_DROP) -> Column:
    """Sorted tokens of a variant without the dropped words and numbers."""
    return F.array_sort(F.filter(token_set(variant_text(c)), lambda t: ~t.isin(dropped) & ~t.rlike("^[0-9]+$")))


def special_editions(c: Column) -> Column:
    """The special-edition phrases in a variant's text, in their order."""
    t = variant_text(c)
    return F.array_compact(F.array(*(F.when(t.contains(p), p) for p in SPECIAL_EDITIONS)))


# Kinds of transmission and the words that tell them, first match wins.
TRANSMISSIONS = [("amt", ["amt", "automated manual"]), ("dct", ["dct"]), ("cvt", ["cvt"]), ("tc", ["tc", "torque converter"]), ("manual", ["manual", "mt"]), ("automatic", ["automatic", "at"])]


def has_word(t: Column, words: list[str]) -> Column:
    """Whether one of some words or phrases stands between other characters than letters, digits and underscores."""
    return t.rlike(rf"(^|[^a-z0-9_])({'|'.join(words)})($|[^a-z0-9_])")


def transmission_family(c: Column) -> Column:
    """The first kind whose word is in the text, else the text, else ``unknown``."""
    t = variant_text(c)
    found = [F.when(has_word(t, words), kind) for kind, words in TRANSMISSIONS]
    return F.coalesce(*found, _or_null(t), F.lit("unknown"))


def transmission_label(c: Column) -> Column:
    """``Manual`` for texts that say so and not automatic; other texts trimmed."""
    t = F.lower(c)
    return _or_null(F.when(t.contains("manual") & ~t.contains("automatic"), "Manual").otherwise(F.trim(c)))


def number(c: Column) -> Column:
    """The first signed decimal in a text, thousands commas left out."""
    return _found(F.replace(c, F.lit(","), F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?)").cast("double")


def first_int(c: Column) -> Column:
    """The first number without its decimals; null where it fits no long."""
    return number(c).try_cast("bigint")


def finite(c: Column) -> Column:
    """A double with NaN and infinities as null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def safe_number(c: Column, default: float = 0.0) -> Column:
    """A text or number as double; what is none, NaN or infinite is the default."""
    return F.coalesce(finite(c.try_cast("double")), F.lit(default))


def price(c: Column) -> Column:
    """Rupees from a text like ``12.5 lakh`` or ``1,20,000``; null beyond a long."""
    t = F.lower(F.replace(c, F.lit(","), F.lit("")))
    unit = F.when(t.contains("crore"), 1e7).when(t.rlike("lakh|lac"), 1e5).otherwise(1.0)
    return F.round(_found(t, r"([0-9]+(?:\.[0-9]+)?)").cast("double") * unit).try_cast("bigint")


# Units of other quantities than displacement.
NO_DISPLACEMENT = ["bhp", "kw", "nm", "rpm", "ps"]


def engine_cc(c: Column) -> Column:
    """Displacement in cc: the 3 or 4 digits before cc or cubic centimetres, else the first such
    number; null without a word for displacement, with another unit or out of 600 to 6000."""
    t = F.lower(F.trim(F.replace(c, F.lit(","), F.lit(" "))))
    told = t.rlike(r"(^|[^a-z0-9_])(cc|cubic\s*centimet|displacement|engine\s*capacity)($|[^a-z0-9_])")
    n = F.coalesce(_found(t, r"([0-9]{3,4}(?:\.[0-9]+)?)\s*(?:cc|cubic\s*centimet)"), _found(t, r"([0-9]{3,4}(?:\.[0-9]+)?)"))
    n = F.floor(n.cast("double")).cast("int")
    return F.when(~t.rlike("|".join(NO_DISPLACEMENT)) & told & n.between(600, 6000), n)


# Words of the tri-state flag.
YES = ["yes", "available", "true", "standard", "present"]
NO = ["no", "not available", "false", "none", "not offered"]


def tri_bool(c: Column) -> Column:
    """True, false or null; null is never false."""
    t = F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    no = t.isin(NO) | t.endswith("-no") | t.startswith("no ") | t.startswith("not available")
    return F.when(t.isin(YES), True).when(no, False).when(t.startswith("yes "), True)


def gear_count(c: Column) -> Column:
    """The number before speed, gear or gearbox."""
    return _found(F.lower(c), r"([0-9]+)\s*(?:speed|gears?|gearbox)").try_cast("int")


def dimensions(c: Column) -> Column:
    """The first three numbers of a text as length, width, height, without decimals; missing ones null."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    all_ = F.transform(found, lambda x: x.cast("double").try_cast("bigint"))
    return F.struct(*(F.try_element_at(all_, F.lit(i)).alias(n) for i, n in enumerate(("length", "width", "height"), 1)))


_HOURS, _MINUTES = r"([0-9]+(?:\.[0-9]+)?)\s*h", r"([0-9]+(?:\.[0-9]+)?)\s*m"


def hours(c: Column) -> Column:
    """Charging time in hours: ``7 h 30 min`` is 7.5; else the first number."""
    t = F.lower(c)
    h, m = _found(t, _HOURS).cast("double"), _found(t, _MINUTES).cast("double")
    return F.when(h.isNotNull() | m.isNotNull(), F.round(F.coalesce(h, F.lit(0.0)) + F.coalesce(m, F.lit(0.0)) / 60, 2)).otherwise(number(c))


def minutes(c: Column) -> Column:
    """Charging time in whole minutes; else the first number."""
    t = F.lower(c)
    h, m = F.round(_found(t, _HOURS).cast("double") * 60), F.round(_found(t, _MINUTES).cast("double"))
    both = F.coalesce(h, F.lit(0.0)) + F.coalesce(m, F.lit(0.0))
    return F.when(h.isNotNull() | m.isNotNull(), both.try_cast("bigint")).otherwise(first_int(c))


def warranty(c: Column) -> Column:
    """(years, km) of a warranty text."""
    t = F.lower(F.replace(c, F.lit(","), F.lit("")))
    return F.struct(_found(t, r"([0-9]+)\s*years?").try_cast("int").alias("years"), _found(t, r"([0-9]+)\s*(?:kms?|kilometers?)").try_cast("bigint").alias("km"))


def numbers_conflict(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Apart by more than 2 % of the larger."""
    return (a != b) & (F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def values_agree(a: Column, b: Column) -> Column:
    """Equal texts, or equal numbers after rounding to 2 digits; null agrees with null only."""
    x, y = finite(a.try_cast("double")), finite(b.try_cast("double"))
    return F.when(x.isNotNull() & y.isNotNull(), F.round(x, 2) == F.round(y, 2)).otherwise(a.eqNullSafe(b))


def effective_efficiency(fuel: Column, kmpl: Column, km_per_kg: Column, ev_range: Column) -> Column:
    """km/kg of gas cars, the range of electric ones, else km/l."""
    f = F.lower(F.trim(fuel))
    return F.when(f == "cng", km_per_kg).when(f == "electric", ev_range).otherwise(kmpl)


def cache_key(url: Column) -> Column:
    """A file name: the path's runs of letters and digits joined by underscores, and twelve hex digits of the URL's SHA-256."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*(/[^?#]*)?", 1)
    parts = F.regexp_replace(F.regexp_replace(path, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(parts, F.lit("_"), F.substring(F.sha2(url, 256), 1, 12), F.lit(".html"))


def url_allowed(url: Column, host: str) -> Column:
    """https, exactly this host and a path."""
    return F.coalesce(url.rlike(r"^https://[^/?#]+/") & (F.regexp_extract(url, "^https://([^/?#]*)", 1) == host), F.lit(False))


def link(host: str, make: Column, model: Column, suffix: str = "") -> Column:
    """A page link from the slugs of make and model."""
    return F.concat(F.lit(f"https://{host}/"), slug(make), F.lit("/"), slug(model), F.lit(suffix))


def first_filled(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*(_or_null(F.trim(c)) for c in columns))


def sentence(name: Column, pieces: list[tuple[str, Column]], features: list[tuple[str, Column]]) -> Column:
    """A sentence for a text encoder: the name, then ``<what> <value>`` of filled pieces and the names of true features."""
    told = [F.when(_or_null(F.trim(v.cast("string"))).isNotNull(), F.concat(F.lit(f"{what} "), F.trim(v.cast("string")))) for what, v in pieces]
    has = F.concat_ws(", ", *(F.when(v, n) for n, v in features))
    return F.concat_ws(". ", _or_null(F.trim(name)), *told, F.when(has != "", F.concat(F.lit("features: "), has)))
