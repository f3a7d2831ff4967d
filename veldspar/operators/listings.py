"""Listings of used vehicles: normalisation, relevance tiers, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["title", "price", "km", "fuel", "transmission", "owner", "location", "image_url", "listing_url"]

# Model names of each body; a name between spaces tells the body, first match wins.
BODY_MODELS = {
    "hatchback": ["alto", "alto 800", "wagon r", "swift", "baleno", "i20", "grand i10", "santro", "tiago", "polo", "brio", "kwid", "celerio", "ignis", "figo"],
    "sedan": ["dzire", "amaze", "city", "verna", "vento", "rapid", "ciaz", "corolla", "altis", "civic", "elantra", "sunny", "aspire", "etios", "slavia", "virtus"],
    "suv": ["brezza", "nexon", "creta", "seltos", "venue", "ecosport", "xuv", "harrier", "safari", "hector", "compass", "fortuner", "thar", "scorpio", "duster", "kushaq", "taigun", "sonet", "kiger", "magnite"],
    "muv": ["ertiga", "innova", "carens", "marazzo", "triber", "lodgy"],
}
# Words that mention a transmission or fuel.
AUTOMATIC = ["automatic", "amt", "cvt", "dct", " at "]
MANUAL = ["manual", " mt "]
FUELS = ["petrol", "diesel", "cng", "electric"]


def _any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def normalised(rows: DataFrame, source: str) -> DataFrame:
    """The ten text columns of a listing; what is missing or null is empty."""
    return rows.select(*(F.coalesce(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string"), F.lit("")).alias(c) for c in FIELDS), F.lit(source).alias("source"))


def united(sources: dict[str, DataFrame]) -> DataFrame:
    """The listings of all sources, one after the other."""
    out = None
    for name, rows in sources.items():
        part = normalised(rows, name)
        out = part if out is None else out.unionByName(part)
    return out


def year(title: Column) -> Column:
    """The first word of four digits."""
    return F.try_element_at(F.filter(F.split(title, r"\s+"), lambda w: w.rlike("^[0-9]{4}$")), F.lit(1))


def info_parts(info: Column) -> Column:
    """(km, fuel, location) of a text parted by bars."""
    parts = F.transform(F.split(info, r"\|"), lambda x: F.trim(x))
    return F.struct(*(F.try_element_at(parts, F.lit(i)).alias(n) for i, n in enumerate(("km", "fuel", "location"), 1)))


def body_of(title: Column) -> Column:
    """The body that a title's model name tells; empty if none does."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "))
    return F.coalesce(*(F.when(_any(t, [f" {m} " for m in models]), body) for body, models in BODY_MODELS.items()), F.lit(""))


def image_valid(url: Column) -> Column:
    """A web address that is no data URI, base64 text or placeholder."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return u.startswith("http") & ~u.contains("base64") & ~u.contains("placeholder")


def image(srcset: Column, *others: Column, default: str = "/static/pic.avif") -> Column:
    """The last valid address of a srcset, else the first valid other, else the default."""
    each = F.filter(F.transform(F.split(F.coalesce(srcset, F.lit("")), ","), lambda p: F.split(F.trim(p), " ")[0]), image_valid)
    return F.coalesce(F.try_element_at(each, F.lit(-1)), *(F.when(image_valid(c), F.trim(c)) for c in others), F.lit(default))


def relevant(rows: DataFrame, request: str, place: str, makes: Column, body: Column, transmission: Column, fuel: Column, most: int = 10) -> DataFrame:
    """The first ``most`` listings of each request, with ``tier``: 1 its body, 2 body unknown, 3 all others.

    Listings that lack the makes or contradict transmission, fuel or body are of the third
    tier, which counts only where the others are empty.
    """
    words = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "fuel", "transmission", "location"))))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    bad = (F.size(makes) > 0) & ~F.exists(makes, lambda m: words.contains(F.lower(m)))
    bad = bad | ((transmission == "automatic") & _any(padded, MANUAL)) | ((transmission == "manual") & _any(padded, AUTOMATIC))
    bad = bad | (fuel.isNotNull() & _any(words, FUELS) & ~F.coalesce(words.contains(F.lower(fuel)) & F.lower(fuel).isin(FUELS), F.lit(False)))
    told = body_of(F.col("title"))
    tier = F.when(F.coalesce(bad, F.lit(False)), 3).when(body.isNull() | (told == F.lower(body)), 1).when(told == "", 2).otherwise(3)
    held = rows.withColumn("tier", tier).withColumn("__best", F.min("tier").over(Window.partitionBy(request)))
    held = held.where((F.col("tier") < 3) | (F.col("__best") == 3))
    order = Window.partitionBy(request).orderBy("tier", place)
    return held.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most).drop("__best")
