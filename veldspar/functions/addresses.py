"""Search addresses of listing sites: one encoder of ordered parameters, three dialects of it.

A dialect is a base address, how parameters are begun, written and joined, and an ordered list
of (name, value) expressions; a parameter whose value is null is left out.  Words of a request
are looked up in literal maps with a default for words that a site doesn't know.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that requests have; a request without one has it null.
FILTERS = {"make": "string", "city": "string", "body_type": "string", "fuel_type": "string", "transmission": "string", "price_min": "bigint", "price_max": "bigint", "km_max": "bigint", "year_min": "int", "year_max": "int", "seats": "int"}


@dataclass(frozen=True)
class Dialect:
    """How one site's addresses are written."""

    base: Callable[[dict[str, Column]], Column]
    parameters: Callable[[dict[str, Column]], list[tuple[str, Column]]]
    begin: str = "?"
    joined: str = "&"
    pair: str = "{name}={value}"
    end: str = ""
    codes: dict[str, dict[str, object]] = field(default_factory=dict)


def code_of(word: Column, codes: dict[str, object], default: object | None) -> Column:
    """A word's code by a literal map; the default for unknown words, null for none."""
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    found = F.try_element_at(table, F.lower(word))
    return F.when(word.isNotNull(), found if default is None else F.coalesce(found, F.lit(default)))


def written(parameters: list[tuple[str, Column]], dialect: Dialect) -> Column:
    """The parameters that are there, in their order, with the dialect's marks; empty without any."""
    before, after = dialect.pair.replace("{name}", "\0").split("{value}")
    each = [F.when(v.isNotNull(), F.concat(F.lit(before.replace("\0", n)), v.cast("string"), F.lit(after))) for n, v in parameters]
    told = F.array_join(F.array_compact(F.array(*each)), dialect.joined)
    return F.when(told != "", F.concat(F.lit(dialect.begin), told)).otherwise("")


def _some(c: Column) -> Column:
    """A number that counts: neither null nor 0."""
    return F.nullif(c, F.lit(0))


def _word(c: Column) -> Column:
    return F.url_encode(F.lower(c))


# Bases, parameter names, codes and defaults of the three sites.
CITY, MOST = "hyderabad", 10_000_000


def _path_base(f: dict[str, Column]) -> Column:
    city = _word(F.coalesce(f["city"], F.lit(CITY)))
    return F.concat(F.lit("https://www.cars24.com/buy-used-"), F.coalesce(F.concat(_word(f["make"]), F.lit("-")), F.lit("")), F.lit("cars-"), city, F.lit("/"))


def _path_parameters(f: dict[str, Column]) -> list[tuple[str, Column]]:
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    least, most = _some(f["year_min"]), _some(f["year_max"])
    years = F.when(least.isNotNull() | most.isNotNull(), said("year:bw:", F.coalesce(least, F.lit(2000)), ",", F.coalesce(most, f["this_year"])))
    return [
        ("f", said("bodyType:in:", _word(f["body_type"]))), ("f", said("fuelType:in:", _word(f["fuel_type"]))), ("f", said("transmission:=:", _word(f["transmission"]))),
        ("f", said("listingPrice:bw:", F.coalesce(f["price_min"], F.lit(0)), ",", F.coalesce(f["price_max"], F.lit(MOST)))),
        ("f", said("odometer:bw:0,", f["km_max"])), ("f", years), ("f", said("seatNumber:in:", f["seats"])),
    ]


def _hash_parameters(f: dict[str, Column]) -> list[tuple[str, Column]]:
    low = F.greatest(F.lit(0), F.floor(F.coalesce(f["price_min"], F.lit(0)) / 100_000))
    high = F.greatest(F.lit(1), F.floor(F.coalesce(f["price_max"], F.lit(MOST)) / 100_000))
    codes = CODED.codes
    word = lambda name: F.nullif(f[name], F.lit(""))
    return [
        ("sc", F.lit(1)), ("so", F.lit(-1)), ("city", code_of(F.coalesce(f["city"], F.lit(CITY)), codes["city"], 105)),
        ("budget", F.when(high >= low, F.concat(low.cast("string"), F.lit("-"), high.cast("string")))), ("fuel", code_of(word("fuel_type"), codes["fuel"], 1)), ("trans", code_of(word("transmission"), codes["trans"], 1)),
        ("kms", F.concat(F.floor(_some(f["km_max"]) / 1000).cast("string"), F.lit("-"))), ("bodytype", code_of(word("body_type"), codes["bodytype"], 1)), ("car", code_of(word("make"), codes["car"], 8)),
    ]


def _filter_parameters(f: dict[str, Column]) -> list[tuple[str, Column]]:
    low, high = _some(f["price_min"]), _some(f["price_max"])
    between = F.concat(F.lit("between_"), low.cast("string"), F.lit("_to_"), high.cast("string"))
    price = F.coalesce(between, F.concat(F.lit("max_"), high.cast("string")), F.concat(F.lit("min_"), low.cast("string")))
    return [("price", price), ("transmission", code_of(f["transmission"], FILTERED.codes["transmission"], None))]


#: A make in the path and one ``f`` parameter for each filter.
PATHED = Dialect(_path_base, _path_parameters, end="&sort=bestmatch&serveWarrantyCount=true&listingSource=TabFilter")
#: Codes after a hash, in lakhs and thousands of kilometres.
CODED = Dialect(
    lambda f: F.concat(F.lit("https://www.cartrade.com/second-hand/"), _word(F.coalesce(f["city"], F.lit(CITY))), F.lit("/")), _hash_parameters, begin="#",
    codes={
        "city": {"hyderabad": 105}, "fuel": {"petrol": 1, "diesel": 2, "cng": 3, "lpg": 4, "electric": 5}, "trans": {"manual": 1, "automatic": 2}, "bodytype": {"suv": 6, "sedan": 1, "hatchback": 3, "muv": 6, "coupe": 8},
        "car": {"maruti": 8, "hyundai": 9, "honda": 10, "toyota": 11, "tata": 12, "mahindra": 13, "renault": 24, "ford": 14, "kia": 43},
    },
)
#: All filters in one parameter.
FILTERED = Dialect(
    lambda f: code_of(F.coalesce(f["city"], F.lit(CITY)), {"hyderabad": "https://www.olx.in/hyderabad_g4058526/cars_c84"}, "https://www.olx.in/hyderabad_g4058526/cars_c84"), _filter_parameters, begin="?filter=", joined="%2C", pair="{name}_{value}",
    codes={"transmission": {"automatic": "eq_1", "manual": "eq_2"}},
)


def address(rows: DataFrame, dialect: Dialect, this_year: Column | None = None) -> Column:
    """Each request's address: its columns of ``FILTERS`` are read, of several ``makes`` the first.

    Null filters are left out or have the site's defaults; a least year alone ends at
    ``this_year`` (of today, if not given), a greatest alone begins in 2000.  Words are encoded.
    """
    f = {n: (F.col(n) if n in rows.columns else F.lit(None)).cast(t) for n, t in FILTERS.items()}
    if "makes" in rows.columns:
        f["make"] = F.try_element_at(F.col("makes"), F.lit(1))
    f["this_year"] = this_year if this_year is not None else F.year(F.current_date())
    return F.concat(dialect.base(f), written(dialect.parameters(f), dialect), F.lit(dialect.end))
