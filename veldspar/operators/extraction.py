"""Raw vehicle pages to records: a table of fields compiled into one pass over each page.

The embedded state is parsed once, into the one structure below; its items are an array of
normalised labels, and every field is an expression over that array, so pages are neither
exploded nor shuffled.  What can't be read is a null field, and the record says why.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import pages, text

_ITEM = "struct<itemName:string,value:string,renderedTemplates:map<string,string>>"
_TREE = f"array<struct<name:string,subCategories:array<struct<name:string,items:array<{_ITEM}>>>>>"
_VERSION = f"struct<makeName:string,modelName:string,versionName:string,versionId:string,specsSummary:array<{_ITEM}>,featureSpecs:array<{_ITEM}>>"
#: The parts of a state that fields come from.
STATE = f"struct<trimPage:struct<specsFeaturesMaster:{_TREE},versionDetail:{_VERSION},trimDetail:struct<makeName:string,modelName:string,trimName:string>,trimDetailedPriceBreakup:map<string,array<struct<exShowRoom:string,onRoad:string>>>>>"


@dataclass(frozen=True)
class Field:
    """A field: the labels of its item, how its text becomes a value and, for a flag whose text
    says neither yes nor no, the words that mean yes (without any it stays null)."""

    name: str
    labels: tuple[str, ...]
    parse: str = "text"
    words: tuple[str, ...] = ()


#: How the text of an item becomes a value.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: F.nullif(c, F.lit("")),
    "number": text.number,
    "int": text.first_int,
    "flag": text.tri_bool,
    "transmission": text.transmission_label,
    "gears": text.gear_count,
    "engine_cc": text.engine_cc,
    "hours": text.hours,
    "minutes": text.minutes,
    "cylinders": lambda c: F.nullif(F.regexp_extract(c, r"(?i)([0-9]+)\s*cylinders?", 1), F.lit("")).try_cast("int"),
    "agency": lambda c: F.nullif(F.regexp_extract(c, r"(?i)\(([^)]+NCAP[^)]*)\)", 1), F.lit("")),
    "length": lambda c: text.dimensions(c)["length"],
    "width": lambda c: text.dimensions(c)["width"],
    "height": lambda c: text.dimensions(c)["height"],
    "years": lambda c: text.warranty(c)["years"],
    "km": lambda c: text.warranty(c)["km"],
    "panoramic": lambda c: F.when(c != "", F.lower(c).contains("panoramic")),
}

# The labels under which pages show the fields, and the words of flags.
FIELDS = [
    Field("fuel_type", ("Fuel Type",)),
    Field("drivetrain", ("Drivetrain",)),
    Field("mileage_arai_kmpl", ("Mileage (ARAI)",), "number"),
    Field("fuel_tank_capacity_litres", ("Fuel Tank Capacity",), "number"),
    Field("claimed_ev_range_km", ("Driving Range", "Range"), "number"),
    Field("wheelbase_mm", ("Wheelbase",), "number"),
    Field("ground_clearance_mm", ("Ground Clearance",), "number"),
    Field("turning_radius_metres", ("Minimum Turning Radius", "Turning Radius"), "number"),
    Field("infotainment_screen_inches", ("Infotainment Screen", "Touchscreen", "Display"), "number"),
    Field("transmission", ("Transmission", "Transmission Type"), "transmission"),
    Field("gearbox_speeds", ("Transmission", "Transmission Type"), "gears"),
    Field("engine_cc", ("Displacement", "Engine Displacement", "Engine Capacity", "Engine (cc)"), "engine_cc"),
    Field("cylinders", ("Engine Type", "Engine"), "cylinders"),
    Field("battery_capacity_kwh", ("Battery", "Battery Capacity"), "number"),
    Field("turbocharged", ("Turbocharger/ Supercharger",), "flag"),
    Field("power_bhp", ("Max Power (bhp@rpm)", "Max Power", "Max Engine Power"), "number"),
    Field("torque_nm", ("Max Torque (Nm@rpm)", "Max Torque", "Max Engine Torque"), "number"),
    Field("charging_time_ac_hours", ("AC Fast Charging",), "hours"),
    Field("charging_time_dc_minutes", ("DC Fast Charging",), "minutes"),
    Field("seating_capacity", ("Seating Capacity",), "int"),
    Field("length_mm", ("Length *Width *Height", "Length Width Height"), "length"),
    Field("width_mm", ("Length *Width *Height", "Length Width Height"), "width"),
    Field("height_mm", ("Length *Width *Height", "Length Width Height"), "height"),
    Field("boot_space_litres", ("Bootspace", "Boot Space"), "number"),
    Field("airbags", ("Airbags",), "int"),
    Field("crash_test_rating", ("NCAP Rating", "Crash Test Rating"), "number"),
    Field("crash_test_agency", ("NCAP Rating", "Crash Test Rating"), "agency"),
    Field("abs", ("Anti-Lock Braking System (ABS)", "ABS"), "flag"),
    Field("ebd", ("Electronic Brake-force Distribution (EBD)", "EBD"), "flag"),
    Field("esc", ("Electronic Stability Program (ESP)", "Electronic Stability Control", "ESC"), "flag"),
    Field("traction_control", ("Traction Control System (TC/TCS)", "Traction Control"), "flag"),
    Field("hill_assist", ("Hill Hold Control", "Hill Assist", "Hill-Start Assist"), "flag"),
    Field("hill_descent_control", ("Hill Descent Control",), "flag"),
    Field("tyre_pressure_monitoring_system", ("Tyre Pressure Monitoring System", "TPMS"), "flag"),
    Field("rear_parking_sensors", ("Parking Sensors", "Rear Parking Sensors"), "flag", ("rear",)),
    Field("front_parking_sensors", ("Front Parking Sensors",), "flag", ("front",)),
    Field("rear_camera", ("Rear View Camera", "Driver Rear View Monitor", "Rear Camera"), "flag"),
    Field("camera_360", ("360 Degree Camera", "360-degree Camera", "Surround View Monitor", "Parking Assist"), "flag", ("360", "surround")),
    Field("adas_available", ("ADAS",), "flag"),
    Field("sunroof", ("Sunroof",), "flag"),
    Field("panoramic_sunroof", ("Sunroof",), "panoramic"),
    Field("automatic_climate_control", ("Automatic Climate Control", "Air Conditioner"), "flag", ("automatic", "climate")),
    Field("cruise_control", ("Cruise Control",), "flag"),
    Field("ventilated_front_seats", ("Ventilated Seats", "Ventilated Front Seats"), "flag"),
    Field("powered_driver_seat", ("Driver Seat Adjustment", "Powered Driver Seat"), "flag", ("electric", "powered")),
    Field("powered_front_seats", ("Front Passenger Seat Adjustment", "Powered Front Seats"), "flag", ("electric", "powered")),
    Field("rear_ac_vents", ("Rear AC Vents",), "flag"),
    Field("keyless_entry", ("Central Locking", "Keyless Entry"), "flag", ("keyless",)),
    Field("push_button_start", ("Keyless Start/ Button Start", "Push Button Start"), "flag"),
    Field("wireless_charging", ("Wireless Charger", "Wireless Charging"), "flag"),
    Field("android_auto", ("Android Auto", "Smart Connectivity"), "flag", ("android auto",)),
    Field("apple_carplay", ("Apple CarPlay", "Smart Connectivity"), "flag", ("apple carplay",)),
    Field("connected_car_features", ("Mobile App", "Find My Car", "Geo-fence", "Check Vehicle Status via App"), "flag"),
    Field("standard_warranty_years", ("Vehicle Warranty",), "years"),
    Field("standard_warranty_km", ("Vehicle Warranty",), "km"),
]
AC_REGULAR = ("AC Regular Charging",)
ENGINE = ("Engine Type", "Engine")
#: Fields of a record's whole schema, of which completeness is a share.
SCHEMA_FIELDS = 91


def _items(trim: Column) -> Column:
    """(n: normalised name, r: normalised rendered texts, v: value) of all items: the tree's, then
    the two summary lists', in their order."""
    none = F.expr(f"cast(array() as array<{_ITEM}>)")
    tree = F.flatten(F.transform(trim["specsFeaturesMaster"], lambda c: F.flatten(F.transform(c["subCategories"], lambda s: F.coalesce(s["items"], none)))))
    lists = [F.coalesce(trim["versionDetail"][n], none) for n in ("specsSummary", "featureSpecs")]
    every = F.filter(F.concat(F.coalesce(tree, none), *lists), lambda x: x.isNotNull())

    def entry(x: Column) -> Column:
        rendered = F.coalesce(F.map_values(x["renderedTemplates"]), F.array().cast("array<string>"))
        first = F.try_element_at(F.filter(rendered, lambda v: F.coalesce(v != "", F.lit(False))), F.lit(1))
        value = F.when(F.coalesce(x["value"] != "", F.lit(False)), x["value"]).otherwise(first)
        return F.struct(text.label(F.coalesce(x["itemName"], F.lit(""))).alias("n"), F.transform(rendered, lambda v: text.label(F.coalesce(v, F.lit("None")))).alias("r"), F.trim(value).alias("v"))

    return F.transform(every, entry)


def _label(said: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in said.lower()).split())


def looked_up(items: str, labels: tuple[str, ...]) -> Column:
    """The value of the first item named by one of some labels, else of the first whose name or
    rendered texts hold one.  ``items``: a column of normalised items; an item found has a null
    value at most."""
    wanted = [_label(s) for s in labels]
    exact, part = ", ".join(f"'{w}'" for w in wanted), "|".join(wanted)  # letters, digits and blanks alone
    return F.expr(
        f"coalesce(try_element_at(filter({items}, x -> x.n IN ({exact})), 1), "
        f"try_element_at(filter({items}, x -> x.n RLIKE '{part}' OR exists(x.r, t -> t RLIKE '{part}')), 1)).v"
    )


def heading(html: Column) -> Column:
    """The text of the first h1, its parts apart, the commonest entities read; null without one."""
    out = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>", 1), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def offer(blocks: Column) -> Column:
    """(price, currency) of the first ld+json object, or member of its graph, whose offers have one."""
    members = lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), F.array(b))
    told = lambda b: F.struct(text.price(F.get_json_object(b, "$.offers.price")).alias("price"), F.get_json_object(b, "$.offers.priceCurrency").alias("currency"))
    every = F.transform(F.flatten(F.transform(blocks, members)), told)
    return F.try_element_at(F.filter(every, lambda o: F.coalesce(o["price"] != 0, F.lit(False)) | F.coalesce(o["currency"] != "", F.lit(False))), F.lit(1))


def _or(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def page_records(rows: DataFrame, keep: list[str], html: str = "html", source: Column | None = None, url: Column | None = None, fields: list[Field] = FIELDS) -> DataFrame:
    """A record for each page: ``keep``, identity, prices, all ``fields``, completeness and ``error``.

    Identity comes from the version, else the trim; the full name is make, model and variant
    if all are there, else the heading.  The road price is the version's, else the linked
    data's; the currency is the linked data's, else INR.  A page without a state that can be
    read keeps what its heading and linked data say, and ``error`` says what failed: it never
    ends the job.  Null pages are empty ones.
    """
    held = pages.with_state(rows, html)
    held = held.withColumn("__state", F.from_json("state", STATE))
    trim = F.col("__state.trimPage")
    held = held.withColumn("__items", _items(trim)).withColumn("__offer", offer(pages.linked_data(F.col(html))))
    spans = list(dict.fromkeys([f.labels for f in fields] + [AC_REGULAR, ENGINE]))
    said = {labels: f"__l{i}" for i, labels in enumerate(spans)}
    held = held.withColumns({n: looked_up("__items", labels) for labels, n in said.items()})

    version, detail = trim["versionDetail"], trim["trimDetail"]
    make, model, variant = _or(version["makeName"], detail["makeName"]), _or(version["modelName"], detail["modelName"]), _or(version["versionName"], detail["trimName"])
    broken = F.try_element_at(F.try_element_at(trim["trimDetailedPriceBreakup"], F.nullif(version["versionId"], F.lit(""))), F.lit(1))
    held = held.withColumns({"__make": make, "__model": model, "__variant": variant, "__show": text.price(broken["exShowRoom"]), "__road": text.price(broken["onRoad"])})
    full = F.when(F.col("__make").isNotNull() & F.col("__model").isNotNull() & F.col("__variant").isNotNull(), F.concat_ws(" ", "__make", "__model", "__variant")).otherwise(heading(F.col(html)))

    electric = F.coalesce(F.col(said["Fuel Type",]) == "Electric", F.lit(False)) if ("Fuel Type",) in said else F.lit(False)
    made: dict[str, Column] = {}
    for f in fields:
        told = F.col(said[f.labels])
        if f.name == "charging_time_ac_hours":
            told = _or(told, F.col(said[AC_REGULAR]))
        value = PARSERS[f.parse](told)
        if f.words:
            words = F.lower(told).rlike("|".join(f.words))
            value = F.coalesce(value, F.when(told != "", words))
        made[f.name] = value
    if "turbocharged" in made:
        made["turbocharged"] = F.coalesce(made["turbocharged"], F.when(F.lower(F.col(said[ENGINE])).contains("turbo"), True))
    for name, on in (("engine_cc", ~electric), ("battery_capacity_kwh", electric)):
        if name in made:
            made[name] = F.when(on, made[name])

    first = {"source": source if source is not None else F.lit(None).cast("string"), "source_url": url if url is not None else F.lit(None).cast("string")}
    first |= {"make": F.col("__make"), "model": F.col("__model"), "variant": F.col("__variant"), "full_name": full}
    first |= {"price_ex_showroom": F.col("__show"), "price_on_road": F.coalesce(F.nullif(F.col("__road"), F.lit(0)), F.col("__offer.price")), "currency": F.coalesce(F.nullif(F.col("__offer.currency"), F.lit("")), F.lit("INR"))}
    marked = F.coalesce(F.col(html).contains(pages.STATE), F.lit(False))
    error = F.when(F.coalesce(F.col(html) == "", F.lit(True)), "page is empty").when(~marked, "no embedded state").when(F.col("state").isNull(), "embedded state is no valid JSON object").when(trim.isNull(), "embedded state has no page of a trim")
    out = held.select(*keep, *(c.alias(n) for n, c in (first | made).items()), error.alias("error"))
    full = [F.when(F.col(n).isNotNull() & (F.col(n).cast("string") != ""), 1).otherwise(0) for n in [*first, *made]]
    return out.withColumn("field_completeness_score", F.round(100.0 * sum(full[1:], full[0]) / SCHEMA_FIELDS, 2))
