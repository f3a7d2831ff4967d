"""Raw pages to records: the structural index, the table of fields, and texts that no number holds."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veldspar.functions import intent, pages, text
from veldspar.operators import extraction


def test_structural_index_equals_the_scan():
    r = random.Random(1)
    for alphabet in ('{}[]"\\ax\n', '{}"\\', '{"\\', "{}[]é\""):
        for _ in range(3000):
            t = r.choice("{[") + "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            want = pages.balanced(t, 0)
            assert pages.balanced_bytes(t.encode(), 0) == (want.encode() if want is not None else None), t


def test_structural_index_over_windows(monkeypatch):
    monkeypatch.setattr(pages, "_WINDOW", 7)
    r = random.Random(2)
    for _ in range(300):
        t = json.dumps({str(i): r.choice([[], {"a": '}"\\'}, "x{", None, "é" * 9]) for i in range(r.randint(0, 30))}, ensure_ascii=False)
        assert pages.balanced_bytes(("xx" + t + "}}}").encode(), 2) == t.encode()


def test_structural_index_is_quick():
    items = [{"itemName": f"Item {i}", "value": "a text of usual length that says what an item is", "renderedTemplates": {"a": "<b>more</b> \"markup\""}} for i in range(6000)]
    big = json.dumps({"trimPage": {"items": items}})
    data = big.encode()
    took = []
    for f in (lambda: pages.balanced(big, 0), lambda: pages.balanced_bytes(data, 0)):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            f()
            times.append(time.perf_counter() - began)
        took.append(min(times))
    assert took[1] * 5 < took[0]


def record(spark, html, **more):
    return extraction.page_records(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], **more).first().asDict()


def page(state):
    return f"<h1>A <b>fine</b>&nbsp;car</h1><script>window.__INITIAL_STATE__ = {json.dumps(state)};</script>"


def item(name, value="", **rendered):
    return {"itemName": name, "value": value, "renderedTemplates": rendered}


def test_items_and_fallbacks(spark):
    items = [item("Sunroof", "Panoramic"), item("Engine Type", "1197 cc, 4 Cylinders Inline, 4 Valves/Cylinder, DOHC Turbo"), item("Displacement", "1197 cc"), item("AC Fast Charging", ""), item("AC Regular Charging", "8 hrs 30 mins"), item("Central Locking", "Keyless"), item("Parking Sensors", "Rear"), item("NCAP Rating", "5 Star (Global NCAP)")]
    state = {"trimPage": {"specsFeaturesMaster": [{"name": "c", "subCategories": [{"name": "s", "items": items}]}], "trimDetail": {"makeName": "M", "modelName": "N", "trimName": "T"}, "versionDetail": {"makeName": "", "versionId": 7, "featureSpecs": [item("x", None, a="ABS: fitted", b="no")]}, "trimDetailedPriceBreakup": {"7": [{"exShowRoom": 1099000, "onRoad": "Rs. 12.5 Lakh"}]}}}
    got = record(spark, page(state))
    assert (got["make"], got["model"], got["variant"], got["full_name"]) == ("M", "N", "T", "M N T")
    assert (got["price_ex_showroom"], got["price_on_road"], got["currency"]) == (1099000, 1250000, "INR")
    assert (got["engine_cc"], got["cylinders"], got["turbocharged"], got["charging_time_ac_hours"]) == (1197, 4, True, 8.5)
    assert (got["sunroof"], got["panoramic_sunroof"], got["keyless_entry"], got["rear_parking_sensors"], got["front_parking_sensors"]) == (None, True, True, True, None)
    assert (got["crash_test_rating"], got["crash_test_agency"], got["abs"], got["error"]) == (5.0, "Global NCAP", None, None)


def test_electric_records_have_no_displacement(spark):
    items = [item("Fuel Type", "Electric"), item("Displacement", "1197 cc"), item("Battery", "40.5 kWh")]
    got = record(spark, page({"trimPage": {"versionDetail": {"specsSummary": items, "modelName": "N"}}}))
    assert (got["engine_cc"], got["battery_capacity_kwh"], got["full_name"], got["make"]) == (None, 40.5, "A fine car", None)


def test_an_item_found_without_a_value_ends_the_search(spark):
    items = [item("Airbags"), item("Number of Airbags", "6 airbags"), item("Bluetooth Range", "9 m"), item("Driving Range", "300 km")]
    got = record(spark, page({"trimPage": {"versionDetail": {"specsSummary": items}}}))
    assert got["airbags"] is None and got["claimed_ev_range_km"] == 300.0


@pytest.mark.parametrize("html, error", [(None, "page is empty"), ("", "page is empty"), ("<h1>x</h1>", "no embedded state"), ("window.__INITIAL_STATE__ = {'a': 1}", "embedded state is no valid JSON object"), ("window.__INITIAL_STATE__ = [", "embedded state is no valid JSON object"), ("window.__INITIAL_STATE__ = {}", "embedded state has no page of a trim"), (page({"trimPage": {"specsFeaturesMaster": 5, "versionDetail": {"makeName": "M"}}}), None)])
def test_pages_that_cant_be_read_are_rows_with_an_error(spark, html, error):
    got = record(spark, html)
    assert got["error"] == error and got["currency"] == "INR" and got["airbags"] is None


def test_one_bad_page_among_many(spark):
    good = page({"trimPage": {"versionDetail": {"specsSummary": [item("Airbags", "6")]}}})
    rows = spark.createDataFrame([(i, "window.__INITIAL_STATE__ = {\"a\":" if i == 500 else good) for i in range(1000)], "id int, html string")
    got = extraction.page_records(rows, ["id"])
    assert got.where("airbags = 6").count() == 999 and [r.id for r in got.where("error is not null").collect()] == [500]


LONG = "9" * 40


@pytest.mark.parametrize("f, said", [(text.first_int, LONG), (text.price, f"{LONG} crore"), (text.gear_count, "99999999999 speed"), (text.dimensions, f"{LONG} x 5"), (text.minutes, f"{LONG} h"), (text.warranty, f"{LONG} years, {LONG} km")])
def test_numbers_that_no_type_holds_are_null(spark, f, said):
    got = spark.createDataFrame([(said,), ("5 speed 5 years",)], "c string").select(f(F.col("c")).alias("x")).collect()[0].x
    assert got is None or got[0] is None


def test_requests_with_long_numbers_do_not_end_the_job(spark):
    said = [f"{LONG} to 5 lakh", f"under {LONG} crore", "99999999999 seater", f"above {LONG} kmpl", f"{LONG} kmpl", f"under {LONG}k km", "suv under 10 lakh"]
    rows = spark.createDataFrame([(s,) for s in said], "query string")
    for f in (intent.parsed, intent.plain, intent.used):
        got = f(rows).collect()
        assert len(got) == len(said)
    assert [r.price_max for r in intent.plain(rows).collect()][-1] == 1_000_000
