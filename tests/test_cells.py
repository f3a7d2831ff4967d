"""Conflicts by aggregates, registries, failures, addresses and rule tables: examples and brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veldspar.functions import addresses
from veldspar.operators import build, failures, records, registry

CANDIDATE = "cell int, seq int, unit string, value_bool boolean, value_num double, scope string"


def reason(x, y):
    """The first contradiction of two candidates, the earlier first."""
    if x[2] and y[2] and x[2] != y[2]:
        return "unit"
    if x[3] is not None or y[3] is not None:
        return "flag" if x[3] is not y[3] else None
    a, b = x[4], y[4]
    if a is not None and b is not None and a != b and abs(a - b) > 0.02 * max(abs(a), abs(b), 1.0):
        return "number"
    return "scope" if (x[5], y[5]) == ("MODEL_LEVEL", "VARIANT_LEVEL") else None


@pytest.fixture(scope="module")
def cells():
    r = random.Random(3)
    out, seq = [], 0
    for cell in range(400):
        units, flags = r.choice([[None, ""], ["mm"], ["mm", "", None], ["mm", "cm"]]), r.choice([[None], [None], [True], [True, False], [None, True]])
        base = r.choice([0.0, 1.0, -50.0, 100.0, 1e6])
        for _ in range(r.randint(1, 9)):
            seq += 1
            number = r.choice([None, base, base * 1.019, base * 1.03, -base, float("nan"), float("inf")] if r.random() < 0.5 else [base, base * 1.01])
            out.append((cell, seq, r.choice(units), r.choice(flags), number, r.choice([None, "MODEL_LEVEL", "VARIANT_LEVEL"] if r.random() < 0.4 else [None])))
    r.shuffle(out)
    return out


def pairs(cells):
    by = {}
    for c in sorted(cells, key=lambda c: c[1]):
        by.setdefault(c[0], []).append(c)
    return {k: sum(reason(a, b) is not None for a, b in combinations(v, 2)) for k, v in by.items()}


def test_conflicts_without_pairs_equal_the_nested_loop(spark, cells):
    df, want = spark.createDataFrame(cells, CANDIDATE), pairs(cells)
    there = {k for k, n in want.items() if n}
    assert 50 < len(there) < 350
    assert {x.cell for x in records.conflicted(df, ["cell"], "seq").collect()} == there
    assert {x.cell for x in records.conflicts(df, ["cell"], "seq").select("cell").distinct().collect()} == there
    assert {x.cell: x.n for x in records.conflict_counts(df, ["cell"], "seq").collect()} == {k: n for k, n in want.items() if n}
    assert {x.conflict_id for x in records.conflict_ids(df, ["cell"], "seq").collect()} == {f"SSCONFLICT-{k}-{n}" for k, n in want.items() if n}


def test_a_hot_cell_takes_linear_time(spark):
    """A million candidates of one cell: pairs of kinds would be half a million million."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("cell"), F.col("id").alias("seq"), F.lit("").alias("unit"), F.lit(None).cast("boolean").alias("value_bool"), (1000 + F.col("id") / 1e6).alias("value_num"), F.lit(None).cast("string").alias("scope"))
    assert records.conflicted(rows, ["cell"], "seq").count() == 0
    assert records.conflicted(rows.withColumn("value_num", F.when(F.col("seq") == 77, 5.0).otherwise(F.col("value_num"))), ["cell"], "seq").count() == 1


def test_one_bad_row_of_a_thousand(spark):
    rows = spark.createDataFrame([(i, "nine" if i == 9 else None if i == 10 else str(i)) for i in range(1000)], "id int, text string")
    good, bad = failures.split(failures.attempted(rows, "text", lambda t: str(int(t) + 1)), "id", "numbers")
    assert good.where("value is not null").count() == 998 and [tuple(x)[:2] for x in bad.collect()] == [("numbers", 9)]
    assert "ValueError" in bad.first().error


def test_sources_that_cant_be_read_are_errors(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, t string")
    union, errors = failures.union_of({"good": lambda: rows, "no file": lambda: spark.read.parquet("/no/such/folder"), "no column": lambda: rows.drop("t"), "again": lambda: rows}, ["id", "t"])
    assert sorted(x.source for x in union.collect()) == ["again", "good"] and [e[0] for e in errors] == ["no file", "no column"]
    assert failures.union_of({"x": lambda: spark.read.parquet("/no/such/folder")}, ["id"])[0] is None


def test_dispatch_by_row(spark):
    rows = spark.createDataFrame([(1, "suv under 10 lakh automatic"), (2, "budget 10 lakh amt"), (3, None)], "id int, query string")
    got = {x.id: x for x in failures.dispatched(rows, fails=F.col("id") == 2).collect()}
    assert [got[i].parser_used for i in (1, 2, 3)] == ["hybrid", "regex_fallback", "regex_fallback"]
    assert got[1].intent.use_case == "general" and got[2].intent is None and got[3].filters.price_max is None
    assert (got[1].filters.price_max, got[2].filters.price_max, got[2].filters.transmission) == (1_000_000, 1_000_000, None)


def asked(spark, dialect, **filters):
    rows = spark.createDataFrame([tuple(filters.get(n) for n in addresses.FILTERS)], ", ".join(f"{n} {t}" for n, t in addresses.FILTERS.items()))
    return rows.select(addresses.address(rows, dialect, F.lit(2025)).alias("x")).first().x


def test_addresses(spark):
    assert asked(spark, addresses.PATHED) == "https://www.cars24.com/buy-used-cars-hyderabad/?f=listingPrice:bw:0,10000000&sort=bestmatch&serveWarrantyCount=true&listingSource=TabFilter"
    assert "/buy-used-kia-cars-pune/?f=bodyType:in:suv&f=fuelType:in:diesel&" in asked(spark, addresses.PATHED, make="Kia", city="Pune", body_type="SUV", fuel_type="Diesel")
    assert "f=year:bw:2019,2025" in asked(spark, addresses.PATHED, year_min=2019) and "f=year:bw:2000,2019" in asked(spark, addresses.PATHED, year_max=2019)
    assert asked(spark, addresses.CODED) == "https://www.cartrade.com/second-hand/hyderabad/#sc=1&so=-1&city=105&budget=0-100"
    assert asked(spark, addresses.CODED, price_min=900_000, price_max=500_000, city="Nowhere", km_max=50_500, make="Lada", transmission="Automatic") == "https://www.cartrade.com/second-hand/nowhere/#sc=1&so=-1&city=105&trans=2&kms=50-&car=8"
    assert asked(spark, addresses.FILTERED) == "https://www.olx.in/hyderabad_g4058526/cars_c84"
    assert asked(spark, addresses.FILTERED, city="x", price_min=1, price_max=2, transmission="MANUAL").endswith("?filter=price_between_1_to_2%2Ctransmission_eq_2")
    assert asked(spark, addresses.FILTERED, price_min=0, transmission="tiptronic").endswith("cars_c84")


def test_registry(spark):
    rows = spark.createDataFrame([("r1", "m", "Creta", "SX", "petrol", "Manual"), ("r2", "m", "Swift", "VXI", "petrol", "Manual"), ("r3", "m", "Swift", "ZXI", "petrol", "Manual")], "id string, make string, model string, variant string, fuel_type string, transmission string")
    listed = rows.withColumn("transmission", F.when(F.col("id") == "r3", "AMT").otherwise(F.col("transmission")))
    held = registry.Registry()
    held.register(registry.Source("late", ("ebd",), "VARIANT_LEVEL", 7, 1.0))
    held.register(registry.Source("portal", ("ebd", "rear_parking_sensors"), "VARIANT_LEVEL", 3, 0.8, registry.OverlapAdapter(listed, "p.example")))
    got = sorted((x.id, x.field, x.confidence, x.source) for x in held.candidates(rows, "id", ["sunroof", "ebd", "rear_parking_sensors"]).collect())
    assert got == [("r1", "ebd", 0.8, "portal"), ("r2", "ebd", 0.8, "portal"), ("r2", "rear_parking_sensors", 0.8, "portal")]
    assert held.candidates(rows, "id", ["sunroof"]).count() == 0 and registry.Registry().candidates(rows, "id", ["ebd"]).count() == 0
    assert [x.source for x in held.sources_for(spark, "ebd").collect()] == ["portal", "late"] and held.sources_for(spark, "x").count() == 0


def test_gearbox_rules_as_escaped_and_as_meant(spark):
    rows = spark.createDataFrame([("a", "Tata", "Nexon", "XZ", "Automatic (AMT)", "Petrol"), ("b", "Tata", "Nexon", None, "6 speed manual", "Petrol"), ("c", "Tata", "Nexon", "EV", None, "ELECTRIC"), ("d", "Maruti Suzuki", "Swift", "VXI", "Automatic", "Petrol"), ("e", "Hyundai", "Nexon", "x", "5 Speed Manual", "Petrol")], "id string, make string, model string, variant string, transmission string, fuel_type string")
    said = lambda compat: {x.id: x.value for x in build.gearbox_rule_candidates(rows, build.gearbox_rules(spark, compat=compat), "id").collect()}
    assert said(True) == {"b": "6", "c": "1", "d": "5"} and said(False) == {"a": "6", "b": "6", "c": "1", "d": "5"}
