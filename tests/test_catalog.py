"""Catalog queries against DuckDB, and examples of the column functions and operators."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veldspar.functions import intent, model, pages, text
from veldspar.operators import build, filters, listings, ranking, records, rules
from veldspar.plans import audits, cars, quality, vehicles
from veldspar.sources import files
from veldspar.streaming import fetch_log

SF = "/root/testdata/sf0.001"
ALL = cars.QUERIES | quality.QUERIES | vehicles.QUERIES | audits.QUERIES
SQL = cars.ORACLES | quality.ORACLES | vehicles.ORACLES | audits.ORACLES


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("part", "lineitem", "customer", "orders", "embeddings", "documents", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in ALL if n in SQL])
def test_query_equals_sql(spark, duck, name):
    df = ALL[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(tuple(repr(plain(r[i])) for i in at) for r in found.fetchall())
    assert sorted(tuple(repr(plain(r[c])) for c in columns) for r in df.collect()) == want


def each(spark, values, f):
    """What ``f`` makes of texts, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", f(F.col("c")).alias("x")).collect()
    return [x.x for x in sorted(rows, key=lambda r: r.i)]


def test_numbers_and_units(spark):
    assert each(spark, ["Rs 12.5 Lakh", "1,20,000", "2 crore", "none", None], text.price) == [1_250_000, 120_000, 20_000_000, None, None]
    assert each(spark, ["1197 cc", "2024 model, 1,197 cc", "engine capacity 998", "1197 bhp", "1197", "accuracy 1197", "7000 cc", None], text.engine_cc) == [1197, None, 998, None, None, None, None, None]
    assert each(spark, ["2024 model 1498 cc", "1498.6 cubic centimetre"], text.engine_cc) == [1498, None]
    assert each(spark, ["7 h 30 min", "45 minutes", "8", None], text.hours) == [7.5, 0.75, 8.0, None]
    assert each(spark, ["7 h 30 min", "45 minutes", "8.9", None], text.minutes) == [450, 45, 8, None]
    assert each(spark, ["3995 x 1745 mm"], text.dimensions)[0].asDict() == {"length": 3995, "width": 1745, "height": None}
    assert each(spark, ["3 Years / 1,00,000 kms"], text.warranty)[0].asDict() == {"years": 3, "km": 100000}
    assert each(spark, ["-3.7 deg", "x"], text.first_int) == [-3, None]
    assert each(spark, ["5 Speed Manual", "6-gear"], text.gear_count) == [5, None]


def test_flags_keep_three_states(spark):
    got = each(spark, ["Yes", "not  available", "ABS-No", "no way", "yes front", "front only", "", None], text.tri_bool)
    assert got == [True, False, False, False, True, None, None, None]


def test_texts(spark):
    assert each(spark, ["VX+ (O) 1.2", "A  B", None], text.variant_text) == ["vx plus o 1 2", "a b", ""]
    assert each(spark, ["Automated Manual", "6MT", "AT", "DSG", None], text.transmission_family) == ["amt", "6mt", "automatic", "dsg", "unknown"]
    assert each(spark, ["Alto  800", None], text.slug) == ["alto--800", "unknown"]
    assert each(spark, ["https://a.example/x y/-z?q"], text.cache_key)[0].startswith("x_y_z_")
    assert each(spark, [" ", "b"], lambda c: text.first_filled(c, F.lit("z"))) == ["z", "b"]
    assert each(spark, ["N"], lambda c: text.sentence(c, [("price", F.lit(5)), ("gears", F.lit(None).cast("int"))], [("abs", F.lit(True)), ("sunroof", F.lit(None).cast("boolean"))])) == ["N. price 5. features: abs"]


def test_intent(spark):
    rows = [("Automatic SUV with sunroof from Tata under15 lakh",), ("10to12 lakh petrol sedan or manual automatic",), ("under 20 kmpl",), (None,)]
    frame = spark.createDataFrame(rows, "query string")
    a, b, c, d = intent.parsed(frame).collect()
    assert (a.price_max, a.body_type, a.transmission, a.makes, a.features) == (1_500_000, "suv", "automatic", ["Tata"], ["sunroof"])
    assert (b.price_min, b.price_max, b.fuel_type, b.transmission) == (1_000_000, 1_200_000, "petrol", None)
    assert (c.price_max, c.mileage_min, c.mileage_max) == (2_000_000, 0.0, 20.0)
    assert (d.price_max, d.body_type, d.makes, d.use_case) == (None, None, [], "general")
    assert intent.parsed(frame, compat=False).collect()[2].price_max is None
    told = intent.parsed(frame.withColumn("m", F.lit("budget")), model={"use_case": "m"}).collect()
    assert {x.use_case for x in told} == {"budget"}


def test_requests_are_lower_cased_and_cut_once(spark):
    frame = spark.range(1).select(F.concat(F.lit("SUV "), F.col("id").cast("string")).alias("query"))
    plan = intent.parsed(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("split(") == 1
    assert plan.count("RLIKE") < 20 and "[^a-z0-9_]" not in plan  # words are looked up, and this class takes Java ten times as long


def test_first_words_of_phrases_belong_to_one_class():
    classes = [*(("body", *c) for c in intent.BODIES), *(("fuel", *c) for c in intent.FUELS), *(("feature", *c) for c in intent.FEATURES), *(("make", name, [w]) for w, name in intent.MAKES), ("gears", "auto", intent.AUTOMATIC), ("gears", "manual", ["manual"])]
    owners = {}
    for part, name, words in classes:
        for w in words:
            owners.setdefault(re.split(r"\W", w)[0], set()).add((part, name))
    assert all(len(x) == 1 for x in owners.values())


def test_whole_words_among_odd_separators(spark):
    said = ["land-rover", "Xland rover Lexus, LAND ROVER\n", "land roverx", "audi|bmw_ kia\tford", "\u00e9suv\u00e9", "pick up", "pick-up", "sun-roof sun roof", "anti lock", "android auto", "seat ventilations", "auto\r\n", "suv2", ""]
    rows = intent.parsed(spark.createDataFrame(list(enumerate(said)), "i long, query string")).orderBy("i").collect()
    for row in rows:
        has = lambda words: any(re.search(rf"(^|[^a-z0-9_]){re.escape(w)}($|[^a-z0-9_])", row.query.lower()) for w in words)  # noqa: B023, E731
        assert row.makes == [name for w, name in intent.MAKES if has([w])]
        assert row.features == [name for name, words in intent.FEATURES if has(words)]
        assert row.body_type == next((name for name, words in intent.BODIES if has(words)), None)
        assert row.transmission == ("automatic" if has(intent.AUTOMATIC) else None)


@pytest.mark.parametrize(
    "said, price_min, price_max, mileage_min, mileage_max",
    [
        ("10to 12crore", 100_000_000, 120_000_000, None, None),
        ("maximum 9 cr above 3", None, 90_000_000, None, None),
        ("over7 to 8", 700_000, 800_000, None, None),
        ("minimum\t5crores", 50_000_000, None, None, None),
        ("land rover 6 under x", 600_000, None, None, None),
        ("15 to 20 kmpl under 12 kmpl", 1_500_000, 2_000_000, 15.0, 20.0),
        ("at least 14kmpl", None, None, 14.0, None),
    ],
)
def test_numbers_of_requests(spark, said, price_min, price_max, mileage_min, mileage_max):
    got = intent.parsed(spark.createDataFrame([(said,)], "query string")).first()
    assert (got.price_min, got.price_max, got.mileage_min, got.mileage_max) == (price_min, price_max, mileage_min, mileage_max)


def test_a_price_of_zero_scores_nothing(spark):
    row = spark.range(1).select(F.lit(0.0).alias("p"), F.lit(5.0).alias("cap"))
    assert row.select(ranking.price_points(F.col("p"), F.col("cap"), F.lit("city")).alias("x")).first().x == 0


def test_explicit_filters_and_labels(spark):
    row = spark.createDataFrame([(1, 5, 2)], "ABS int, Power int, Seats int")
    assert row.select(ranking.points(ranking.explicit_rules({"ABS": 1, "Power": 5, "Seats": 9, "None": 1}, row.columns)).alias("x")).first().x == 5
    assert [ranking.label(c) for c in ("Body_Type_MPV", "Fuel_Type_CNG", "Rear_Camera", "Android_Auto")] == ["mpv body type", "cng fuel preference", "Rear Camera", "Android Auto"]
    said = F.array(*map(F.lit, [" has ABS ", "HAS abs", "", "matches Rear_Camera", "matches requested body type", "a", "b", "c"]))
    assert row.select(ranking.cleaned_reasons(said, F.lit(None).cast("string")).alias("x")).first().x == ["has ABS", "Rear Camera", "requested body type", "a", "b"]


def test_filters_that_columns_decide(spark):
    rows = spark.createDataFrame([(1, "a", float("nan")), (2, "B", 2.0)], "Number_of_Airbags int, Drivetrain string, x double")
    assert filters.filtered(rows, {"Drivetrain": "b", "Fuel_Type": "petrol"}).count() == 1
    assert filters.hard_features(rows, {"Sunroof": 1, "Airbags": 1, "Cruise_Control": 1})[1] == ["Cruise_Control", "Sunroof"]
    assert filters.gated(rows, {"Sunroof": 1})[0].count() == 0 and filters.gated(rows, {"Airbags": 1})[1] is None
    assert [x.x for x in filters.json_safe(rows).collect()] == [None, 2.0]
    assert filters.conformed(rows, [("x", "double"), ("new", "string")]).columns == ["x", "new"]


def test_rules_of_fields(spark):
    cells = spark.createDataFrame([("engine_cc", "Electric", None), ("engine_cc", "petrol", None), ("battery_capacity_kwh", None, None), ("reliability_score", "cng", None), ("power_bhp", "cng", "90")], "field string, fuel string, value string")
    got = cells.select(rules.null_reason(F.col("field"), F.col("fuel"), F.col("value")).alias("x")).collect()
    assert [x.x for x in got] == ["NOT_APPLICABLE", "NOT_YET_ENRICHED", "NOT_APPLICABLE", "SUBJECTIVE_REQUIRES_DERIVATION", None]
    with pytest.raises(Exception, match="Unsupported null reason"):
        cells.select(rules.null_envelope(F.lit("WHY"), F.lit("")).alias("x")).collect()
    assert each(spark, ["x", "700", "90"], lambda c: rules.errors(F.lit("torque_nm"), F.lit("petrol"), c)) == [["torque_nm is not numeric"], [], []]


def test_conflicts(spark):
    kind = "g int, seq int, unit string, value_bool boolean, value_num double, scope string"
    rows = [(1, 1, "a", None, 5.0, None), (1, 2, "", None, 5.05, None), (1, 3, "b", None, 5.0, None), (2, 1, None, True, None, None), (2, 2, None, None, 1.0, None), (3, 1, None, None, None, "MODEL_LEVEL"), (3, 2, None, None, None, "VARIANT_LEVEL"), (4, 1, None, None, None, "VARIANT_LEVEL"), (4, 2, None, None, None, "MODEL_LEVEL")]
    got = {(x.g, x.left, x.right): x.reason for x in records.conflicts(spark.createDataFrame(rows, kind), ["g"], "seq").collect()}
    assert got == {(1, 1, 3): "unit mismatch", (2, 1, 2): "boolean disagreement", (3, 1, 2): "model-level vs variant-level contradiction"}


def test_classifier_learns_the_templates(spark, tmp_path):
    texts = model.generated(spark)
    assert texts.count() == texts.select("query").distinct().count() == 400
    train, test = texts.where("split = 'train'"), texts.where("split = 'test'")
    fitted = model.trained(train, "fuel_type")
    model.save(fitted, str(tmp_path / "m"))
    rows = model.predicted(model.load(str(tmp_path / "m")), test, "guess").collect()
    assert sum(x.guess == x.fuel_type for x in rows) > 0.9 * len(rows) > 30


def test_candidates_of_exact_variants(spark):
    good = "named_struct('make_match', true, 'model_match', true, 'fuel_match', true, 'transmission_match', true, 'special_edition_match', {})"
    rows = spark.createDataFrame([(1, "abs", False, None, "EXACT", True, "yes"), (2, "colour", True, "MODEL_LEVEL", "AMBIGUOUS", None, "")], "rid int, field string, inherited boolean, scope string, match_status string, value_bool boolean, proposed string")
    rows = rows.withColumn("match", F.when(F.col("rid") == 1, F.expr(good.format("true"))).otherwise(F.expr(good.format("false"))))
    got = [x.e for x in rows.select(build.variant_errors(["abs"], F.col("rid") == 1).alias("e")).collect()]
    assert got[0] == [] and len(got[1]) == 8 and "special_edition_match failed" in got[1]
    here, gone = build.targeted(rows, rows.where("rid = 1"), "rid")
    assert [x.rid for x in here.collect()] == [1] and [x.reason for x in gone.collect()] == ["candidate target record not found"]
    made = build.rule_candidates(rows.withColumn("model", F.col("field")), [("abs", "rid = 1", "abs", True), ("none", "true", "abs", True)], "rid").collect()
    assert [(x.rid, x.field, x.value) for x in made] == [(1, "abs", True)]


def test_null_sidecar(spark):
    cells = spark.createDataFrame([(1, "engine_cc", "electric", None), (1, "abs", "electric", "true"), (2, "abs", "petrol", "false")], "rid int, field string, fuel string, value string")
    got = {x.rid: x.nulls for x in build.sidecar(cells, "rid").collect()}
    assert got[2] is None and list(got[1]) == ["engine_cc"] and got[1]["engine_cc"].null_reason == "NOT_APPLICABLE"


def test_evaluated_and_reranked(spark):
    kind = "g int, seq int, unit string, value_bool boolean, value_num double, scope string, confidence double, errors array<string>"
    rows = [(1, 1, "a", None, 5.0, None, 0.9, []), (1, 2, "b", None, 5.0, None, 0.9, ["bad"]), (2, 1, "a", None, 1.0, None, 0.9, []), (2, 2, "b", None, 1.0, None, 0.9, []), (3, 1, "a", None, 1.0, None, 0.9, ["bad"])]
    got = {x.g: (x.status, x.seq) for x in records.evaluated(spark.createDataFrame(rows, kind), ["g"], [F.desc("confidence"), F.col("seq")]).collect()}
    assert got == {1: ("accepted", 1), 2: ("unresolved_conflict", None), 3: ("manual_review", None)}
    cars_ = spark.createDataFrame([(1, 50.0, 1.0), (2, 52.0, -1.0), (3, 51.0, None)], "k int, score double, s double")
    assert [x.k for x in ranking.reranked(cars_, F.col("s"), "k", 2).collect()] == [1, 3]


def test_balanced_json():
    for body in ('{"a": "}\\"{", "b": [1, {"c": "]"}]}', "{}", '[{"x": "\\\\"}]'):
        assert json.loads(pages.balanced("x" + body + "}tail", 1)) == json.loads(body)
    assert pages.balanced('{"a": "', 0) is None


def test_listings(spark):
    rows = spark.createDataFrame([("Maruti Alto 2015", None)], "title string, price string")
    both = listings.united({"A": rows, "B": rows})
    assert both.columns == [*listings.FIELDS, "source"] and {x.price for x in both.collect()} == {""}
    assert each(spark, ["10 km | petrol", None], listings.info_parts)[0].asDict() == {"km": "10 km", "fuel": "petrol", "location": None}
    assert each(spark, ["http://x/PLACEHOLDER.png", "data:image", "https://x/a.png"], listings.image_valid) == [False, False, True]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é, \"x\"", None), (2, None, 5)], "a int, b string, c int")
    files.write_csv(rows, str(tmp_path / "c"), ["b", "a", "missing"])
    back = files.csv(spark, str(tmp_path / "c"), "b string, a int, missing string").orderBy("a").collect()
    assert [tuple(x) for x in back] == [("é, \"x\"", 1, None), (None, 2, None)]
    files.write_json(rows, str(tmp_path / "j"))
    (tmp_path / "m" / "one").mkdir(parents=True)
    (tmp_path / "m" / "one" / "r.json").write_text(json.dumps([{"canonical_record": {"a": 7}, "version_id": "v"}]))
    got = files.unwrapped(files.json_by_folder(spark, str(tmp_path / "m" / "*" / "r.json"), "version_id string, canonical_record struct<a:int>")).collect()
    assert [(x.version_id, x.model_slug, x.a) for x in got] == [("v", "one", 7)]
    assert files.json_array(spark, str(tmp_path / "none*.json"), "a int", absent_ok=True).count() == 0
    assert files.json_array(spark, str(tmp_path / "m" / "one" / "r.json"), "version_id string").count() == 1
    (tmp_path / "p.html").write_bytes(b"<h1>a\n\xff</h1>")
    assert files.whole_texts(spark, str(tmp_path / "*.html")).count() == 1
    assert files.markdown(rows.select("a"), [F.col("a")]) == "| a |\n|---|\n| 1 |\n| 2 |\n"
    for n in (1, 2):
        files.append_log(spark.createDataFrame([("u", 200 + 300 * (n == 2))], "url string, status int").withColumn("fetched_at", F.lit("2024-01-01T00:10:00")), str(tmp_path / "log"))
    stream = fetch_log.by_hour(fetch_log.read(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("fetches").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert [(x.fetches, x.failures) for x in spark.table("fetches").collect()] == [(2, 1)]
