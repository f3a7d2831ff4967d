"""Whole-batch checks, reports and evaluation: examples."""

import json

import pytest
from pyspark.sql import functions as F

from veldspar.functions import model
from veldspar.operators import audits, filters, ranking, rules
from veldspar.sources import files


def test_coverage_sets_need_one_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None, "x"), (2, "a", "", None), (3, "b", "v", "x")], "k int, g string, f1 string, f2 string")
    rows.write.parquet(str(tmp_path / "t"))
    out = audits.coverage_sets(spark.read.parquet(str(tmp_path / "t")), "k", ["f1", "f2"], ["g", "f2"])
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.field, r.column, r.grp): (r.n, r.n_populated, r.pct) for r in out.collect()}
    assert got == {("f1", "g", "a"): (2, 0, 0.0), ("f1", "g", "b"): (1, 1, 100.0), ("f2", "g", "a"): (2, 1, 50.0), ("f2", "g", "b"): (1, 1, 100.0), ("f1", "f2", "x"): (2, 1, 50.0), ("f1", "f2", "UNKNOWN"): (1, 0, 0.0), ("f2", "f2", "x"): (2, 2, 100.0), ("f2", "f2", "UNKNOWN"): (1, 0, 0.0)}


RECORD = "id string, make string, model string, fuel_type string, engine_cc double, mileage_arai_kmpl double, airbags string, abs string, subset string, p map<string,struct<source_url:string,raw_value:string>>"


def checks(spark, rows, source=None):
    df = spark.createDataFrame(rows, RECORD)
    told = audits.output_violations(df, spark.createDataFrame(source or rows, RECORD), "id", ["make", "model"], ["make", "model"], ["airbags"], ["abs"], ["make"], [c for c in df.columns if c != "abs"], "p")
    return sorted((r.check, r.key, r.field) for r in told.collect()), {r.failure: r.n for r in audits.rollup_of(told).collect()}


def test_output_checks(spark):
    good = ("a", "m", "x", "petrol", 1200.0, 20.0, "6", None, "recommendation_ready", None)
    assert checks(spark, [good]) == ([("unknown", None, "abs")], {})
    rows = [good, ("b", "m", "x", "Electric", 1200.0, 20.0, "six", "yes", "excluded", {"airbags": ("u", ""), "abs": ("u", "r")}), ("c", None, "", "cng", 9000.0, 20.0, "", None, "recommendation_ready", None), ("c", "z", "q", None, None, None, None, None, "excluded", None)]
    got, failed = checks(spark, rows, [good, ("b", "other", *rows[1][2:]), ("c", "z", *rows[3][2:])])
    assert [g for g in got if g[1] == "b"] == [("boolean", "b", "abs"), ("implausible", "b", "engine_cc"), ("implausible", "b", "mileage"), ("numeric", "b", "airbags"), ("protected", "b", "make"), ("provenance", "b", "airbags")]
    assert [g for g in got if g[1] == "c"] == [("implausible", "c", "engine_cc"), ("implausible", "c", "mileage_arai_kmpl"), ("protected", "c", "make"), ("ready", "c", None), ("required", "c", "make,model")]
    assert ("duplicate", "m|x", None) in got and failed["duplicate canonical identities"] == 1 and set(failed) == set(audits.FAILURES.values())


def test_policy_cases_are_blocked_or_allowed(spark):
    policy = spark.createDataFrame([("gearbox_speeds", True, "POWERTRAIN_LEVEL", ["POWERTRAIN_LEVEL"]), ("boot_space_litres", True, "MODEL_LEVEL", ["MODEL_LEVEL"]), ("length_mm", True, "MODEL_LEVEL", ["MODEL_LEVEL"])], "field string, allowed boolean, expected_scope string, valid_source_scopes array<string>")
    got = {r.case: (r.decision.blocked, r.decision.reason) for r in audits.policy_cases(spark, policy).collect()}
    assert got == {
        "petrol_to_diesel": (False, "policy conditions satisfied"), "petrol_to_cng": (False, "policy conditions satisfied"), "ice_to_ev": (True, "inheritance not allowed by policy"),
        "manual_to_automatic_gearbox": (True, "powertrain mismatch on transmission"), "automatic_gearbox_type_mismatch": (True, "powertrain mismatch on transmission"), "model_dimensions_cross_model": (True, "make/model mismatch"),
    }


def test_direct_assignments_are_allowed(spark):
    same = {n: F.lit(False) for n in ("make", "model", "fuel_type", "engine_cc", "transmission", "variant")}
    made = audits.inheritance_decision(F.col("i"), F.lit(True), F.lit("MODEL_LEVEL"), F.array(F.lit("MODEL_LEVEL")), same)
    got = [r.d.asDict() for r in spark.createDataFrame([(None,), (False,), (True,)], "i boolean").select(made.alias("d")).collect()]
    assert got[0] == got[1] == {"allowed": True, "blocked": False, "reason": "direct exact-record assignment", "source_scope": None, "confidence_adjustment": None}
    assert got[2]["blocked"] and got[2]["reason"] == "make/model mismatch"


def test_metrics_come_with_the_write(spark, tmp_path):
    seen = audits.written_with_metrics(spark.range(10), str(tmp_path / "t"), {"n": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1)})
    assert seen == {"n": 10, "odd": 5} and spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_informative_entries_and_accuracy(spark):
    rows = spark.createDataFrame([("suv", "unknown", None, True), ("unknown", "diesel", 5, False)], "b string, f string, p int, s boolean")
    held = audits.informative({"body_type": F.col("b"), "fuel_type": F.col("f"), "price_max": F.col("p")}, {"sunroof": F.col("s")})
    got = [r.m for r in rows.select(held.alias("m")).collect()]
    assert got == [{"body_type": "suv", "sunroof": "true"}, {"fuel_type": "diesel", "price_max": "5"}]
    pairs = spark.createDataFrame([(got[0], {"body_type": "suv"}), (got[1], {"fuel_type": "cng", "price_max": "5"})], "e map<string,string>, f map<string,string>")
    assert {r.field: (r.total, r.correct) for r in audits.field_accuracy(pairs, "e", "f").collect()} == {"body_type": (1, 1), "sunroof": (1, 0), "fuel_type": (1, 0), "price_max": (1, 1), "all": (4, 2)}


def test_explicit_points_are_part_of_the_score(spark):
    from veldspar.plans import cars

    rows = cars._cars(spark, "/root/testdata/sf0.001").where("p_partkey < 20")
    asks = spark.createDataFrame([("family", 900000.0, None, None, None, False, False, False, {"seats": 5.0, "power": 7.0})], cars._ASK_COLUMNS + ", asked map<string,double>")
    for n in ("ventilated_seats", "cruise_control", "android_auto", "apple_carplay", "abs"):
        asks = asks.withColumn(f"asked_{n}", F.lit(False))
    both = rows.crossJoin(asks)
    plain, more = ({r.p_partkey: r for r in ranking.scored(both, a).collect()} for a in (None, "asked"))
    for k, r in more.items():
        hits = [n for n in ("seats", "power") if r[n] == {"seats": 5.0, "power": 7.0}[n]]
        assert r.score == pytest.approx(plain[k].score + 5 * len(hits)) and [x for x in r.reasons if x.startswith("matches ") and x[8:] in ("seats", "power")] == [f"matches {n}" for n in ("power", "seats") if n in hits] or not hits
    top = ranking.top_scored(both, ["use"], "p_partkey", 3, "asked").collect()
    assert [r.p_partkey for r in sorted(top, key=lambda r: r.rk)] == [k for k, _ in sorted(more.items(), key=lambda x: (-x[1].score, x[0]))][:3]
    assert all(r.reasons == more[r.p_partkey].reasons for r in top)


def test_response_has_fourteen_keys(spark):
    got = filters.response(spark.createDataFrame([("m", float("nan"), 3.0, ["a"])], "Make string, Power double, score double, reasons array<string>"))
    assert got.columns == filters.RESPONSE and len(got.columns) == 14
    assert got.first()["Power"] is None and got.first()["ranking_score"] == 3.0 and got.first()["match_reasons"] == ["a"]


def test_pretty_arrays_and_whole_reports(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}" if i % 2 else None) for i in range(1500)], "id int, name string")
    files.write_json_array(rows.limit(3), [F.col("id")], str(tmp_path / "a.json"))
    text = spark.read.text(str(tmp_path / "a.json"), wholetext=True).first().value
    got = json.loads(text)
    assert got == [{"id": 0, "name": None}, {"id": 1, "name": "n1"}, {"id": 2, "name": None}] and "\n  {" in text
    assert files.markdown(rows, [F.col("id")]).count("\n") == 1502
    files.write_markdown({"All": (rows.limit(2), [F.col("id")])}, "Report", str(tmp_path / "r.md"))
    assert spark.read.text(str(tmp_path / "r.md"), wholetext=True).first().value.startswith("# Report\n\n## All\n\n| id | name |")
    assert files.json_array(spark, str(tmp_path / "absent.json"), "a int", absent_ok=True).count() == 0
    with pytest.raises(ValueError, match="1500"):
        files.markdown(rows, [F.col("id")], most=1000)


def test_all_outputs_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, None, 0.5)], "id int, name string, score double")
    files.write_batch(str(tmp_path / "out"), "Batch", {"enriched": (rows, ["name", "id", "gone"])}, {"candidates": rows}, {"All rows": (rows, [F.col("id")])})
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "enriched.csv")).columns == ["name", "id", "gone"]
    assert spark.read.json(str(tmp_path / "out" / "candidates.json")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "out" / "report" / "All_rows.json"), wholetext=True).first().value)[0] == {"id": 1, "name": None, "score": 0.5}
    assert "## All rows" in spark.read.text(str(tmp_path / "out" / "report.md"), wholetext=True).first().value


def test_classifiers_share_their_features(spark):
    texts = model.generated(spark)
    models = model.trained_all(texts.where("split = 'train'"), ["fuel_type", "transmission"])
    rows = model.predicted_all(models, texts.where("split = 'test'")).collect()
    assert all(sum(r[f"guess_{t}"] == r[t] for r in rows) > 0.9 * len(rows) > 30 for t in ("fuel_type", "transmission"))
    alone = {r.query: r.g for r in model.predicted(models["fuel_type"], texts.where("split = 'test'"), "g").collect()}
    assert all(alone[r.query] == r.guess_fuel_type for r in rows)


def test_one_hot_features(spark):
    got = [r.x.asDict() for r in spark.createDataFrame([("abs",), (None,)], "f string").select(model.one_hot(F.col("f")).alias("x")).collect()]
    assert got == [{n: n == "abs" for n in model.FEATURES}, dict.fromkeys(model.FEATURES, False)]


def test_reasons_of_unfilled_cells(spark):
    rows = spark.createDataFrame([("kerb_weight_kg", None), ("boot_space_litres", "CNG"), ("fuel_tank_capacity_litres", "Electric"), ("boot_space_litres", "petrol"), ("airbags", None)], "f string, u string")
    got = [r.x for r in rows.select(rules.unresolved_reason(F.col("f"), F.col("u")).alias("x")).collect()]
    assert got == ["FIELD_NOT_PUBLISHED", "UNSAFE_TO_INHERIT", "NOT_APPLICABLE", "SOURCE_UNAVAILABLE", "SOURCE_UNAVAILABLE"]
