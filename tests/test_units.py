import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions.forest import fit_forest, isotonic
from vellum.operators import units

SCHEMA = "record_table string, record_key string, figure string, unit string, column_label string, row_label string, section string, category string, source string, kind string"


def convert(spark, rows):
    df = spark.createDataFrame([("t", str(i), *r) for i, r in enumerate(rows)], SCHEMA)
    out = units.convert_units(df).collect()
    return {int(r["record_key"]): r for r in out}


def row(figure=None, unit=None, column=None, label=None, section=None):
    return (figure, unit, column, label, section, "note_cost", "fdisc", "clash")


def test_units_are_read_from_every_place_in_order(spark):
    rows = [
        row("1.5亿元", "万元"), row("2", "万元", "x（元）"), row("3", None, "采购额, RMB 10,000", "y（元）"), row("4", "", "x", "利差（单位：bps）", "单位：元"), row("5", None, None, None, "金额单位：千元　币种：人民币"),
        row("(1 234.5)", "（百万元）"), row("−7", "kg"), row("０．６７亿", None), row("9", "万元（合并口径）"), row("8", "in ‰"), row("1.2E8", "元"), row("3", "比例(小数)"),
    ]
    got = convert(spark, rows)
    want = {0: ("CNY", 15_000_000_000), 1: ("CNY", 2_000_000), 2: ("CNY", 3_000_000), 3: ("percent", 4), 4: ("CNY", 500_000), 5: ("CNY", -123_450_000_000), 6: ("t", -1), 8: ("CNY", 9_000_000), 9: ("percent", 80), 10: ("CNY", 12_000_000_000), 11: ("percent", 30_000)}
    for k, (base, value) in want.items():
        assert (got[k]["base_unit"], got[k]["base_value"]) == (base, value), k
    assert got[7]["status"] == "scale" and got[7]["base_value"] == 6_700_000_000


def test_what_is_no_case(spark):
    got = convert(spark, [row("5", "万美元"), row("1", "元/股"), row("3", "次"), row("n/a", "万元"), row(None, "元"), row("", "元"), row("x" * 100_000, "元"), row("6", "元")])
    assert [got[i]["status"] for i in range(8)] == ["other", "other", "other", "none", "none", "none", "none", "stated"]
    spark_rows = units.converted_figures(spark.createDataFrame([("t", "1", "f", 1.0, "unit", "stated", "CNY", 1.0, 5, 1.0)], "record_table string, record_key string, figure string, number double, unit_from string, status string, base_unit string, factor double, base_value long, confidence double"))
    assert spark_rows.count() == 0


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("t", "1", *row("2", "万元"))] * 3, SCHEMA)
    assert units.convert_units(df).count() == 3
    assert units.converted_figures(units.convert_units(df)).collect() == [("t", "1", "CNY", 2_000_000)]
    assert units.convert_units(df.limit(0)).count() == 0


def test_agent_units_with_two_parts(spark):
    cells = spark.createDataFrame([], "proof_id long, cell_value string, unit string, column_label string, row_label string, section string, table_type string, document_key string")
    facts = [("c1", "q", "calculate", "s", [("f1", None, ["112,196.0", "1121.96"], "RMB million/亿元"), ("f2", None, None, "元"), ("f3", None, ["2"], "元/股")])]
    cases = spark.createDataFrame(facts, "case_id string, query string, task_type string, source string, expected_facts array<struct<fact_id:string,description:string,acceptable_values:array<string>,unit:string>>")
    got = {r["record_key"]: r for r in units.convert_units(units.figures(cells, cases)).collect()}
    assert got["c1#f1"]["base_value"] == 11_219_600_000_000 and got["c1#f2"]["status"] == "none" and got["c1#f3"]["status"] == "other"


def test_uncertain_multipliers_and_unknown_spellings_are_reviewed(spark):
    """A bare multiplier is converted from the confidence on; what no lexicon knows never is."""
    rows = spark.createDataFrame([("t", "1", *row("0.67亿")), ("t", "2", *row("5", "亿里亚尔")), ("t", "3", *row("5", "蒲式耳"))], SCHEMA)
    one = fit_forest(np.zeros((40, 1)), np.array(["CNY"] * 40))
    model = units.UnitModel(one, one)
    for least, status in ((0.5, "scale"), (1.5, "review")):
        got = {r["record_key"]: (r["status"], r["base_value"]) for r in units.convert_units(rows, model=model, confident=least).collect()}
        assert got["1"] == (status, 6_700_000_000 if status == "scale" else None) and got["2"] == ("review", None) and got["3"] == ("review", None)


def test_kinds_of_multipliers_are_told(spark):
    """Held-out accuracy and coverage: of stated units with a multiplier only the multiplier is left."""
    cells = spark.read.parquet("/root/testdata/sf0.01/cell_proofs.parquet")
    cases = spark.read.parquet("/root/testdata/sf0.01/agent_cases.parquet").limit(0)
    rows = units.figures(cells, cases).where("unit <> ''").distinct()
    half = lambda k: rows.where(F.pmod(F.xxhash64("record_key"), F.lit(2)) == k)
    model = units.fit_unit_model(half(0))
    truth = units.stated_units(half(1)).where("scale > 0 and unit_from = 'unit' and kind not in ('percent', '', '?', '!')").select("record_key", "kind", "scale")
    word = F.create_map(*[F.lit(x) for w, n in units.ZH_SCALES.items() if w for x in (len(str(n)) - 1, w)])
    bare = half(1).join(truth, "record_key").withColumn("unit", F.element_at(word, F.col("scale"))).withColumn("column_label", F.lit(None).cast("string")).drop("kind", "scale")
    got = units.convert_units(bare, model=model).join(truth, "record_key")
    n, told = got.count(), got.where("status = 'scale'").count()
    right = got.where("status = 'scale' and base_unit = kind").count()
    assert n > 300 and told > 0.5 * n and right >= 0.93 * told


def test_forest_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, "a", "b")
    forest = fit_forest(x[:2000], y[:2000])
    p = forest.probabilities(x[2000:])
    right = forest.classes[p.argmax(axis=1)] == y[2000:]
    assert right.mean() > 0.9
    sure = forest.confidence(p.max(axis=1)) >= 0.95
    assert sure.any() and right[sure].mean() > 0.93
    assert fit_forest(np.zeros((0, 6)), np.array([])).probabilities(x[:3]).shape == (3, 1)


def test_isotonic_rises():
    _, level = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1, 0, 0, 1]))
    assert list(level) == sorted(level)


def test_predicted_units_are_mostly_right(spark):
    """Held-out accuracy: the unit fields of known figures are hidden and predicted again."""
    cells = spark.read.parquet("/root/testdata/sf0.01/cell_proofs.parquet")
    cases = spark.read.parquet("/root/testdata/sf0.01/agent_cases.parquet").limit(0)
    rows = units.figures(cells, cases).where("unit <> ''").distinct()
    model = units.fit_unit_model(rows.where(F.pmod(F.xxhash64("record_key"), F.lit(2)) == 0))
    held = rows.where(F.pmod(F.xxhash64("record_key"), F.lit(2)) == 1)
    truth = units.convert_units(held, model=model).where("status = 'stated' and unit_from = 'unit'").select("record_key", F.col("base_unit").alias("true_unit"), F.col("factor").alias("true_factor"))
    bare = held.withColumn("unit", F.lit(None).cast("string"))
    got = units.convert_units(bare, model=model).where("status = 'predicted'").join(truth, "record_key")
    n, right = got.count(), got.where("base_unit = true_unit and factor = true_factor").count()
    assert n > 30 and right / n > 0.85


@pytest.mark.parametrize("text,key", [("单位：万元", "万元"), ("(RMB'000)", "rmb'000"), ("in 10 MWh", "10mwh"), ("㎡", "m2"), ("个百分点", "百分点")])
def test_unit_keys(spark, text, key):
    assert spark.createDataFrame([(text,)], "u string").select(units.unit_key(F.col("u"))).first()[0] == key
    assert key in set(units.lexicon()["key"])
