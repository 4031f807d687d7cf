import pytest

from vellum.llm import lookalikes


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", "\x85", "\u2028", "\u2029"])
def test_a_final_line_end_is_a_blank(spark, end):
    labels = spark.createDataFrame([("Total",)], "label_text string")
    rows = [("t", 1, "f", "12.5" + end, "figure"), ("t", 2, "f", "Total" + end, "label"), ("t", 3, "f", "12.5", "figure")]
    cells = spark.createDataFrame(rows, "record_table string, record_id long, field_name string, text string, kind string")
    assert {r["record_id"]: r["plain_text"] for r in lookalikes.find_lookalikes(cells, labels).collect()} == {1: "12.5", 2: "Total"}
