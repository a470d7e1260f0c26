"""Reports hold their tables whole."""

import json

import pytest

from quillmark.sources import sinks as O


def test_no_row_of_a_metric_table_is_left_out(spark, tmp_path):
    path = str(tmp_path / "m.json")
    codes = spark.range(10_050).selectExpr("lpad(id, 5, '0') AS code", "id AS tp")
    O.write_metrics({"per_code": codes, "set": spark.range(1)}, path)
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["set"] == {"id": 0} and spark.read.parquet(m["per_code"]["parquet"]).distinct().count() == 10_050
    with pytest.raises(ValueError, match="sweep"):
        O.write_metrics({"sweep": codes}, path)
