"""Files beside the tables are read and written."""

import json

import pytest
from pyspark.errors import AnalysisException

from evidentia.sources.reports import read_golden, read_manifest, read_vocabulary, write_summary


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"tenant_id": "t", "coverages": {"a": {"coverage_id": "1", "documents": {}}, "b": {"coverage_id": "2"}}}, indent=2))
    assert {tuple(r) for r in read_manifest(spark, str(tmp_path / "m.json")).collect()} == {("a", "1"), ("b", "2")}
    with pytest.raises(AnalysisException):
        read_manifest(spark, str(tmp_path / "none.json"))
    (tmp_path / "g.json").write_text(json.dumps({"test_cases": [{"test_id": "x", "min_word_count": 3}, {"test_id": "y"}]}, indent=1))
    assert [tuple(r) for r in read_golden(spark, str(tmp_path / "g.json"), "test_id: string, min_word_count: int").collect()] == [("x", 3), ("y", None)]
    (tmp_path / "v.yaml").write_text("industries:\n  mining:\n    kpis:\n      - ore_grade\n      - output\n  retail:\n    kpis:\n      - store_count\n")
    assert {tuple(r) for r in read_vocabulary(spark, str(tmp_path / "v.yaml")).collect()} == {("mining", "ore_grade"), ("mining", "output"), ("retail", "store_count")}
    write_summary(spark.createDataFrame([("a", 0.5)], "agent string, pass_rate double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().pass_rate == 0.5
