import json

import __spark_entry__ as entry

from quern.cli import main, parser
from quern.config import CleanConfig
from quern.plans.pipeline import run_pipeline
from quern.plans.specialize import detect_specialization


def test_end_to_end(spark, tmp_path):
    src = tmp_path / "s.csv"
    src.write_text("id;price;when;cat\n1;1,200.5;2021-01-01;a\n2;;2021-01-02;b\n3;900.0;2021-01-03;a\n4;1,000.0;2021-01-04;a\n")
    r = run_pipeline(spark, str(src), str(tmp_path / "o.parquet"), CleanConfig.preset("fast"), report_markdown=str(tmp_path / "r.md"), report_html=str(tmp_path / "r.html"))
    out = spark.read.parquet(r.output_path)
    assert out.count() == 4 and dict(out.dtypes)["when"] == "date" and dict(out.dtypes)["price"] in ("double", "float")
    assert out.where("price IS NULL").count() == 0
    assert "quality score" in (tmp_path / "r.md").read_text() and "<table>" in (tmp_path / "r.html").read_text()
    assert json.loads((tmp_path / "r.md.json").read_text())["summary"]["rows_out"] == 4


def test_presets():
    assert not CleanConfig.preset("fast").advanced and CleanConfig.preset("full") == CleanConfig()
    assert CleanConfig.preset("standard").modeling and not CleanConfig.preset("standard").fda


def test_cli(tmp_path):
    a = parser().parse_args(["-i", "x.csv", "--outliers", "iqr,zscore", "--no-charts"])
    assert a.outliers == ("iqr", "zscore")
    assert main(["-i", str(tmp_path / "missing.csv"), "-q"]) == 1


def test_archetypes(spark):
    geo = spark.createDataFrame([(45.0 + i, 9.0 + i, float(i)) for i in range(4)], "latitude double, longitude double, val double")
    assert detect_specialization(geo).geo == {"lat": "latitude", "lon": "longitude"}
    text = spark.createDataFrame([(f"this is a long comment number {i} about something that happened",) for i in range(30)], "comment string")
    assert detect_specialization(text).primary == "text"


def test_streaming_profile(spark, tmp_path):
    from quern.streaming import windowed_profile

    df = spark.sql("SELECT timestamp_seconds(1700000000 + id * 60) AS ts, CAST(id AS double) AS v FROM range(300)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_profile(stream, "ts", ["v"]).writeStream.format("memory").queryName("wp").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wp").count() == windowed_profile(df, "ts", ["v"]).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
