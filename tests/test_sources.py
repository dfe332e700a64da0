import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import at, frame
from tidemark.sources import models as MS, stations, tables, weather


def test_s1_weather_files(spark, tmp_path):
    (tmp_path / "siteA").mkdir()
    doc = {"properties": {"parameter": {"T2M": {"2024010100": 1.5, "2024010101": -999.0}, "RH2M": {"2024010100": 40.0, "2024010101": 41.0}}}}
    (tmp_path / "siteA" / "2024.json").write_text(json.dumps(doc, indent=1))
    got = weather.read_weather(spark, str(tmp_path / "*"), ("T2M", "RH2M")).orderBy("ts").collect()
    assert [tuple(r) for r in got] == [("siteA", at(0), 1.5, 40.0), ("siteA", at(1), None, 41.0)]


def test_s1_empty_payload_is_an_error(spark):
    d = frame(spark, "series_id STRING, value STRING", [("a", '{"properties": {"parameter": {}}}')])
    with pytest.raises(PySparkException):
        weather.parse_weather(d).collect()


def test_s3_report_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text('"STATION","DATE","TMP","DEW","SLP"\n"1","2020-01-01T00:00:00","+0123,1","+0010,1","10132,1"\n"1","x"\n')
    r = stations.read_reports(spark, str(tmp_path), ["STATION", "DATE", "TMP", "DEW", "SLP"]).collect()
    assert [tuple(x) for x in r] == [("2020-01-01T00:00:00", "+0123,1", "+0010,1", "10132,1")]


def test_s6_interim_keeps_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("series_id,ts,x\nq,2024-01-01 00:00:00,1\nq,2024-01-01 00:00:00,2\n")
    (tmp_path / "b.csv").write_text("series_id,ts,x\nq,2024-01-01 00:00:00,3\nq,2024-01-01 01:00:00,4\n")
    d = tables.read_interim(spark, str(tmp_path), "series_id STRING, ts TIMESTAMP_NTZ, x DOUBLE")
    assert [r["x"] for r in d.orderBy("ts").collect()] == [1.0, 4.0]


def test_s7_year_partitions_prune(spark, tmp_path):
    d = frame(spark, "ts TIMESTAMP_NTZ, x DOUBLE", [(at(0), 1.0), (at(24 * 400), 2.0)])
    tables.write_table(d, str(tmp_path / "t"), "ts")
    assert spark.read.parquet(str(tmp_path / "t")).where("year = 2025").first()["x"] == 2.0


def test_s8_summary(spark):
    d = frame(spark, "h INT, model STRING, rmse DOUBLE", [(24, "a", 1.0), (24, "b", 2.0)])
    assert json.loads(tables.summary_json(d, ["h"], "model", ["rmse"]).first()["summary"]) == {"a": {"rmse": 1.0}, "b": {"rmse": 2.0}}


def test_s9_model_cache(spark, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return frame(spark, "w DOUBLE", [(float(len(calls)),)])

    path = str(tmp_path / "models")
    k1, k2 = MS.fingerprint(beta=0.5), MS.fingerprint(beta=0.6)
    assert MS.load_or_fit(spark, path, k1, fit)[1] is False
    got, hit = MS.load_or_fit(spark, path, k1, fit)
    assert hit and got.first()["w"] == 1.0
    assert MS.load_or_fit(spark, path, k2, fit)[0].first()["w"] == 2.0 and len(calls) == 2


def test_s10_dashboard_rows(spark):
    d = frame(spark, "a DOUBLE, b STRING", [(1.26, "x")])
    assert tuple(tables.dashboard_rows(d, {"b": None, "a": 1}).first()) == ("x", 1.3)


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from tidemark import session

    class Conf:
        def get(self, _):
            return None

    class Ctx:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Fake:
        sparkContext = Ctx()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Fake())
