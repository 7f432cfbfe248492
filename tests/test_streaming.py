import datetime as dt

import pytest

from chronofold import DynamicGroupBySettings, ExtractionSettings
from chronofold.streaming.windows import stream_features


def test_stream_matches_its_rows(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, m), float(m)) for m in range(10)] + [("b", dt.datetime(2024, 1, 1, 0, 3), None)]
    spark.createDataFrame(rows, "id string, t timestamp, v double").write.parquet(str(tmp_path / "in"))
    settings = ExtractionSettings(["id"], ["v"], dynamic_settings=DynamicGroupBySettings("t", "5 minutes", "5 minutes"))
    stream = spark.readStream.schema("id string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = stream_features(stream, settings, "1 hour").writeStream.outputMode("complete").format("memory").queryName("features").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["id"], r["t"].minute): r for r in spark.table("features").collect()}
    assert got["a", 0]["v__sum_values"] == 10 and got["a", 5]["v__maximum"] == 9 and got["b", 0]["length"] == 0
    with pytest.raises(ValueError):
        stream_features(stream, settings, "1 hour", ("c3",))
