import math

from chronofold.operators import post
from chronofold.sources.readers import read_csv, read_stations, write_table


def rows(spark):
    return spark.createDataFrame([("a", 1.0, float("nan")), ("b", 2.0, 1.0), ("c", 3.0, 1.0)], "id string, `v__r_0.5` double, w double")


def test_cleaning_and_scaling(spark):
    clean = post.drop_null_columns(post.nan_to_null(rows(spark), ["id"]), ["id"])
    assert clean.columns == ["id", "v__r_0.5"]
    z = sorted(post.zscore(clean, ["id"]).collect())
    assert [round(r[1], 6) for r in z] == [-1.0, 0.0, 1.0]


def test_search_and_clusters(spark):
    df = spark.createDataFrame([(k, math.cos(k), math.sin(k)) for k in range(6)], "id int, x double, y double")
    best = post.cosine_top_k(df, ["x", "y"], {"x": 1.0, "y": 0.0}, 2, ["id"]).collect()
    assert [r["id"] for r in best] == [0, 1] or [r["id"] for r in best] == [0, 6 - 1]
    assert post.kmeans(df, ["x", "y"], 2).select("cluster").distinct().count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,open\na,1.5\nb,\n")
    assert read_csv(spark, str(tmp_path / "s.csv"), drop_nulls=True).collect()[0]["open"] == 1.5
    assert read_csv(spark, str(tmp_path / "s.csv"), "Name string, open double").count() == 2
    (tmp_path / "w.txt").write_text("Oslo;-3.5\nRom;20\n")
    assert read_stations(spark, str(tmp_path / "w.txt")).agg({"temperature": "sum"}).first()[0] == 16.5
    write_table(rows(spark), str(tmp_path / "out"), rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
