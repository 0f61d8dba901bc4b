"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from siteloom.sources import readers, writers


def test_masts(spark, tmp_path):
    (tmp_path / "m.csv").write_text('name,state,lat,lon,height,commissioned,complete\n A ,X,8.5,77.1,50,3/4/98,yes\nB,X,,77,20,1/1/2001,no\nC,Y,abc,70,1,31/2/20,\n"D, E",Y,9,70,,1-12-29,N\n')
    got = [tuple(r) for r in readers.read_masts(spark, str(tmp_path / "m.csv")).select("name", "lat", F.col("commissioned").cast("string"), "complete").collect()]
    assert got == [("A", 8.5, "1998-04-03", True), ("D, E", 9.0, "2029-12-01", False)]


def test_features(spark, tmp_path):
    point = lambda x, **p: {"type": "Feature", "properties": p, "geometry": {"type": "Point", "coordinates": [x, 1.5]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [point(1.0, Name="n1"), point(2.0, NAME=" ")]}))
    (tmp_path / "b.jsonl").write_text("[\n" + json.dumps(point(3.0, kind="k")) + ",\nnot json\n\x1e" + json.dumps(point(4.0)) + "\n]\n")
    whole = readers.points(readers.read_feature_collection(spark, str(tmp_path / "a.geojson")))
    assert [(r["lon"], r["lat"]) for r in whole.orderBy("lon").collect()] == [(1.0, 1.5), (2.0, 1.5)]
    assert [r["n"] for r in whole.orderBy("lon").select(readers.first_property(F.col("properties"), "name", "title").alias("n")).collect()] == ["n1", ""]
    lines = readers.read_feature_lines(spark, str(tmp_path / "b.jsonl"))
    assert lines.where("skipped").count() == 1 and lines.where("NOT skipped").count() == 2


def test_hourly(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"site": "s", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "speed": [1.0, None], "direction": [10.0, 20.0]}}))
    assert [(r["speed"], r["direction"]) for r in readers.read_hourly(spark, str(tmp_path / "h.json")).collect()] == [(1.0, 10.0), (None, 20.0)]
    (tmp_path / "bad.json").write_text(json.dumps({"site": "s", "hourly": {"time": ["2024-01-01T00:00"], "speed": [], "direction": [1.0]}}))
    with pytest.raises(Exception, match="unequal"):
        readers.read_hourly(spark, str(tmp_path / "bad.json")).collect()


def test_rss(spark):
    feed = "<rss><item><title><![CDATA[Wind & sun]]></title><guid>g1</guid><pubDate>d</pubDate><description>a<b>c</b></description></item></rss>"
    row = readers.rss_items(spark.createDataFrame([(feed,)], "value string")).first()
    assert (row["title"], row["link"], row["summary"]) == ("Wind & sun", "g1", "ac")


def test_grid_cells(spark):
    found = readers.grid_cells(spark, 0.0, 0.0, 2.5, 1.0, 1.0).orderBy("west").collect()
    assert [(r["west"], r["east"]) for r in found] == [(0.0, 1.0), (1.0, 2.0), (2.0, 2.5)]


def test_upsert_insert_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    writers.replace_all(make([(1, "a"), (2, "b")]), path)
    writers.upsert_table(make([(2, "c"), (3, "d")]), path, ["k"])
    writers.insert_table(make([(3, "x"), (4, "e")]), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d"), (4, "e")}


def test_partitions_archive_cache_cap_export(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda *x: spark.createDataFrame(list(x), "s string, v long")
    writers.replace_partitions(rows(("a", 1), ("b", 2)), path, ["s"])
    writers.replace_partitions(rows(("b", 9)), path, ["s"])
    assert {(r["s"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}
    runs = str(tmp_path / "r")
    for day, value in (("2024-01-01", 1), ("2024-01-02", 2)):
        writers.archive(rows(("a", value)), runs, day)
    assert writers.latest_run(spark, runs).first()["v"] == 2
    asked = rows(("a", 1), ("b", 2))
    known = writers.cache_misses(asked.where("s = 'a'"), spark.createDataFrame([], "cache_key string"), "s", "1")
    assert [r["s"] for r in writers.cache_misses(asked, known, "s", "1").collect()] == ["b"]
    saved = spark.createDataFrame([("u", i, i // 2) for i in range(6)], "user_id string, id long, created_at long")
    assert sorted(r["id"] for r in writers.within_cap(saved).collect()) == [0, 1, 2]
    writers.write_csv(spark.createDataFrame([('say "x", y',)], "c string"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').first()["c"] == 'say "x", y'
    line = writers.geojson_points(spark.createDataFrame([(1.123456789, 2.0, "n")], "x double, y double, name string"), "x", "y", ["name"]).first()["value"]
    assert json.loads(line)["geometry"]["coordinates"] == [1.12346, 2.0]


def test_tenders_kml_capacity(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = row("1", "SECI000123", "<b>Tender for 1,200 MW offshore wind projects in the gulf</b>", "x", "y", "z") + row("2", "Supply of 50 MW of plain solar modules, long title", "a", "b", "c", "d") + "<!--" + row(*["hidden wind tender with a very long title"] * 6) + "-->" + row("short", "row")
    got = [tuple(r) for r in readers.tenders(spark.createDataFrame([(page,)], "html string")).collect()]
    assert got == [("Tender for 1,200 MW offshore wind projects in the gulf", 1200, "offshore")]
    kml = "<kml><Placemark><name> A </name><Polygon><coordinates>\n77,8,0 78,8,0\n77,9 bad </coordinates></Polygon></Placemark></kml>"
    found = readers.kml_rings(spark.createDataFrame([(kml,)], "value string")).first()
    assert found["name"] == "A" and [(p["x"], p["y"]) for p in found["ring"]] == [(77.0, 8.0), (78.0, 8.0), (77.0, 9.0)]
    text = "head\nGujarat 1 12,345.5 3\nKerala none\n"
    assert spark.range(1).select(readers.state_capacity(F.lit(text), ["Gujarat", "Kerala", "Goa"]).alias("m")).first()["m"] == {"Gujarat": 12345.5}
