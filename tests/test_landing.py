"""Landed documents with faults, and database tables read in ranges."""

import json
from datetime import date

from shelfwise.sources import readers

GOOD = {"is_forecast": False, "daily": {"time": ["2026-01-01", "2026-01-02"], "temp_max": [40.0, None], "temp_min": [20.0, 21.5],
                                        "precipitation": [0.1, 0.0], "snowfall_cm": [2.54, None]}}


def changed(**daily):
    return json.dumps({**GOOD, "daily": {**GOOD["daily"], **daily}})


def checked(spark, folder, **kw):
    return readers.checked_weather(readers.landed_documents(spark, str(folder), **kw))


def test_one_fault_does_not_stop_the_others(spark, tmp_path):
    texts = [json.dumps(GOOD), json.dumps(GOOD)[:40], "  ", '{"is_forecast": true}', changed(snowfall_cm=[1.0]),
             changed(time=["2026-01-01", "soon"]), changed(temp_max=None), changed(temp_min=[]), '{"is_forecast": false, "daily": 7}']
    (tmp_path / "a.json").write_text("\n".join(texts))
    docs = checked(spark, tmp_path)
    aside = sorted((r.reason, r.document) for r in readers.quarantined(docs).collect())
    assert aside == sorted([("unreadable", texts[1]), ("missing array", texts[3]), ("unequal arrays", texts[4]), ("unreadable day", texts[5]),
                            ("missing array", texts[6]), ("unequal arrays", texts[7]), ("unreadable", texts[8])])
    assert {r.file.rsplit("/", 1)[1] for r in readers.quarantined(docs).collect()} == {"a.json"}
    rows = sorted(map(tuple, readers.accepted_weather(docs).select("log_date", "temp_max_f", "temp_min_f", "snowfall_in").collect()))
    assert rows == [(date(2026, 1, 1), 40.0, 20.0, 1.0), (date(2026, 1, 2), None, 21.5, None)]


def test_documents_over_several_lines(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(GOOD, indent=2))
    (tmp_path / "two.json").write_text(json.dumps(GOOD, indent=2)[:-20])
    docs = checked(spark, tmp_path, whole_files=True)
    assert readers.accepted_weather(docs).count() == 2
    assert [r.file.rsplit("/", 1)[1] for r in readers.quarantined(docs).collect()] == ["two.json"]


def test_mended_documents_land_again(spark, tmp_path):
    """What the quarantine keeps is the whole text: mended and landed again, it is read."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.json").write_text(changed(snowfall_cm=[1.0]))
    (kept,) = readers.quarantined(checked(spark, tmp_path / "a")).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.json").write_text(kept.document.replace('"snowfall_cm": [1.0]', '"snowfall_cm": [1.0, 0.0]'))
    assert readers.accepted_weather(checked(spark, tmp_path / "b")).count() == 2


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    docs = checked(spark, tmp_path)
    assert readers.accepted_weather(docs).count() == readers.quarantined(docs).count() == 0


def test_a_table_is_read_in_ranges(spark):
    """Through an embedded database, which only the one process of a local session can open."""
    url = "jdbc:derby:memory:landing;create=true"
    source = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    source.write.format("jdbc").options(url=url, dbtable="orders").mode("overwrite").save()
    read = readers.read_jdbc_ranges(spark, url, "orders", "o_orderkey", 6)
    assert read.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, source.collect()))
    assert max(read.rdd.glom().map(len).collect()) < source.count() / 3
    few = read.where("o_custkey = 7").select("o_orderkey")
    assert "PushedFilters: [*IsNotNull(O_CUSTKEY), *EqualTo(O_CUSTKEY,7)]" in few._jdf.queryExecution().executedPlan().toString().replace("o_custkey", "O_CUSTKEY")
    assert few.count() == source.where("o_custkey = 7").count()
    by_day = readers.read_jdbc_ranges(spark, url, "orders", "o_orderdate", 3)
    assert by_day.count() == source.count() and by_day.rdd.getNumPartitions() == 3
    spark.createDataFrame([], source.schema).write.format("jdbc").options(url=url, dbtable="nothing").mode("overwrite").save()
    assert readers.read_jdbc_ranges(spark, url, "nothing", "o_orderkey", 6).count() == 0
