import json
import sys
import types
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, LessThanOrEqual

from airloom.operators import retrieval as RT
from airloom.sources import demo, files, index_store, rest, station_json as J
from airloom.sources.tables import documents_as_pages
from airloom.streaming import flows, sink

AS_OF = "2024-06-30T00:00:00Z"


def bodies(spark, results, **cols):
    row = {"body": json.dumps({"results": results}), **cols}
    return spark.createDataFrame([tuple(row.values())], list(row))


def station(i, last, sensors=None, **kw):
    out = {"id": i, "name": f"s{i}", "coordinates": {"latitude": 1.5, "longitude": 2.5}, "sensors": sensors, **kw}
    if last is not None:
        out["datetimeLast"] = {"utc": last}
    return out


def sensor(i, name, units="µg/m³"):
    return {"id": i, "parameter": {"name": name, "units": units}}


def test_locations(spark):
    b = bodies(spark, [
        station(1, "2024-06-29T00:00:00Z", [sensor(7, "pm25"), sensor(9, "pm25"), sensor(8, ""), {"id": 5}], country={"code": "IN"}),
        station(2, None), station(3, "not a date"), station(4, "2024-01-01T00:00:00Z")])
    rows = {r.id: r for r in J.locations(b, F.lit(AS_OF).cast("timestamp")).collect()}
    assert set(rows) == {1, 3}
    assert rows[1].parameters == ["pm25"] and rows[1].country == "IN" and len(rows[1].sensors) == 4
    assert rows[3].sensors == [] and rows[3].locality == ""
    s = J.sensor_table(J.locations(b, F.lit(AS_OF).cast("timestamp")))
    assert sorted(r.sensor_id for r in s.collect()) == [7, 9]


def test_latest_and_series(spark):
    s = spark.createDataFrame([(1, "st", 7, "pm25", "µg/m³")], "location_id bigint, location string, sensor_id bigint, parameter string, units string")
    b = bodies(spark, [{"sensorsId": 7, "value": 4.0, "datetime": {"utc": "2024-06-29T10:00:00Z"}},
                       {"sensorsId": 7, "value": 5.0, "datetime": "2024-06-29T11:00:00Z"},
                       {"sensorsId": 99, "value": 6.0, "datetime": None}], location_id=1)
    rows = J.station_latest(b, s, 1).orderBy("date_utc").collect()
    assert [(r.value, r.date_utc.hour) for r in rows] == [(4.0, 10), (5.0, 11)]
    assert J.latest_city(b, s).first().value == 5.0
    m = bodies(spark, [{"value": None}, {"value": 1.0, "period": {"datetimeFrom": {"utc": "2024-06-29T10:20:00Z"}}},
                       {"value": 3.0, "period": {"datetimeFrom": {"utc": "2024-06-29T10:40:00Z"}}, "parameter": {"name": "pm25", "units": "ppm"}},
                       {"value": 9.0, "period": {"datetimeFrom": {"utc": "2024-06-01T10:40:00Z"}}}], sensor_id=7)
    assert J.series_readings(m, s).count() == 3
    h = J.hourly_readings(m, s, F.lit("2024-06-29T12:00:00Z").cast("timestamp")).collect()
    assert [(r.value, r.location) for r in h] == [(2.0, "1 stations")]


def test_rest_partitions(monkeypatch):
    seen = []

    class Answer:
        def __init__(self, url): seen.append(url)
        def __enter__(self): return self
        def __exit__(self, *a): return False
        def read(self): return b'{"results": []}'

    monkeypatch.setattr(rest.urllib.request, "urlopen", lambda req, timeout: Answer((req.full_url, req.headers, timeout)))
    options = {"endpoints": json.dumps(rest.latest_endpoints([3, 4])), "api_key": "k", "base": "http://x"}
    reader = rest.StationApi(options).reader(None)
    parts = reader.partitions()
    assert [p.path for p in parts] == ["locations/3/latest", "locations/4/latest"]
    assert list(reader.read(parts[0])) == [("locations/3/latest", "3", '{"results": []}', None)]
    assert seen[0][0] == "http://x/locations/3/latest?limit=100" and seen[0][1]["X-api-key"] == "k" and seen[0][2] == 25.0
    monkeypatch.setattr(rest.urllib.request, "urlopen", lambda *a, **k: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        list(reader.read(parts[0]))
    assert list(rest.StationApi({**options, "on_error": "row"}).reader(None).read(parts[0])) == [
        ("locations/3/latest", "3", None, "OSError: down")]


def test_rest_pages(monkeypatch):
    asked = []

    class Answer:
        def __init__(self, n): self.n = n
        def __enter__(self): return self
        def __exit__(self, *a): return False
        def read(self): return json.dumps({"results": list(range(self.n)), "n": len(asked)}).encode()

    def opened(req, timeout):
        asked.append(req.full_url)
        return Answer([2, 1, 1, 0][len(asked) - 1])  # a server may give fewer results a page

    monkeypatch.setattr(rest.urllib.request, "urlopen", opened)
    reader = rest.StationApi({"endpoints": json.dumps([{"path": "x", "params": {"limit": 2}}]), "base": "http://x"}).reader(None)
    assert len(list(reader.read(reader.partitions()[0]))) == 3
    assert asked == ["http://x/x?limit=2", "http://x/x?limit=2&page=2", "http://x/x?limit=2&page=3", "http://x/x?limit=2&page=4"]
    with pytest.raises(ValueError):
        list(rest.StationApi({"endpoints": json.dumps([{"path": "x"}])}).reader(None).read(rest.Endpoint("x", {}, None)))


def test_rest_repeated_page_ends(monkeypatch):
    class Answer:
        def __enter__(self): return self
        def __exit__(self, *a): return False
        def read(self): return b'{"results": [1]}'

    monkeypatch.setattr(rest.urllib.request, "urlopen", lambda req, timeout: Answer())
    reader = rest.StationApi({"base": "http://x"}).reader(None)
    assert len(list(reader.read(rest.Endpoint("x", {"limit": 5}, None)))) == 1


def test_sensor_days_push_filters(monkeypatch):
    asked = []

    class Answer:
        def __init__(self, days): self.days = days
        def __enter__(self): return self
        def __exit__(self, *a): return False
        def read(self): return json.dumps({"results": [{"value": 1, "period": {"datetimeFrom": {"utc": f"{d}T00:00:00Z"}}} for d in self.days]}).encode()

    def opened(req, timeout):
        asked.append(req.full_url)
        return Answer([] if "page=" in req.full_url else ["2024-01-04", "2024-01-05", "2024-01-06", "2024-02-01"])

    monkeypatch.setattr(rest.urllib.request, "urlopen", opened)
    day = lambda d: date(2024, 1, d)
    reader = rest.SensorDays({"sensors": "[3, 4, 5]", "base": "http://x", "days": "2", "date_to": "2024-01-31"}).reader(None)
    other = EqualTo(("body",), "x")
    left = list(reader.pushFilters([In(("sensor_id",), (3, 9)), GreaterThan(("day",), day(4)), LessThanOrEqual(("day",), day(7)), other]))
    assert left == [other]
    parts = reader.partitions()
    assert [(p.sensor, p.first, p.last) for p in parts] == [(3, "2024-01-05", "2024-01-06"), (3, "2024-01-07", "2024-01-07")]
    assert [(s, d) for s, d, _, _ in reader.read(parts[0])] == [(3, day(5)), (3, day(6))]
    assert asked == ["http://x/sensors/3/days?date_from=2024-01-05&date_to=2024-01-06&limit=100",
                     "http://x/sensors/3/days?date_from=2024-01-05&date_to=2024-01-06&limit=100&page=2"]
    none = rest.SensorDays({"sensors": "[3]", "base": "http://x"}).reader(None)
    assert list(none.pushFilters([EqualTo(("day",), day(4)), LessThan(("day",), day(4))])) == [] and none.partitions() == []


def test_sensor_days_in_a_plan(spark):
    spark.dataSource.register(rest.SensorDays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("sensor_days").option("sensors", "[3, 4]").option("base", "http://x").load()
        none = df.where("day > '2024-01-04' and day < '2024-01-05' and sensor_id = 3 and body like '%x%'")
        assert none.count() == 0  # no partition is left, so nothing is asked
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_rest_source_registers(spark):
    spark.dataSource.register(rest.StationApi)
    assert spark.read.format("station_api").load().columns == ["endpoint", "key", "body", "error"]


def test_station_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Timestamp , PM2.5 (µg/m³),AQI,Junk\n2024-01-01 00:10:00,1,10,x\n2024-01-01 00:10:00,3,10,x\nbad,9,9,x\n"
        "2024-01-01 00:50:00,5,,x\n2024-01-01 03:00:00,n/a,40,x\n", encoding="utf-8")
    rows = files.station_history(spark, str(tmp_path / "a.csv")).orderBy("ts").collect()
    assert [r.pm25 for r in rows] == [4.0, None, None, None] and [r.aqi for r in rows] == [10.0, None, None, 40.0]
    assert rows[0].station == "a"


def test_station_csvs_bind_by_name_and_keep_their_station(spark, tmp_path):
    (tmp_path / "north.csv").write_text("Timestamp,PM2.5 (µg/m³),AQI\n2024-01-01 00:10:00,1,10\n", encoding="utf-8")
    (tmp_path / "south.csv").write_text("AQI,Timestamp,PM2.5 (µg/m³)\n20,2024-01-01 00:10:00,2\n", encoding="utf-8")
    (tmp_path / "west.csv").write_text("AQI,Timestamp\n30,2024-01-01 00:10:00\n", encoding="utf-8")
    got = {r.station: (r.pm25, r.aqi) for r in files.station_history(spark, str(tmp_path)).collect()}
    assert got == {"north": (1.0, 10.0), "south": (2.0, 20.0), "west": (None, 30.0)}


def test_station_csv_names_and_layouts(spark, tmp_path):
    for name in ("my station.csv", "50%.csv", "süd,1.csv"):
        (tmp_path / name).write_text("\ufeffTimestamp,\"PM2.5 (µg/m³)\",AQI\n\n2024-01-01 00:10:00,\"1\",10\n2024-01-01 01:10:00,2\n", encoding="utf-8")
    got = files.station_history(spark, str(tmp_path)).orderBy("station", "ts").collect()
    assert [(r.station, r.pm25, r.aqi) for r in got] == [
        (n, v, a) for n in ("50%", "my station", "süd,1") for v, a in ((1.0, 10.0), (2.0, None))]


def test_damaged_pdf(spark, tmp_path, monkeypatch):
    assert files._pages_of(b"plain") == [(1, "plain", "text", None)]
    with pytest.raises(ImportError):  # no library in this environment
        files._pages_of(b"%PDF-1.4 damaged")
    broken = types.ModuleType("pypdf")
    broken.PdfReader = lambda data: (_ for _ in ()).throw(ValueError("no trailer"))
    monkeypatch.setitem(sys.modules, "pypdf", broken)
    assert files._pages_of(b"%PDF-1.4 damaged") == [(None, None, "pdf", "ValueError: no trailer")]


def test_pages_and_artifacts(spark, tmp_path):
    (tmp_path / "b.txt").write_text("second\nfile", encoding="utf-8")
    (tmp_path / "a b+50%.txt").write_text("third", encoding="utf-8")
    (tmp_path / "x.pdf").write_text("plain text named pdf", encoding="utf-8")
    (tmp_path / "y.pdf").write_bytes(b"\xff\xfe\xfa")
    rows = {r.doc_name: r for r in files.all_pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b+50%.txt", "b.txt", "x.pdf", "y.pdf"} and rows["b.txt"].text == "second\nfile" and rows["x.pdf"].source_type == "text"
    assert rows["y.pdf"].text is None and rows["y.pdf"].page is None and "UnicodeDecodeError" in rows["y.pdf"].error
    assert rows["b.txt"].error is None and rows["x.pdf"].error is None
    (tmp_path / "imp.json").write_text('{"aqi_lag1": 2.5,\n "pm25": 1}')
    got = {r.feature: r.importance for r in files.importance_rows(files.json_artifact(spark, str(tmp_path / "imp.json"))).collect()}
    assert got == {"aqi_lag1": 2.5, "pm25": 1.0}
    (tmp_path / "cases.json").write_text('[{"question": "q", "reference_answer": "a", "expected_topics": ["t"]}, {"question": "r"}]')
    cases = files.eval_cases(spark, str(tmp_path / "cases.json"))
    assert [tuple(r) for r in cases.collect()] == [("q", "a", ["t"]), ("r", None, None)]
    files.write_json(cases, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_demo(spark):
    h = demo.hourly(spark, "2024-01-02 05:40:00", 24, {"pm25": 77.0})
    last = {r.parameter: r.value for r in h.where("date_utc = '2024-01-02 05:00:00'").collect()}
    assert h.count() == 144 and last["pm25"] == 77.0 and last["co"] == 1500.0
    assert h.agg(F.min("value")).first()[0] >= 1
    assert demo.historical(spark, "2024-01-02", 2).count() == 288
    assert demo.or_else(h.limit(0), demo.latest(spark, "2024-01-02")).count() == 6


def test_index_store(spark, small, tmp_path):
    path = str(tmp_path / "idx")
    pages = documents_as_pages(spark, small).select("doc_name", "page", "text", "source_type")
    first, rest_ = pages.where("doc_name LIKE '%0'"), pages
    from airloom.operators.ingest import new_chunks

    chunks = new_chunks(first, first.limit(0)).withColumn("doc_id", F.xxhash64("doc_name", "page", "chunk"))
    index_store.save(chunks, path, partitions=4)
    n = chunks.count()
    added = index_store.append(rest_, path)
    total = spark.read.parquet(f"{path}/chunks")
    assert total.count() == n + added.count() and total.select("doc_id").distinct().count() == total.count() and total.where("topic IS NULL").count() == 0
    assert index_store.append(rest_, path).count() == 0
    index_store.append(rest_.where("doc_name LIKE '%1'").withColumn("doc_name", F.concat(F.lit("n-"), "doc_name")), path, "b1")
    grown = spark.read.parquet(f"{path}/chunks").count()
    repeat = index_store.append(rest_.where("doc_name LIKE '%1'").withColumn("doc_name", F.concat(F.lit("n-"), "doc_name")), path, "b1")
    assert repeat.count() > 0 and spark.read.parquet(f"{path}/chunks").count() == grown
    total = spark.read.parquet(f"{path}/chunks").drop("batch")
    q = spark.createDataFrame([(1, total.first().text[:80])], "query_id bigint, text string")
    got = [(r.doc_id, r["rank"]) for r in index_store.search(spark, path, q, 3).orderBy("rank").collect()]
    want = [(r.doc_id, r["rank"]) for r in RT.bm25_search(total, q, 3).orderBy("rank").collect()]
    assert got == want
    cache = spark.createDataFrame([("k", [1.0], 1)], "key string, embedding array<double>, used_at int")
    for _ in range(2):
        index_store.save_cache(cache, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_stored_index_from_nothing_and_rebuilt(spark, tmp_path):
    path = str(tmp_path / "idx")
    text = "river water quality station report number "
    pages = spark.createDataFrame([(f"d{i}", 1, text * 4 + f"word{i} " * 9, "text") for i in range(4)],
                                  "doc_name string, page int, text string, source_type string")
    assert index_store.append(pages, path, "a").count() == 4
    assert index_store.append(pages.where("doc_name = 'd1'"), path, "b", force=True).count() == 1
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.count() == 4 and stored.where("doc_name = 'd1'").first().batch == "b"


def test_stored_figures_count_documents_without_tokens(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "apple pear"), (2, "apple"), (3, "???"), (4, "")], "doc_id bigint, text string")
    index_store.save(chunks, str(tmp_path / "idx"))
    q = spark.createDataFrame([(1, "apple")], "query_id bigint, text string")
    key = lambda df: sorted((r.doc_id, r["rank"], round(r.bm25_score, 9)) for r in df.collect())
    assert key(index_store.search(spark, str(tmp_path / "idx"), q, 3)) == key(RT.bm25_search(chunks, q, 3))
    _, postings = index_store.load(spark, str(tmp_path / "idx"))
    want = {r.token: (r.df, r.dl_sum) for r in RT.document_frequency(chunks).collect()} if hasattr(RT, "document_frequency") else None
    got = {r.token: (r.df, r.dl_sum) for r in index_store.stats(postings, chunks).collect()}
    assert got[""] == (4, 3) and (want is None or want[""] == got[""])


def test_cache_keeps_one_row_per_key(spark, tmp_path):
    rows = spark.createDataFrame([("k", [1.0], 1), ("k", [2.0], 2), ("m", [3.0], 1)], "key string, embedding array<double>, used_at int")
    index_store.save_cache(rows, str(tmp_path / "cache"))
    index_store.save_cache(rows, str(tmp_path / "cache"))
    assert sorted((r.key, r.embedding) for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [("k", [2.0]), ("m", [3.0])]


# --- Streams --------------------------------------------------------------------------------

def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("pm25", "a", float(i), "µg/m³", t0 + timedelta(minutes=20 * i), i) for i in range(36)]
    schema = "parameter string, location string, value double, unit string, date_utc timestamp, seq bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    hourly = sink.run_once(flows.hourly_rollup(stream()), folder=str(tmp_path / "h")).orderBy("date_utc").collect()
    assert [r.value for r in hourly[:2]] == [1.0, 4.0]
    moved = sink.run_once(flows.sliding_change(stream()), folder=str(tmp_path / "s"))
    r = moved.where("date_utc = '2024-01-01 06:00:00'").first()
    assert (r.earlier, r.recent) == (4.0, 13.0)
    q = flows.latest_per_key(stream()).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("newest").first().value == 35.0


def test_stream_into_index(spark, small, tmp_path):
    path = str(tmp_path / "idx")
    pages = documents_as_pages(spark, small).select("doc_name", "page", "text", "source_type")
    from airloom.operators.ingest import new_chunks

    seedlings = new_chunks(pages.limit(3), pages.limit(0)).withColumn("doc_id", F.xxhash64("doc_name", "page", "chunk"))
    index_store.save(seedlings, path, partitions=2)
    pages.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(flows.index_new_pages(path, "pages")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    names = spark.read.parquet(f"{path}/chunks").select("doc_name")
    assert names.distinct().count() == new_chunks(pages, pages.limit(0)).select("doc_name").distinct().count()
