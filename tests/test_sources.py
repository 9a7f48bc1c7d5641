"""Readers, the incremental run and streams over real files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.plans.impact import analyse_table
from urbanpulse.fixed import Period, days
from urbanpulse.operators.health import nominal_interval
from urbanpulse.plans.normalization import normalize_all, normalize_feed
from urbanpulse.plans.reports import health_report
from urbanpulse.sources import commits, feeds, sinks, snapshots
from urbanpulse.sources.schemas import RAW, each, rows, struct
from urbanpulse.streaming import feeds as streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def parquet(spark, path, data, schema):
    """One Parquet file with a chosen name."""
    import pyarrow.parquet as pq

    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(spark.createDataFrame(data, schema).toArrow(), str(path))


def test_flight_xml(spark, tmp_path):
    path = put(tmp_path / "f.xml", """<airport xmlns="urn:x"><flights>
      <flight uniqueID="1"><airline> SK </airline><flight_id>SK1</flight_id><schedule_time>2026-01-31T10:00:00Z</schedule_time>
        <arr_dep>D</arr_dep><airport>BGO</airport><status code="E" time="2026-01-31T10:05:00Z"/></flight>
      <flight uniqueID="2"><airline>  </airline><airport>TRD</airport><delayed>Y</delayed></flight></flights></airport>""")
    out = {r["uniqueID"]: r for r in feeds.read_flights(spark, path).collect()}
    assert out["1"]["airline"] == "SK" and out["1"]["status"] == "E" and out["1"]["status_time"] == "2026-01-31T10:05:00Z"
    assert out["1"]["delayed"] is None and out["2"]["airline"] is None and out["2"]["delayed"] == "Y" and out["2"]["status"] is None


def test_airport_xml(spark, tmp_path):
    path = put(tmp_path / "a.xml", '<airportNames><airportName code="OSL" name="Oslo"/><airportName code="XXXX" name="no"/></airportNames>')
    assert [r["code"] for r in feeds.read_airports(spark, path).collect()] == ["OSL"]


def test_journey_xml(spark, tmp_path):
    call = "<EstimatedCall><StopPointRef>s1</StopPointRef><AimedArrivalTime>2026-01-31T10:00:00+01:00</AimedArrivalTime><ExpectedArrivalTime>2026-01-31T10:01:30.600+01:00</ExpectedArrivalTime></EstimatedCall>"
    late = "<EstimatedCall><StopPointRef> </StopPointRef><AimedDepartureTime>2026-01-31T23:59:00+01:00</AimedDepartureTime><ExpectedDepartureTime>2026-01-31T23:58:00+01:00</ExpectedDepartureTime></EstimatedCall>"
    path = put(tmp_path / "j.xml", f"""<Siri xmlns="http://www.siri.org.uk/siri"><EstimatedVehicleJourney><RecordedAtTime>2026-01-31T10:00:00.25Z</RecordedAtTime><LineRef>L1</LineRef>
      <FramedVehicleJourneyRef><DataFrameRef>2026-01-31</DataFrameRef><DatedVehicleJourneyRef>T1</DatedVehicleJourneyRef></FramedVehicleJourneyRef>
      <EstimatedCalls>{call}{late}</EstimatedCalls></EstimatedVehicleJourney>
      <EstimatedVehicleJourney><LineRef>L2</LineRef></EstimatedVehicleJourney></Siri>""")
    row = feeds.read_trips(spark, path).collect()
    assert len(row) == 1
    row = row[0]
    assert row["timestamp"] == 1769853600 and row["start_date"] == "20260131" and row["start_time"] == "23:59:00"
    first, second = row["stop_time_updates"]
    assert first["arrival_delay"] == 90 and first["departure_delay"] is None and second["departure_delay"] == -60 and second["stop_id"] is None


def test_bike_json_shapes(spark, tmp_path):
    many = put(tmp_path / "a.json", json.dumps({"last_updated": 7, "data": {"stations": [{"station_id": "1", "num_bikes_available": 3}, {"station_id": "2"}]}}))
    single = put(tmp_path / "b.json", json.dumps({"last_updated": 8, "data": {"station_id": "9"}}))
    assert [(r["station_id"], r["last_updated"]) for r in feeds.read_bike_feed(spark, many).collect()] == [("1", 7), ("2", 7)]
    assert [(r["station_id"], r["last_updated"]) for r in feeds.read_bike_feed(spark, single).collect()] == [("9", 8)]
    bare = put(tmp_path / "c.json", json.dumps({"last_updated": 9, "station_id": "5"}))
    assert [(r["station_id"], r["last_updated"]) for r in feeds.read_bike_feed(spark, bare).collect()] == [("5", 9)]


def test_vehicle_alert_and_document(spark, tmp_path):
    path = put(tmp_path / "v.json", '{"id":"1","type":"vehicle_position","latitude":60.0}\n{"id":"2","type":"alert","cause":"c"}\n')
    assert feeds.read_vehicle_positions(spark, path).first()["latitude"] == 60.0
    assert feeds.read_alerts(spark, path).first()["cause"] == "c"
    assert feeds.read_document(spark, path, struct(each("id"))).count() >= 1


def test_datex_xml(spark, tmp_path):
    situation = put(tmp_path / "s.xml", """<p xmlns:ns12="u"><ns12:situation id="S1"><ns12:severity>high</ns12:severity>
      <ns12:situationRecord><ns12:severity>own</ns12:severity><ns12:creationTime>2026-01-31T10:00:00Z</ns12:creationTime></ns12:situationRecord></ns12:situation>
      <ns12:situation id="S2"><ns12:severity>low</ns12:severity></ns12:situation></p>""")
    schema = struct({"@id": RAW["alerts"]["id"].dataType, **each("ns12:severity"), "ns12:situationRecord": rows(each("ns12:severity ns12:creationTime"))})
    out = feeds.read_situations(spark, situation, schema).collect()
    assert len(out) == 1 and out[0]["ns12:severity"] == "own" and out[0]["@id"] == "S1"
    weather = put(tmp_path / "w.xml", """<p xmlns:ns10="u" xmlns:xsi="i"><ns10:siteMeasurements><ns10:measurementSiteReference id="X"/>
      <ns10:measurementTimeDefault><ns10:timeValue>2026-01-31T10:00:00Z</ns10:timeValue></ns10:measurementTimeDefault>
      <ns10:physicalQuantity index="1"><ns10:physicalQuantity xsi:type="T"><ns10:basicData><ns10:temperature><airTemperature><temperature>4.5</temperature></airTemperature></ns10:temperature></ns10:basicData></ns10:physicalQuantity></ns10:physicalQuantity>
      </ns10:siteMeasurements></p>""")
    from urbanpulse.operators.normalize import normalize_road_weather

    row = normalize_road_weather(feeds.read_road_weather(spark, weather)).first()
    assert (row["location"], row["air_temperature"], row["measurement_type"], row["metric_name"]) == ("X", 4.5, "T", "1")
    travel = put(tmp_path / "t.xml", """<ns2:messageContainer xmlns:ns2="m" xmlns:ns10="u" xmlns:ns8="e"><ns2:payload><ns10:physicalQuantity><ns10:pertinentLocation><ns8:predefinedLocationReference id="R7"/></ns10:pertinentLocation>
      <ns10:basicData><ns10:freeFlowTravelTime><ns10:duration>33.0</ns10:duration></ns10:freeFlowTravelTime></ns10:basicData></ns10:physicalQuantity></ns2:payload></ns2:messageContainer>""")
    from urbanpulse.operators.normalize import normalize_travel_times

    row = normalize_travel_times(feeds.read_travel_times(spark, travel)).first()
    assert (row["location_id"], row["free_flow_travel_time_sec"]) == ("R7", 33.0)


def test_weather_sites(spark, tmp_path):
    path = put(tmp_path / "sites.xml", """<p xmlns:ns10="u"><ns10:measurementSite id="1"><ns10:name>A</ns10:name><ns10:lane>x</ns10:lane><ns10:lane>y</ns10:lane></ns10:measurementSite></p>""")
    schema = struct({**each("@id ns10:name"), "ns10:lane": T.ArrayType(T.StringType())})
    row = feeds.read_weather_sites(spark, path, schema).first()
    assert (row["@id"], row["ns10:name"], row["ns10:lane"]) == ("1", "A", "x,y")


def test_stops_csv(spark, tmp_path):
    path = put(tmp_path / "stops.csv", "stop_id,stop_name,stop_lat,stop_lon\na,A,60.1,10.2\nb,B,,10.2\n")
    assert [tuple(r) for r in feeds.read_stops(spark, path).collect()] == [("a", 60.1, 10.2)]


def weather_document(*times):
    """Site rows with one road temperature each."""
    basic = ((("-2.5",),), None, None, None, None)
    return [("site", t, [("1", ("T", basic))]) for t in times]


FLIGHT = "airport string, schedule_time string, status_time string, uniqueID string, arr_dep string"


def raw_zone(spark, base):
    parquet(spark, base / "avinor/2026-01-31/OSL_100000.parquet", [("OSL", "2026-01-31T10:00:00Z", None, "u1", "D")], FLIGHT)
    parquet(spark, base / "avinor/2026-01-31/OSL_110000.parquet", [("OSL", "2026-01-31T10:00:00Z", "2026-01-31T10:30:00Z", "u1", "D"), ("OSL", "2026-01-31T12:00:00Z", None, "u2", "D")], FLIGHT)
    parquet(spark, base / "oslobysykkel/2026-01-31/station_status_100000.parquet", [("1", True, True, True, 1769850000, None, 8, 2, 1)], RAW["bikes"])
    parquet(spark, base / "oslobysykkel/2026-01-31/station_information_100000.parquet", [("1", 20)], RAW["bike_stations"])
    update = [("s", 30, 40, None, None, None, None)]
    parquet(spark, base / "entur/2026-01-31/RUT_siri_et_100000.parquet", [("t", "x", "t", "r", 1769850000, "20260131", "10:00:00", update, None, None, None, None)], RAW["trips"])
    parquet(spark, base / "entur/2026-01-31/RUT_trip-updates_110000.parquet", [("t", "x", "t", "r", 1769850001, "20260131", "10:00:00", update, None, None, None, None)], RAW["trips"])
    parquet(spark, base / "vegvesen/2026-01-31/weather_data_100000.parquet", weather_document("2026-01-31T10:00:30Z", "2026-01-30T10:00:00Z"), RAW["road_weather"])
    parquet(spark, base / "vegvesen/2026-01-31/traffic_situations_100000.parquet", [("2026-01-31T10:00:00Z", "T"), ("2026-01-30T10:00:00Z", "T")], "creationTime string, situationType string")


def test_incremental_normalization(spark, tmp_path):
    raw, out, ledger = tmp_path / "raw", str(tmp_path / "normalized"), str(tmp_path / "ledger")
    raw_zone(spark, raw)
    done = normalize_all(spark, str(raw), out, ledger, "2026-01-31", "2026-01-31")
    assert {f: n.read for f, n in done.items()} == {"flights": 2, "bikes": 1, "road_weather": 1, "travel_times": 0, "situations": 1, "trips": 2}
    flights = snapshots.read_normalized_table(spark, out, "flights")
    assert {(r["uniqueID"], r["delay_minutes"]) for r in flights.collect()} == {("u1", 30.0), ("u2", None)}
    assert {str(r["date"]) for r in flights.collect()} == {"2026-01-31"}
    assert snapshots.read_normalized_table(spark, out, "bikes").first()["metric_value"] == 12.0
    trips = snapshots.read_normalized_table(spark, out, "trips").collect()
    assert len(trips) == 1 and trips[0]["timestamp"] == 1769850001 and trips[0]["max_departure_delay_sec"] == 40
    assert snapshots.read_normalized_table(spark, out, "situations").count() == 1
    assert snapshots.read_normalized_table(spark, out, "travel_times").count() == 0
    assert set(normalize_all(spark, str(raw), out, ledger, "2026-01-31", "2026-01-31").values()) == {(0, 0)}
    parquet(spark, raw / "avinor/2026-02-01/OSL_100000.parquet", [("OSL", "2026-02-01T10:00:00Z", None, "u1", "D")], FLIGHT)
    assert normalize_feed(spark, str(raw), out, ledger, "flights", all_dates=True) == (1, 0)
    assert snapshots.read_normalized_table(spark, out, "flights").count() == 3
    # a run that died before its ledger entry overwrites its own output
    before = snapshots.read_normalized_table(spark, out, "trips").count()
    normalize_feed(spark, str(raw), out, str(tmp_path / "lost-ledger"), "trips", "2026-01-31", "2026-01-31")
    assert snapshots.read_normalized_table(spark, out, "trips").count() == before
    impact = analyse_table(spark, out, (days("w", "2026-01-31", "2026-01-31"),))
    fact = impact.fact.collect()
    assert len(fact) == 1 and fact[0]["road_temperature"] == -2.5 and fact[0]["public_transport_activity"] == 1
    assert impact.correlations.first()["temperature_vs_bikes"] is None


def test_runs_lose_and_double_nothing(spark, tmp_path, monkeypatch):
    """A blank, a % and a bracket in names, an unreadable file, a crash before the ledger entry, a file that comes after it."""
    from urbanpulse.plans import normalization

    raw, out, ledger = tmp_path / "raw zone 100%", str(tmp_path / "n"), str(tmp_path / "l")
    raw_zone(spark, raw)
    parquet(spark, raw / "avinor/2026-01-31/OSL [a]+_120000.parquet", [("OSL", "2026-01-31T13:00:00Z", None, "u3", "D")], FLIGHT)
    put(raw / "avinor/2026-01-31/BAD_130000.parquet", "not parquet")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(normalization, "mark_processed", crash)
        with pytest.raises(RuntimeError):
            normalize_feed(spark, str(raw), out, ledger, "flights", all_dates=True)
    parquet(spark, raw / "avinor/2026-01-31/OSL_140000.parquet", [("OSL", "2026-01-31T15:00:00Z", None, "u4", "D")], FLIGHT)
    assert normalize_feed(spark, str(raw), out, ledger, "flights", all_dates=True) == (4, 2)
    ids = lambda: sorted(r["uniqueID"] for r in snapshots.read_normalized_table(spark, out, "flights").collect())
    assert ids() == ["u1", "u2", "u3", "u4"]
    assert {r["key"][-18:] for r in sinks.read_unread(spark, ledger).collect()} == {"BAD_130000.parquet"}
    assert normalize_feed(spark, str(raw), out, ledger, "flights", all_dates=True) == (0, 1)
    assert normalize_feed(spark, str(raw), out, ledger, "flights", all_dates=True, rerun_all=True) == (4, 1)
    assert ids() == ["u1", "u2", "u3", "u4"]


def test_command_line(spark, tmp_path, capsys):
    from urbanpulse.__main__ import main, periods_of, parser

    raw_zone(spark, tmp_path / "raw")
    out, ledger = str(tmp_path / "n"), str(tmp_path / "l")
    main(["normalize", "--raw", str(tmp_path / "raw"), "--out", out, "--ledger", ledger, "--all", "--only-trips"])
    assert "trips: 2 files" in capsys.readouterr().out
    main(["normalize", "--raw", str(tmp_path / "raw"), "--out", out, "--ledger", ledger, "--start-date", "2026-01-31"])
    args = ["analyze", "--tables", out, "--start-date", "2026-01-31", "--end-date", "2026-01-31", "--part-of-day", "6-12"]
    main([*args, "--summary-csv", str(tmp_path / "csv"), "--output-dir", str(tmp_path / "result")])
    line = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert line["part_of_day"] == "6-12" and line["sample_size_minutes"] == "1"
    assert spark.read.parquet(str(tmp_path / "result/fact")).count() == 1
    assert len(periods_of(parser().parse_args(["analyze", "--tables", "x", "--mode", "compare", "--periods", "four_windows"]))) == 4


def test_reports_from_what_is_stored(spark, tmp_path):
    """Cities, zones and feed health on the command line, over raw snapshots, the stop register and the tables."""
    import os

    from urbanpulse.__main__ import main
    from urbanpulse.fixed import CITIES, PERIOD_SETS

    raw, out, ledger = tmp_path / "raw", str(tmp_path / "n"), str(tmp_path / "l")
    raw_zone(spark, raw)
    city, operator, lat, lon = CITIES[0][:4]
    stops = [(f"s{i}", lat + (i % 4) * 0.02, lon + (i // 4 % 4) * 0.03) for i in range(16 * 15)]
    put(tmp_path / "stops.csv", "stop_id,stop_lat,stop_lon\n" + "".join(f"{s},{y},{x}\n" for s, y, x in stops))
    day = PERIOD_SETS["wa1_wa2_wb_wc"][0].start.date()
    updates = [(s, i % 7, None, None, None, None, None) for i, (s, _, _) in enumerate(stops) for _ in range(1 + i % 4)]
    path = raw / f"entur/{day}/{operator}_siri_et_100000.parquet"
    parquet(spark, path, [("t", "x", "t", "r", 1769850000, f"{day:%Y%m%d}", "10:00:00", updates, None, None, None, None)], RAW["trips"])
    noon = datetime(day.year, day.month, day.day, 12).timestamp()
    os.utime(path, (noon, noon))
    normalize_all(spark, str(raw), out, ledger, str(day), str(day))
    common = ["--raw", str(raw), "--periods", "wa1_wa2_wb_wc"]
    main(["cities", *common, "--stops", str(tmp_path / "stops.csv"), "--output-dir", str(tmp_path / "cities")])
    zones = spark.read.parquet(str(tmp_path / "cities/zones"))
    assert zones.select("city").distinct().first()["city"] == city and zones.agg(F.sum("activity")).first()[0] == len(updates)
    assert spark.read.parquet(str(tmp_path / "cities/global")).where("metric = 'activity'").first()["n_zones"] == 16
    main(["zones", *common, "--tables", out, "--stops", str(tmp_path / "stops.csv"), "--output-dir", str(tmp_path / "zones")])
    assert spark.read.parquet(str(tmp_path / "zones/centroids")).agg(F.sum("n_stops")).first()[0] > 0
    main(["health", *common, "--output-dir", str(tmp_path / "health")])
    assert spark.read.parquet(str(tmp_path / "health/robustness")).where("source = 'trips'").first()["n_files"] == 1


def test_listing_and_names(spark, tmp_path):
    raw_zone(spark, tmp_path)
    put(tmp_path / "avinor/normalized/x.parquet", "junk")
    files = snapshots.listing(spark, str(tmp_path / "avinor"))
    assert files.count() == 2 and snapshots.listing(spark, str(tmp_path / "avinor"), "*_11*.parquet").count() == 1
    assert snapshots.latest_file(files).first()["key"].endswith("OSL_110000.parquet")
    assert [r["key"][-14:] for r in snapshots.listing_in_order(files).collect()] == ["100000.parquet", "110000.parquet"]
    rows_in = snapshots.scan(spark, str(tmp_path / "avinor"), RAW["flights"], dates=("2026-01-31", "2026-01-31"))
    assert rows_in.count() == 3
    assert sorted(r["n_rows"] for r in snapshots.file_counts(rows_in).collect()) == [1, 2]
    table = snapshots.file_table(rows_in, "flights")
    health = health_report(spark, table, (Period("all", datetime(2020, 1, 1), datetime(2100, 1, 1)),), nominal_interval(F.col("source")))
    assert health["robustness"].first()["n_files"] == 2
    assert health["throughput"].first()["mean_records_per_file"] == 1.5 and health["throughput"].first()["records_per_min"] == 0.5
    assert snapshots.rows_of_latest_file(rows_in).count() == 2
    updates = snapshots.stop_rows(snapshots.scan_feed(spark, str(tmp_path), "trips"), "RUT")
    assert updates.count() == 1 and updates.first()["operator"] == "RUT" and updates.first()["arrival_delay"] == 30
    assert snapshots.dates_between(spark, "2026-01-30", "2026-02-01").count() == 3


def test_normalized_files_by_name(spark, tmp_path):
    schema = "timestamp timestamp, metric_value double, source string"
    row = [(datetime(2026, 1, 31), 1.0, "s")]
    for name in ("2026-01-31/avinor_normalized_1", "2026-01-31/entur_siri_et_normalized_1", "2026-02-01/oslobysykkel_normalized_1", "2026-02-01/s_normalized_1"):
        parquet(spark, tmp_path / f"{name}.parquet", row, schema)
    read = snapshots.read_normalized_files
    assert read(spark, str(tmp_path), "flights").count() == 1 and read(spark, str(tmp_path), "s").count() == 1
    assert read(spark, str(tmp_path), "bikes", ("2026-02-01", "2026-02-02")).count() == 1
    # nothing in the window: all files are read
    assert read(spark, str(tmp_path), "bikes", ("2020-01-01", "2020-01-02")).count() == 1
    assert snapshots.profile(spark.createDataFrame(row, schema), "bikes").first()["missing_columns"] == "location"


def test_unreadable_file_is_skipped(spark, tmp_path):
    raw_zone(spark, tmp_path)
    put(tmp_path / "avinor/2026-01-31/BAD_120000.parquet", "not parquet")
    read = snapshots.scan_feed(spark, str(tmp_path), "flights")
    assert read.count() == 3
    lost = snapshots.unread_files(snapshots.listing(spark, str(tmp_path / "avinor")), read)
    assert [r["key"][-18:] for r in lost.collect()] == ["BAD_120000.parquet"]


def test_csv_and_ledger(spark, tmp_path):
    row = spark.createDataFrame([("a", None)], "x string, y double")
    for _ in range(2):
        sinks.append_csv(row, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
    sinks.overwrite_csv(row, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first()["y"] is None
    keys = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "key string")
    ledger = str(tmp_path / "ledger")
    sinks.mark_processed(keys, ledger, "s")
    sinks.mark_processed(keys, ledger, "s")
    assert sinks.read_ledger(spark, ledger, "s").count() == 2 and sinks.read_ledger(spark, ledger, "t").count() == 0
    assert sinks.not_processed(keys, sinks.read_ledger(spark, ledger), rerun_all=True).count() == 3
    sinks.write_documents(row, str(tmp_path / "j"))
    sinks.write_table(row, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 1


ARRIVAL = "source string, id bigint, ts timestamp"


def test_streams_over_batches(spark, tmp_path):
    """Two runs of the same stream see only new files and agree with one batch over all of them."""
    at = datetime(2026, 1, 31, 10)
    folder, out = tmp_path / "landing", tmp_path / "out"
    parquet(spark, folder / "a.parquet", [("s", 1, at), ("s", 2, at.replace(minute=1))], ARRIVAL)
    schema = spark.createDataFrame([], ARRIVAL).schema

    def run(name, build, mode="append", each=None):
        stream = streams.stream_snapshots(spark, str(folder), schema)
        streams.run_available(build(stream), f"{out}/{name}", f"{out}/{name}-checkpoint", mode, each)

    def all_runs():
        run("counts", lambda s: streams.minute_counts(s, F.col("ts"), ["source"]), "update")
        run("last", lambda s: s, each=streams.last_seen_batch(["source"], ["ts", "id"]))
        run("gaps", lambda s: s, each=streams.gap_alarms(["source"], "ts", F.lit(60), f"{out}/state"))

    all_runs()
    parquet(spark, folder / "b.parquet", [("s", 3, at.replace(minute=1, second=30)), ("s", 4, at.replace(hour=12))], ARRIVAL)
    all_runs()
    counts = {r["window_start"].minute + 60 * r["window_start"].hour: r["n"] for r in streams.latest(spark, f"{out}/counts", ["window_start", "source"]).collect()}
    assert counts == {600: 1, 601: 2, 720: 1}
    assert streams.last_seen(spark, f"{out}/last", ["source"], ["ts", "id"]).first()["id"] == 4
    alarms = streams.read_batches(spark, f"{out}/gaps").collect()
    assert len(alarms) == 1 and alarms[0]["gap_s"] == pytest.approx(7110)


def landing(spark, tmp_path):
    """A folder that rows are put into, and a run of a stream over it."""
    folder, schema = tmp_path / "landing", spark.createDataFrame([], ARRIVAL).schema
    folder.mkdir()

    def put_rows(name, *rows):
        parquet(spark, folder / f"{name}.parquet", [(s, i, datetime(2026, 1, 31, *t)) for s, i, t in rows], ARRIVAL)

    def run(path, checkpoint="checkpoint", **options):
        stream = streams.stream_snapshots(spark, str(folder), schema)
        streams.run_available(stream, f"{tmp_path}/{path}", f"{tmp_path}/{path}-{checkpoint}", **options)

    return put_rows, run


def test_late_rows_shorten_and_withdraw_alarms(spark, tmp_path):
    put_rows, run = landing(spark, tmp_path)
    each = streams.gap_alarms(["source"], "ts", F.lit(120), f"{tmp_path}/state", lateness="2 hours")  # gaps above 20 minutes

    def standing():
        rows = streams.standing_alarms(spark, f"{tmp_path}/out", ["source"]).collect()
        return sorted((r["source"], f"{r['since']:%H:%M}", r["until"] and f"{r['until']:%H:%M}") for r in rows)

    def batch(name, *rows):
        put_rows(name, *rows)
        run("out", each=each)
        return standing()

    assert batch("a", ("s", 1, (10, 0)), ("s", 2, (10, 15)), ("t", 3, (10, 0))) == []
    assert batch("b", ("s", 4, (10, 55))) == [("s", "10:15", "10:55"), ("t", "10:00", None)]  # t is silent
    assert batch("c", ("s", 5, (10, 32)), ("t", 6, (10, 50))) == [("s", "10:32", "10:55"), ("t", "10:00", "10:50")]
    assert batch("d", ("s", 7, (10, 40)), ("s", 7, (10, 32))) == [("t", "10:00", "10:50")]
    assert batch("e", ("s", 8, (13, 0)), ("t", 9, (12, 59))) == [
        ("s", "10:55", "13:00"), ("t", "10:00", "10:50"), ("t", "10:50", "12:59")]
    # what lies behind the lateness stands, and the state no longer holds it
    query = streams.query_id(spark, f"{tmp_path}/out-checkpoint")
    assert spark.read.parquet(streams.part_of(f"{tmp_path}/state", query, 4)).count() == 4
    assert batch("f", ("s", 10, (13, 1))) == standing()


def test_a_batch_costs_the_same_however_old_the_stream(spark, tmp_path, monkeypatch):
    """Parts are merged in tiers; only the last row of a key is left of them."""
    monkeypatch.setattr(streams, "FANOUT", 3)
    put_rows, run = landing(spark, tmp_path)
    for i in range(10):
        put_rows(f"f{i:02d}", ("s", i, (10, i)), (f"k{i % 2}", i, (10, i)))
        run("last", each=streams.last_seen_batch(["source"], ["ts"]), merge=streams.newest(["source"], ["ts"]))
        got = {r["source"]: r["id"] for r in streams.last_seen(spark, f"{tmp_path}/last", ["source"], ["ts"]).collect()}
        assert got == {"s": i, **{f"k{j % 2}": j for j in range(max(0, i - 1), i + 1)}}
    assert commits.parts(spark, f"{tmp_path}/last").count() <= 4 and streams.read_batches(spark, f"{tmp_path}/last").count() <= 9
    assert streams.forget(spark, f"{tmp_path}/last", keep=1) >= 9
    assert streams.last_seen(spark, f"{tmp_path}/last", ["source"], ["ts"]).count() == 3


def test_a_renewed_checkpoint_loses_and_doubles_nothing(spark, tmp_path):
    put_rows, run = landing(spark, tmp_path)
    put_rows("a", ("s", 1, (10, 0)))
    run("rows")
    put_rows("b", ("s", 2, (10, 1)))
    run("rows")
    before = streams.read_batches(spark, f"{tmp_path}/rows")

    def crash(*_):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run("rows", "renewed", each=crash)
    assert sorted(r["id"] for r in streams.read_batches(spark, f"{tmp_path}/rows").collect()) == [1, 2]
    put_rows("c", ("s", 3, (10, 2)))
    run("rows", "renewed")
    assert sorted(r["id"] for r in streams.read_batches(spark, f"{tmp_path}/rows").collect()) == [1, 2, 3] and before.count() == 2
    run("rows", "renewed")
    assert streams.read_batches(spark, f"{tmp_path}/rows").count() == 3


def test_rows_behind_the_watermark_are_kept_aside_and_added(spark, tmp_path):
    put_rows, run = landing(spark, tmp_path)
    partial, merge = streams.minute_partials("ts", ["source"]), streams.summed(["minute", "source"])
    each = streams.on_time("ts", f"{tmp_path}/late", "30 minutes", partial)

    def counts():
        return sorted((f"{r['minute']:%H:%M}", r["n"]) for r in merge(streams.read_batches(spark, f"{tmp_path}/n")).collect())

    put_rows("a", ("s", 1, (10, 0)), ("s", 2, (11, 0)))  # not behind the watermark of its own batch
    run("n", each=each, merge=merge)
    put_rows("b", ("s", 3, (10, 29)), ("s", 4, (10, 30)), ("s", 5, (12, 0)))
    run("n", each=each, merge=merge)
    assert counts() == [("10:00", 1), ("10:30", 1), ("11:00", 1), ("12:00", 1)]
    assert [r["id"] for r in streams.read_batches(spark, f"{tmp_path}/late").collect()] == [3]
    for n in (1, 0):
        assert streams.add_late_rows(spark, f"{tmp_path}/n", f"{tmp_path}/late", partial) == n
        assert counts() == [("10:00", 1), ("10:29", 1), ("10:30", 1), ("11:00", 1), ("12:00", 1)]
    put_rows("c", ("s", 6, (10, 29)), ("s", 7, (12, 1)))
    run("n", each=each, merge=merge)
    assert streams.add_late_rows(spark, f"{tmp_path}/n", f"{tmp_path}/late", partial) == 1
    assert counts() == [("10:00", 1), ("10:29", 2), ("10:30", 1), ("11:00", 1), ("12:00", 1), ("12:01", 1)]
