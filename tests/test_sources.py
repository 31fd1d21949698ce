import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import labels as L, scoring as SC
from pulsegrid.operators import sessions as SE
from pulsegrid.plans import QUERIES
from pulsegrid.sources import hygiene as HY, readers as RD, schemas, sinks as SK
from pulsegrid.streaming import windows as SW


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(text)


def test_csv_file_name_gives_participant(spark, tmp_path):
    put(str(tmp_path / "p-1_heartRate.csv.gz"), "Timestamp,HeartRatePPG\n2024-01-01T00:00:01.000,61\n2024-01-01T00:00:09.000,\n")
    put(str(tmp_path / "p-2_heartRate.csv.gz"), "Timestamp,HeartRatePPG\n2024-01-01T00:00:02.000,70\n")
    put(str(tmp_path / "p-2_stepCount.csv.gz"), "Timestamp,StepCount\n2024-01-01T00:00:00.000,12\n")
    put(str(tmp_path / "p-2_dailySummary.csv.gz"), ",".join(f.name for f in schemas.WRIST_SUMMARY) + "\n")
    df = RD.read_stream_csv(spark, str(tmp_path / "*_heartRate.csv.gz"), schemas.WRIST_HR)
    assert [(r.participant_id, r.heart_rate) for r in df.orderBy("ts").collect()] == [("p-1", 61.0), ("p-2", 70.0), ("p-1", None)]
    bundle = RD.read_wrist_bundle(spark, str(tmp_path))
    assert bundle["steps"].first().step_count == 12.0 and bundle["summary"].isEmpty()


def test_parts_and_proximity(spark, tmp_path):
    put(str(tmp_path / "parts/u1/2024-01-01.csv.gz"), "ts,heart_rate\n2024-01-01T00:00:01.000,61\n")
    put(str(tmp_path / "parts/u1/2024-01-02.csv.gz"), "ts,heart_rate\n2024-01-02T00:00:01.000,62\n")
    assert [r.participant_id for r in RD.read_parts(spark, str(tmp_path / "parts"), schemas.WRIST_HR).collect()] == ["u1", "u1"]
    put(str(tmp_path / "prox/u1_prox.csv.gz"), "ts,receiver,rssi\n2024-01-01T00:00:01.000,a:b,139\n2024-01-01T00:00:02.000,a:b,140\n")
    assert [r.rssi for r in RD.read_proximity(spark, str(tmp_path / "prox/*")).collect()] == [140]
    put(str(tmp_path / "s/s.csv.gz"), "uid,timestamp,location_mgt\nx,2024-01-01T05:00:00.000,2\n")
    assert RD.read_survey(spark, str(tmp_path / "s")).select(F.hour("ts")).first()[0] == 5


def test_csv_columns_are_found_by_name(spark, tmp_path):
    put(str(tmp_path / "a_heartRate.csv.gz"), "extra,HeartRatePPG,Timestamp\nx,61,2024-01-01T00:00:01.000\ny,bad,2024-01-01T00:00:02.000\nz,,2024-01-01T00:00:03.000\n")
    got = RD.read_stream_csv(spark, str(tmp_path / "a_*"), schemas.WRIST_HR, bad="bad_cells").orderBy("ts").collect()
    assert [(r.heart_rate, r.bad_cells, r.ts.second) for r in got] == [(61.0, 0, 1), (None, 1, 2), (None, 0, 3)]
    with pytest.raises(ValueError, match="step_count"):
        RD.read_stream_csv(spark, str(tmp_path / "a_*"), schemas.WRIST_STEPS)
    put(str(tmp_path / "b_heartRate.csv.gz"), "Timestamp,extra,HeartRatePPG\n2024-01-01T00:00:01.000,x,70\n")
    with pytest.raises(Exception, match="[Hh]eader"):
        RD.read_stream_csv(spark, str(tmp_path / "*_heartRate.csv.gz"), schemas.WRIST_HR).collect()


def test_write_and_skip_existing(spark, stream, tmp_path):
    df = stream([("a", 1, 1.0), ("b", 2, 2.0)])
    path = SK.dataset_path(SK.StageConfig(str(tmp_path), "exp", offset=30, columns="hr"), "resampled")
    assert path.endswith("exp/resampled/method_original_offset_30_overlap_0_hr")
    SK.write(df, path)
    SK.write(df.limit(0), path, mode="ignore")
    back = spark.read.parquet(path)
    assert back.count() == 2 and sorted(os.listdir(path))[-1].startswith("participant_id=")


def test_dedupe_modes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 6.0)], "t int, v double")
    assert sorted(r.t for r in HY.dedupe(df, ["v"], ["t"]).collect()) == [1, 3]
    assert sorted(r.t for r in HY.dedupe(df, ["v"], ["t"], keep="last").collect()) == [2, 3]


def test_room_classes(spark):
    rows = [("s:f1:u:pat1", "pat"), ("s:f1:u:lounge-lab", "lounge"), ("s:f1:u:x", None), ("s:floor2:z:pat", "floor2"), ("s:f9:z:pat", "other_floor")]
    df = spark.createDataFrame(rows, "p string, want string").withColumn("u", F.lit("s:f1:u"))
    assert df.filter(~L.room_class("p", "u").eqNullSafe(F.col("want"))).isEmpty()
    assert df.select(L.unit_of("p")).first()[0] == "s:f1:u"


@pytest.mark.parametrize("slept,legacy,want", [("6", False, 2), ("6", True, 3), ("8", False, 0), ("7", False, 1), ("5", False, 3)])
def test_sleep_efficiency_bands(spark, slept, legacy, want):
    items = {f"psqi5{c}": "0" for c in "abcdefghi"} | {"psqi5jb": None, "psqi1": "1100", "psqi1ampm": "2", "psqi3": "0800", "psqi3ampm": "1", "psqi2": "30", "psqi4": slept, "psqi6": "1", "psqi7": "0", "psqi8": "1", "psqi9": "1"}
    df = spark.createDataFrame([tuple(items.values())], ", ".join(f"{k} string" for k in items))
    r = SC.score_sleep_quality(df, legacy=legacy).first()
    assert r.sleep_efficiency == want and r.sleep_latency == 1 and r.day_dysfunction == 1 and r.sleep_disturbance == 0


def test_clean_numeric(spark):
    df = spark.createDataFrame([(" ",), ("12",), ("a",), ("123",), (None,), ("nan",)], "s string")
    assert [r[0] for r in df.select(SC.clean_numeric("s", 2)).collect()] == [None, 12.0, None, None, None, None]


def test_streams_give_batch_columns(spark, stream, tmp_path):
    src = str(tmp_path / "in")
    stream([("a", 0, 1.0), ("a", 60, 2.0), ("a", 5000, 3.0), ("a", 90000, 9.0)]).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    live = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for name, df in (("ses", SW.session_stream(live, "10 minutes")), ("res", SW.resample_stream(live, "value", 120, min_n=0, centered=True))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("ses").collect()) == [1, 2]
    assert sorted(r.value for r in spark.table("res").collect()) == [1.0, 2.0, 3.0]


def test_streamed_sessions_equal_batch_for_late_and_unordered_rows(spark, stream, tmp_path):
    """Gaps of exactly the threshold, a microsecond more, and rows that come up to an hour late over several batches."""
    draw, rows = random.Random(3), []
    for p in "abc":
        t = 0.0
        for _ in range(60):
            t += draw.choice([60.0, 599.999999, 600.0, 600.000001, 900.0])
            rows.append((p, round(t, 6), 1.0))
    rows.sort(key=lambda r: r[1] + draw.uniform(0, 1500))  # all less than half an hour late
    want = {(r.participant_id, r.start_us, r.end_us, r.n) for r in SE.sessions(stream(rows), 600).collect()}
    src, end = str(tmp_path / "in"), max(r[1] for r in rows)
    schema = stream(rows).withColumn("ts", F.col("ts").cast("timestamp")).schema
    os.makedirs(src)
    live = SW.session_stream(spark.readStream.schema(schema).parquet(src), "10 minutes")
    parts = [rows[i : i + 45] for i in range(0, len(rows), 45)] + [[("z", end + 90_000, 1.0)], [("z", end + 180_000, 1.0)]]
    q = live.writeStream.format("memory").queryName("late_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for part in parts:
            stream(part).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
    finally:
        q.stop()
    got = [tuple(r) for r in spark.table("late_sessions").where("participant_id <> 'z'").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dated_parts_keep_microseconds_and_prune_folders(spark, stream, tmp_path):
    path = str(tmp_path / "parts")
    rows = stream([("a", 0.000001, 1.0), ("a", 86400, None), ("b b", 5, 0.1)])
    SK.write_parts(rows, path)
    SK.write_parts(rows.limit(0), path, mode="ignore")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        SK.write_parts(rows, path)
    back = RD.read_dated_parts(spark, path, rows.drop("participant_id").schema)
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    some = back.where("participant_id = 'a' and day = date'2024-01-02'")
    assert some.count() == 1 and len(some.inputFiles()) == 3
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_parts_round_trip_sums_beyond_64_bits(spark, tmp_path):
    """6000 rows on one day: their microseconds since 1970 sum to more than a bigint holds; 10 rows stay a bigint."""
    for n, kind in ((6000, "decimal(38,0)"), (10, "bigint")):
        folder = str(tmp_path / str(n))
        ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id")).cast("timestamp_ntz")
        spark.range(n).select(
            F.col("id").alias("event_id"), ts.alias("ts"), F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
        ).write.parquet(f"{folder}/events.parquet")
        out = QUERIES["parts_round_trip"](spark, folder)
        assert dict(out.dtypes)["us"] == kind
        row = out.collect()
        assert [(r.participant_id, r.day, r.n, int(r.us), r.total) for r in row] == [("click", 19723, n, sum(1_704_067_200_000_000 + i for i in range(n)), float(n))]
