"""File sources, persisted tables, streaming (J1 = batch, J4 appends)."""

import os

from pyspark.sql import functions as F

from pneuma.operators import retrain as R
from pneuma.operators import scoring as S
from pneuma.operators import profile as PR
from pneuma.sources import files as FS
from pneuma.sources import views as V
from pneuma.streaming import epochs as EP
from pneuma.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def test_station_csv_roundtrip(spark, tmp_dir):
    raw = V.stations_raw(spark, SF)
    pdf = raw.toPandas()
    for st, part in pdf.groupby("station"):
        if st == "station_1":  # this file has no station column: the name comes from the file name
            part[[c for c in part.columns if c != "station"]].to_csv(
                os.path.join(tmp_dir, "PRSA_Data_Gucheng_20240101-20240131.csv"), index=False, na_rep="NA")
        else:
            part.to_csv(os.path.join(tmp_dir, f"PRSA_Data_{st}_20240101-20240131.csv"), index=False, na_rep="NA")
    got = FS.load_stations(spark, tmp_dir)
    assert got.count() == len(pdf)
    expected = (set(pdf.station) - {"station_1"}) | {"Gucheng"}
    assert set(r.station for r in got.select("station").distinct().collect()) == expected
    assert got.filter(F.col("`PM2.5`").isNull()).count() == int(pdf["PM2.5"].isna().sum())


def test_processed_and_bounds(spark, tmp_dir):
    m = V.measurements(spark, SF).select("datetime", "station", "pm25", "co", "temperature", "humidity")
    p = FS.save_processed(m, os.path.join(tmp_dir, "processed"))
    back = FS.load_processed(spark, p)
    assert back.count() == m.count()
    b = PR.feature_bounds(back)
    PR.save_bounds(b, os.path.join(tmp_dir, "bounds"))
    loaded = PR.load_bounds(spark, os.path.join(tmp_dir, "bounds"))
    assert loaded["pm25"][1] == m.agg(F.max("pm25")).collect()[0][0]
    assert PR.load_bounds(spark, os.path.join(tmp_dir, "missing"))["co"] == (0.0, 50.0)


def test_labeled_append_and_pruning(spark, tmp_dir):
    path = os.path.join(tmp_dir, "labeled")
    le = V.labeled_entries(spark, SF)
    R.append_labeled(le, path)
    one = R.load_labeled(spark, path, user_id=7)
    assert one.count() == le.filter("user_id = 7").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()
    empty = R.load_labeled(spark, os.path.join(tmp_dir, "nothing"))
    assert empty.count() == 0


def test_stream_score_equals_batch(spark):
    m = V.measurements_from(V.events_stream(spark, SF)).select("event_id", "station", "datetime", "pm25", "co",
                                                                "humidity", "temperature")
    s = ST.run_to_table(spark, ST.stream_score(m, "general"), "t_stream_score")
    b = S.score_realtime(V.measurements(spark, SF).select(*m.columns), "general")
    assert s.count() == b.count()
    assert s.exceptAll(b.select(*s.columns)).count() == 0


def test_stream_labels_keeps_every_answer_once(spark, tmp_dir):
    le = V.labeled_entries(spark, SF)
    src, table = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "labeled")
    twice = le.unionByName(le.withColumn("symptom_label", 1 - F.col("symptom_label")))  # two answers at one instant
    twice.orderBy(F.rand(3)).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(le.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.stream_labels(spark, stream, table).awaitTermination()
    assert R.load_labeled(spark, table).count() == 2 * le.count()
    # a retried epoch replaces its own rows; a later, late answer is added
    R.append_labeled(spark.read.parquet(src).limit(0), table, batch="epoch-000000000000")
    kept = R.load_labeled(spark, table).count()
    R.append_labeled(spark.read.parquet(src).limit(5), table, batch="epoch-000000000000")
    R.append_labeled(spark.read.parquet(src).limit(5), table, batch="epoch-000000000000")
    assert R.load_labeled(spark, table).count() == kept + 5


def test_stream_history_of_shuffled_files(spark, tmp_dir):
    from pneuma.functions import features as FX
    from pneuma.functions import index as IX
    from pneuma.operators import features as FT
    ev = V.read_table(spark, SF, "events")
    src = os.path.join(tmp_dir, "shuffled")
    ev.orderBy(F.rand(5)).repartition(5).write.parquet(src)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
        m = V.measurements_from(stream).withColumn("ier_score", IX.ier_score())
        got = EP.stream_history(m, lateness_days=60)
        exp = FT.history_features(FT.with_history(V.measurements(spark, SF).withColumn("ier_score", IX.ier_score()))) \
                .select("event_id", "station", *[n for n, _, _ in FX.HISTORY_SPECS])
        assert got.count() == exp.count() and got.select(*exp.columns).exceptAll(exp).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stream_history_state_across_batches(spark, tmp_dir):
    from pneuma.functions import features as FX
    from pneuma.functions import index as IX
    from pneuma.operators import features as FT
    ev = V.read_table(spark, "/root/testdata/sf0.01", "events")
    src = os.path.join(tmp_dir, "events_by_week")
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"),
                                  ("2024-01-15", "2024-01-22"), ("2024-01-22", "2024-02-01")]):
        part = ev.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
        part.coalesce(1).write.parquet(os.path.join(src, f"week={i}"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    m = V.measurements_from(stream).withColumn("ier_score", IX.ier_score())
    got = EP.stream_history(m)
    batch = V.measurements(spark, "/root/testdata/sf0.01").withColumn("ier_score", IX.ier_score())
    exp = FT.history_features(FT.with_history(batch, block_rows=512)) \
            .select("event_id", "station", *[n for n, _, _ in FX.HISTORY_SPECS])
    assert got.count() == exp.count()
    assert got.select(*exp.columns).exceptAll(exp).count() == 0


def _readings(spark, rows):
    return spark.createDataFrame(rows, "event_id long, station string, datetime timestamp_ntz, pm25 double, co double, humidity double, "
                                       "temperature double, ier_score double")


def _dated(i, day, station="s", pm25=1.0):
    import datetime as dt
    at = None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    return (i, station, at, pm25, 2.0, 3.0, 4.0, float(i))


def test_stream_history_in_blocks_over_restarts(spark, tmp_dir):
    """One station, blocks of 30 rows, every run a restart; a late row changes only the 24 rows after it."""
    import random

    from pneuma.functions import features as FX
    from pneuma.operators import features as FT
    rng = random.Random(2)
    rows = [_dated(i, i / 24, rng.choice(["hot", "hot", None]), rng.random() * 100) for i in range(240)]
    rows += [_dated(900 + i, None, "hot", float(i)) for i in range(3)]
    late = [r for r in rows if r[0] % 13 == 0 and r[0] < 900]
    parts = [[r for r in rows[:100] if r not in late], [r for r in rows[100:] if r not in late], late]
    src, base = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "base")
    for part in parts:
        _readings(spark, part).repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(_readings(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(src)
        got = EP.stream_history(stream, lateness_days=30, base=base, block_rows=30)
    exp = FT.history_features(FT.with_history(_readings(spark, rows))).select("event_id", "station", *[n for n, _, _ in FX.HISTORY_SPECS])
    assert got.count() == len(rows) and got.select(*exp.columns).exceptAll(exp).count() == 0
    epochs = EP.Epochs(spark, "x", base)
    assert len(epochs.epochs("state")) == 2 and len(epochs.epochs("table")) == 6
    given = spark.read.parquet(f"{base}/table").count()
    assert given < 3 * len(rows)  # only readings with a changed history are given out again


def test_stream_history_retried_epoch_and_bounded_state(spark, tmp_dir):
    epochs = EP.Epochs(spark, "x", os.path.join(tmp_dir, "base"))
    step = EP.history_step(epochs, EP._history_rows, n=3, lateness_days=2)
    for e in range(4):
        batch = _readings(spark, [_dated(100 * e + i, 2 * e + i / 10) for i in range(10)])
        step(batch, e)
        first = sorted(map(tuple, epochs.all("table", spark.read.parquet(f"{epochs.base}/table/_epoch={e}").schema).collect()))
        step(batch, e)  # the epoch is tried again
        again = sorted(map(tuple, epochs.all("table", spark.read.parquet(f"{epochs.base}/table/_epoch={e}").schema).collect()))
        assert first == again
    assert spark.read.parquet(f"{epochs.base}/state/_epoch=3").count() <= 2 * 10 + 3


def test_streams_without_a_file(spark, tmp_dir):
    from pneuma.operators import scoring
    src = os.path.join(tmp_dir, "none")
    os.makedirs(src)
    r = spark.readStream.schema(_readings(spark, []).schema).parquet(src)
    assert ST.run_to_table(spark, ST.stream_score(r.drop("ier_score")), "t_none").count() == 0
    assert ST.run_to_table(spark, ST.stream_daily_mean(r), "t_none2", ["station", "date"]).count() == 0
    assert EP.stream_history(r).count() == 0
    days = EP.stream_closed_days(r)
    assert (days.closed.count(), days.late.count(), days.open.count()) == (0, 0, 0)
    good, bad = EP.stream_validated(spark.readStream.schema("value string").parquet(src), scoring.score_realtime)
    assert good.count() == bad.count() == 0


def test_closed_days_late_rows_and_open_days_are_all_rows(spark, tmp_dir):
    epochs = EP.Epochs(spark, "x", os.path.join(tmp_dir, "base"))
    step = EP.closed_days_step(epochs, "1 DAY")
    batches = [[_dated(i, i / 8) for i in range(30)], [_dated(100 + i, 3 + i / 8, "t") for i in range(30)] + [_dated(200, 0.5), _dated(201, None)],
               [_dated(300 + i, 1.1 + i) for i in range(12)], []]
    for e, rows in enumerate(batches):
        step(_readings(spark, rows), e)
        if e == 1:
            step(_readings(spark, rows), e)
    closed = spark.read.parquet(f"{epochs.base}/table").collect()
    late = spark.read.parquet(f"{epochs.base}/late").collect()
    still = epochs.before("open", 9)
    assert len({(r.station, r.date) for r in closed}) == len(closed)  # each day once
    # after the second batch the mark stands on January 6, 15:00, so the days up to January 5 are closed
    assert {r.event_id: r.reason for r in late} == {200: "day_closed", 201: "no_time", 300: "day_closed", 301: "day_closed",
                                                    302: "day_closed", 303: "day_closed"}
    assert sum(r.n_rows for r in closed) + len(late) + still.agg(F.sum("_n")).first()[0] == sum(map(len, batches))


def test_each_message_is_scored_or_rejected_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    good = '{"event_id": %d, "station": "s", "datetime": "2024-01-01 00:00:00", "pm25": 5, "co": "1.5", "humidity": 40, "temperature": 1e1}'
    odd = [None, "", "no json", "[1]", '{"event_id": 7}', '{"event_id": "x", "pm25": true, "co": {}, "humidity": "a", "temperature": null}']
    values = [good % i for i in range(20)] + odd + [good % 3]
    spark.createDataFrame([(v,) for v in values], "value string").repartition(4).write.parquet(src)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(src)
    base = os.path.join(tmp_dir, "base")
    scored, rejects = EP.stream_validated(stream, base=base)
    epochs = EP.Epochs(spark, "x", base)
    for e in (1, 2):  # the folders of a retried epoch are replaced
        part = spark.read.parquet(src).limit(0) if e == 1 else spark.createDataFrame([(good % 50,)], "value string")
        for _ in range(2):
            EP.rejects_step(epochs, S.score_realtime, S.IER_FEATURES)(part, e + 100)
    assert scored.count() == 21 and epochs.all("table", scored.schema).count() == 22 and rejects.count() == len(odd)
    reasons = {r.raw: r.reject_reason for r in rejects.collect()}
    assert [reasons[v] for v in odd] == ["unparsable"] * 4 + ["missing:pm25,co,humidity,temperature",
                                                              "missing:temperature;not_numeric:pm25,co,humidity"]


def test_stream_crisis_rescores_with_profiles(spark, tmp_dir):
    from pneuma.operators import crisis as CR
    from pneuma.operators import features as FT
    from pneuma.plans.q_forest import crisis_columns, fixture
    rows = [_dated(i, i / 24, pm25=float(i % 90)) for i in range(60)]
    df = _readings(spark, rows).withColumns({"user_id": F.col("event_id") % 5, "zone": F.lit("C")})
    src = os.path.join(tmp_dir, "src")
    df.orderBy(F.rand(1)).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    prof = V.profiles(spark, SF)
    for p, model in ((prof, fixture(spark)), (None, fixture(spark))):
        got = crisis_columns(EP.stream_crisis(stream, p, model))
        x = FT.with_history(df)
        exp = crisis_columns(CR.crisis_realtime(x if p is None else FT.with_profile(x, p), model))
        assert got.count() == 60 and got.exceptAll(exp).count() == 0


def _csv(folder, name, header, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join([",".join(header), *(",".join(map(str, r)) for r in rows)]) + "\n")


def test_many_station_files_and_malformed_lines(spark, tmp_dir):
    """Files with different headers load without a loop over them; bad lines are reported as they stand."""
    full = ["No", "year", "month", "day", "hour", "PM2.5", "CO", "TEMP", "DEWP", "station"]
    for i in range(1500):
        _csv(tmp_dir, f"PRSA_Data_S{i}_x.csv", full, [(j, 2024, 1, 1, j, 10.5 + j, "NA", -1, -5, f"S{i}") for j in range(3)])
    other = ["No", "station2", "CO", "PM2.5", "day", "month", "year", "hour"]  # another order, no station column
    _csv(tmp_dir, "PRSA_Data_Named_x.csv", other, [(1, "z", 3, 7.5, 2, 1, 2024, 5)])
    _csv(tmp_dir, "PRSA_Data_Bad_x.csv", full, [(1, 2024, 1, 1, 0, 5, 5, 5, 5, "Bad"), (2, 2024, 1), (3, 2024, 1, 1, 0, "abc", 5, 5, 5, "Bad"),
                                                  (4, 2024, 1, 1, 0, 5, 5, 5, 5, "Bad", "more")])
    with open(os.path.join(tmp_dir, "PRSA_Data_None_x.csv"), "w") as f:
        f.write("1,2,3\n")
    rows, bad = FS.scan_station_csv(spark, tmp_dir)
    assert rows.count() == 4500 + 1 + 1
    named = rows.where("station = 'Named'").first()
    assert (named.No, named["PM2.5"], named.CO, named.TEMP, named.day, named.hour) == (1, 7.5, 3.0, None, 2, 5)
    got = {(r.file.rsplit("_", 2)[-2], r.line): r.reason for r in bad.collect()}
    assert got == {("Bad", "2,2024,1"): "fields", ("Bad", "3,2024,1,1,0,abc,5,5,5,Bad"): "not_numeric",
                   ("Bad", "4,2024,1,1,0,5,5,5,5,Bad,more"): "fields", ("None", "1,2,3"): "no_header"}
    assert FS.load_stations(spark, tmp_dir).where("CO is null and station = 'S7'").count() == 3


def test_labeled_table_snapshots(spark, tmp_dir):
    from pneuma.operators.labeled import LabeledTable
    le = V.labeled_entries(spark, SF)
    t = LabeledTable(spark, os.path.join(tmp_dir, "labeled"))
    assert t.load().count() == 0 and t.user_sample_count().count() == 0
    parts = [le.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i) for i in range(5)]
    for i, p in enumerate(parts):
        t.append(p, batch=f"epoch-{i}")
    before = t.load()  # a reader of the snapshot
    version = t.manifest.latest()
    n = before.count()
    t.append(parts[4], batch="epoch-4")  # the last epoch is tried again
    t.append(le.limit(0), batch="empty")
    assert t.load().count() == n == le.count()
    t.compact()
    assert before.count() == n and t.load(version=version).count() == n  # the snapshot stays whole
    t.append(parts[0], batch="epoch-0")  # a batch that compaction took in stays as it is
    assert t.load().count() == n and len(t.manifest.read()) == 2
    user = le.groupBy("user_id").count().orderBy("user_id").first()
    assert t.load(user_id=user.user_id).count() == user["count"]
    want = {r.user_id: r["count"] for r in le.groupBy("user_id").count().collect()}
    assert {r.user_id: r.n_samples for r in t.user_sample_count().collect()} == want
    plan = t.user_sample_count()._jdf.queryExecution().executedPlan().toString()
    assert "/rows/" not in plan and "/counts/" in plan
    assert t.vacuum() > 0 and t.load().count() == n


def test_a_version_is_published_once(spark, tmp_dir):
    import pytest

    from pneuma.sources.versions import Versions
    v = Versions(spark, os.path.join(tmp_dir, "v"))
    assert v.read() is None and v.publish(lambda old: ["a"]) == 1
    assert v.publish(lambda old: [*old, "b"]) == 2 and v.read() == ["a", "b"] and v.read(1) == ["a"]
    open(os.path.join(tmp_dir, "v", "v000000003.claim"), "w").close()  # another writer is at work
    with pytest.raises(TimeoutError):
        v.publish(lambda old: ["c"], tries=2, wait=0.01)
    assert v.read() == ["a", "b"]


def test_processed_table_is_read_without_exchange(spark, tmp_dir):
    from pneuma.functions import features as FX
    from pneuma.operators import features as FT
    from pneuma.operators import stored
    from pneuma.plans import pipelines as P
    raw = V.stations_raw(spark, SF)
    done = P.preprocess_whole(raw, tmp_dir, "t_processed", buckets=4, block_rows=50)
    assert done.rows.count() == P.preprocess(raw).count() and done.bounds.count() == 4
    labeled = stored.store(done.rows.withColumn("symptom_label", (F.col("pm25") > 80).cast("int")), os.path.join(tmp_dir, "l"), "t_labeled", 4, 50, "_row")
    names = [n for n, _, _ in FX.HISTORY_SPECS]
    for got, exp in ((stored.rolling_24(done.table), FT.rolling_24(done.rows, tiebreak="_row", block_rows=50)),
                     (stored.history_features(done.table).drop("history"),
                      FT.history_features(FT.with_history(done.rows, tiebreak="_row", block_rows=50)).drop("history"))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan, plan
        cols = ["_row", "station", *names]
        assert got.count() == done.rows.count() and got.select(*cols).exceptAll(exp.select(*cols)).count() == 0
    lag = stored.symptom_lag(labeled)
    assert "Exchange" not in lag._jdf.queryExecution().executedPlan().toString()
    exp = FT.symptom_lag(stored.rows(labeled), tiebreak="_row")
    assert lag.select("_row", "symptom_yesterday").exceptAll(exp.select("_row", "symptom_yesterday")).count() == 0
    spark.sql("DROP TABLE t_processed")
    again = stored.open_table(spark, os.path.join(tmp_dir, "table"), "t_processed", 4)
    assert "Exchange" not in stored.rolling_24(again)._jdf.queryExecution().executedPlan().toString()
    assert stored.rows(again).count() == done.rows.count()


def test_whole_batch_reads_its_input_once(spark, tmp_dir):
    from pneuma.operators import profile as PR
    from pneuma.plans import pipelines as P
    m = V.measurements(spark, SF)
    PR.save_bounds(PR.feature_bounds(m), os.path.join(tmp_dir, "b"))
    bounds = spark.read.parquet(os.path.join(tmp_dir, "b"))
    rows, summary = P.run_batch_whole(m, os.path.join(tmp_dir, "t"), "asthme", bounds)
    assert rows.count() == m.count()
    again = PR.batch_summary(rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, summary.select(*again.columns).collect()))
    _, empty = P.run_batch_whole(m.limit(0), os.path.join(tmp_dir, "e"), "asthme", bounds)
    assert empty.count() == 0
    few, _ = P.run_batch_whole(m, os.path.join(tmp_dir, "f"), "asthme", bounds.where("feature = 'pm25'"))  # the others have the defaults
    assert few.where("ier_score is null").count() == 0
