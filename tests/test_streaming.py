import datetime as dt

from pyspark.sql import functions as F

from placewise.streaming import live as LS


def test_freshness_timer(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, (station, minute) in enumerate([(1, 0), (2, 30), (2, 60)]):
        spark.createDataFrame([(station, t0 + dt.timedelta(minutes=minute))], "station long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        q = (LS.freshness_job(spark.readStream.schema("station long, ts timestamp").parquet(src)).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {(r.station, r.status) for r in spark.read.parquet(out).select("station", "status").collect()}
    assert {(1, "ok"), (2, "ok"), (1, "stale")} <= got


def test_live_twin_equals_batch(spark):
    from placewise.operators.live import decode, latest
    from placewise.plans import bindings as B
    d = "/root/testdata/sf0.001"
    ev = B.table(spark, d, "events")
    want = latest(decode(LS.readings(ev), LS.registry(ev)), "station").select("station", "value", "ts")
    import tempfile
    got = LS.run_latest(spark, f"{d}/events.parquet", tempfile.mkdtemp(prefix="placewise-live-")).select("station", "value", "ts")
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    assert got.select(F.count("*")).first()[0] > 0
