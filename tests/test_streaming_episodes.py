"""A stream's episodes against the same rule over the whole table, and over a plain loop."""

import datetime as dt
import random

from queuelens.streaming import episodes


def test_stream_and_table_give_the_same_episodes(spark, tmp_path):
    rng, rows = random.Random(6), []
    for s in ("a", "b", "c"):
        t, v = dt.datetime(2024, 1, 1, 5), 60.0
        for _ in range(200):
            t += dt.timedelta(minutes=rng.choice((5, 5, 5, 5, 15, 20)))
            v = min(75.0, max(20.0, v + rng.uniform(-14, 14)))
            rows.append((s, t, None if rng.random() < 0.05 else v))
    rows.sort(key=lambda r: r[1])
    end = [("z", rows[-1][1] + dt.timedelta(hours=h), 70.0) for h in (1, 2, 3)]  # moves the watermark on
    schema = "sensor_uid string, ts timestamp, speed double"
    whole = spark.createDataFrame(rows, schema)
    parts = [rows[i : i + 75] for i in range(0, len(rows), 75)] + [[e] for e in end]
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i:03d}"))
    table = {tuple(r) for r in episodes.boundary_scan(whole).collect()}

    want = set()
    for s in ("a", "b", "c"):
        now, last, fast = [], None, False
        for _, t, v in (r for r in rows if r[0] == s and r[2] is not None):
            if now and (t - last > dt.timedelta(minutes=15) or v > 50 and fast):
                want.add((s, now[0][0], now[-1][0], min(x[1] for x in now), len(now)))
                now = []
            if v <= 50:
                now.append((t, v))
            last, fast = t, v > 50
        if now:
            want.add((s, now[0][0], now[-1][0], min(x[1] for x in now), len(now)))
    assert table == want and len(want) > 20

    from pyspark.sql import functions as F

    feed = spark.readStream.schema(schema + ", p string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = episodes.online_episodes(feed.select("sensor_uid", "ts", "speed")).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).format("memory").queryName("found_online").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("found_online").where(F.col("sensor_uid") != "z").collect()}
    assert got == want
