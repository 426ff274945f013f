"""Detector time series out of the driver's ``events`` table, whole. Seven users make a sensor and eight sensors a corridor;
three calendar days make a day of record. An event reports the hour after it in steps of five minutes, so that bins without
a report stay empty. Each corridor has a morning and an evening bottleneck, whose queues reach upstream, later and shorter
at each sensor; their lengths depend on the day, and some days are free. Speeds fall in a queue by a parabola, less a share
of the event's value; flows follow each sensor's S-shaped diagram, in a queue its slowly falling discharge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions.traffic import s3_capacity, s3_flow

FIRST_DAY = "2024-01-01"


def _queue(hour: Column, centre: Column, half: Column, depth: float) -> Column:
    """How far speed falls within half an opening of the centre."""
    x = (hour - centre) / half
    return F.when((half > 0) & (F.abs(hour - centre) < half), depth * (1 - x * x)).otherwise(0.0)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: sensor, time, speed, flow and user; twelve of each event."""
    number, ts = F.expr("user_id div 7"), F.col("ts").cast("timestamp_ntz")
    days = F.datediff(ts.cast("date"), F.lit(FIRST_DAY).cast("date"))
    uid = F.concat(F.lit("S"), F.lpad(number.cast("string"), 4, "0"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(uid.alias("sensor_uid"), number.alias("number"), ts.alias("ts"), days.alias("days"), "value", "event_id", "user_id")
    # Dealt out by sensor before the rows become twelve times as many: bins and each sensor's windows need no other shuffle.
    # A given number of partitions stays, while others are merged by the size that they have before.
    # The twelve times of an event are a list, so that conditions on them don't work them out again; no time is twelve nulls.
    df = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sensor_uid").withColumn("ts", F.expr("timestampadd(DAY, (days div 3) - days, ts)"))
    times = F.expr("coalesce(sequence(ts, ts + interval 55 minutes, interval 5 minutes), array_repeat(cast(null as timestamp_ntz), 12))")
    df = df.select("*", F.posexplode(times).alias("step", "at")).withColumn("ts", F.col("at"))
    n, day, weekend = F.col("number"), F.dayofmonth("ts"), F.weekday("ts") >= 5
    corridor, place = F.expr("number div 8"), n % 8
    hour = F.hour("ts") + F.minute("ts") / 60.0
    morning = F.when(weekend | (place > 5), 0.0).otherwise(((corridor + day) % 6) * 0.4 - (5 - place) * 0.2)
    evening = F.when(place > 6, 0.0).otherwise(((corridor * 2 + day * 3) % 8) * F.when(weekend, 0.3).otherwise(0.5) - (6 - place) * 0.3)
    fall = _queue(hour, 8.0 + (5 - place) * 0.1, morning, 36.0) + _queue(hour, 17.0 + (6 - place) * 0.1, evening, 42.0)
    noise = 0.06 * F.least(F.col("value"), F.lit(140.0)) + ((F.col("event_id") * 7 + F.col("step") * 5) % 11) * 0.3
    df = df.withColumns({"speed": 70.0 - fall - noise, "fall": fall, "kc": 30.0 + (n % 4) * 3.0, "hour": hour})
    free = s3_flow("speed", 70.0, "kc", 4.0)
    discharge = s3_capacity(70.0, "kc", 4.0) * (1.0 - 0.01 * (F.col("hour") - F.when(F.col("hour") < 12, 4.0).otherwise(12.0)))
    flow = F.when(F.col("fall") > 18, discharge).otherwise(free) * (0.92 + F.col("event_id") % 11 / 100.0)
    return df.select("sensor_uid", "number", "ts", "speed", flow.alias("flow"), "user_id")


def resampled(raw: DataFrame, minutes: int = S.DT_MIN, least: int = 1) -> DataFrame:
    """Median speed and flow of each sensor and bin with at least ``least`` readings; empty bins stay absent. Both are
    on a binary grid, moved off the ties of decimal rounding."""
    slot = F.expr(f"timestampadd(MINUTE, -(minute(ts) % {minutes}), date_trunc('MINUTE', ts))").cast("timestamp_ntz")
    lists = raw.select("sensor_uid", "number", slot.alias("datetime"), "speed", "flow").groupBy("sensor_uid", "number", "datetime").agg(F.sort_array(F.collect_list("speed")).alias("speed"), F.sort_array(F.collect_list("flow")).alias("flow"))

    def median(c: str) -> Column:  # of the few readings of a bin
        n = F.size(c)
        return (F.col(c)[F.floor((n - 1) / 2).cast("int")] + F.col(c)[F.floor(n / 2).cast("int")]) / 2

    bins = lists.select("sensor_uid", "number", "datetime", (F.round(median("speed") * 1024) / 1024 + 0.000132170713).alias("speed_mph"), (F.round(median("flow") * 8) / 8 + 0.03713217).alias("flow_vph"), F.size("speed").cast("long").alias("n_readings"))
    return bins.where(F.col("n_readings") >= least)


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corridor, sensor_uid, road_order of every sensor."""
    n = F.col("number")
    numbers = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("user_id div 7").alias("number")).distinct()
    return numbers.select(F.concat(F.lit("C"), F.expr("number div 8").cast("string")).alias("corridor"), F.concat(F.lit("S"), F.lpad(n.cast("string"), 4, "0")).alias("sensor_uid"), (n % 8).cast("double").alias("road_order"))


def states(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """only: a condition on the readings' ts. It has to hold for all of a bin's readings or none: pushed down from the bins,
    it would be worked out again for each reading, in code too long to be compiled."""
    n, raw = F.col("number"), readings(spark, sf_dir)
    return resampled(raw if only is None else raw.where(only)).select(
        "sensor_uid",
        "datetime",
        "speed_mph",
        "flow_vph",
        (F.col("flow_vph") / F.col("speed_mph")).alias("density_vpm"),
        F.lit(True).alias("has_volume"),
        F.lit(False).alias("flow_synthetic"),
        F.lit("events").alias("source_format"),
        (2 + n % 3).cast("double").alias("lanes"),
        (0.5 + 0.25 * (n % 5)).cast("double").alias("length_mi"),
        (n % 8).cast("double").alias("road_order"),
        F.lit("N").alias("direction"),
        F.concat(F.lit("C"), F.expr("number div 8").cast("string")).alias("corridor"),
    )
