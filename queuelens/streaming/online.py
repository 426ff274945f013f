"""Extensions for streams: the batch resampling and gap rule over unbounded readings.

The batch method has no stream of its own; these are its nearest native forms, with a watermark that bounds state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens import schemas as S


def resample_stream(readings: DataFrame, late: str = "10 minutes", minutes: int = S.DT_MIN) -> DataFrame:
    """Bins of readings (sensor_uid, ts, speed) with mean, least and count; a bin is final once the watermark passes it."""
    bins = readings.withWatermark("ts", late).groupBy("sensor_uid", F.window("ts", f"{minutes} minutes"))
    return bins.agg(F.avg("speed").alias("speed_mph"), F.min("speed").alias("min_speed"), F.count("speed").alias("n_readings")).select("sensor_uid", F.col("window.start").alias("datetime"), "speed_mph", "min_speed", "n_readings")


def congestion_sessions(readings: DataFrame, v_c: float = S.DEFAULT_VC_MPH, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of readings at or below v_c that no gap of 15 minutes breaks: a session window for each sensor.
    The watermark follows the slow readings: a span is final once a later one has begun."""
    slow = readings.withWatermark("ts", late).where(F.col("speed") <= v_c).groupBy("sensor_uid", F.session_window("ts", gap))
    return slow.agg(F.min("speed").alias("min_speed"), F.count("speed").alias("n_slow")).select("sensor_uid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "min_speed", "n_slow")
