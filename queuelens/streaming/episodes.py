"""Episodes while readings come in: the boundary rule of two fast readings in a row, or of a silence, as state of a few
numbers a sensor; and the same rule over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from queuelens import schemas as S

GAP_MIN = 15
_OUT = "sensor_uid string, begin timestamp, end timestamp, min_speed double, n_slow long"
_STATE = "begin timestamp, end timestamp, least double, n long, last timestamp, fast boolean"


def boundary_scan(readings: DataFrame, v_c: float = S.DEFAULT_VC_MPH, gap_min: int = GAP_MIN) -> DataFrame:
    """sensor_uid, begin, end, min_speed, n_slow of readings (sensor_uid, ts, speed): from the first slow reading to the last
    one before two fast readings in a row, or before a silence of over ``gap_min`` minutes. Readings without a speed don't
    count. Slow is at or below v_c."""
    order = W.partitionBy("sensor_uid").orderBy("ts", F.desc("speed"))
    df = readings.where("speed is not null").withColumns({"fast": F.col("speed") > v_c, "before": F.lag(F.struct("ts", "speed")).over(order)})
    silence = F.coalesce(F.unix_micros("ts") - F.unix_micros("before.ts") > gap_min * 60_000_000, F.lit(False))
    ends = silence | F.col("fast") & F.coalesce(F.col("before.speed") > v_c, F.lit(False))
    df = df.withColumn("island", F.sum(ends.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    slow = df.where("not fast").groupBy("sensor_uid", "island")
    return slow.agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.min("speed").alias("min_speed"), F.count(F.lit(1)).alias("n_slow")).drop("island")


def online_episodes(readings: DataFrame, v_c: float = S.DEFAULT_VC_MPH, gap_min: int = GAP_MIN, late: str = "10 minutes") -> DataFrame:
    """boundary_scan() over a stream. A sensor's readings come in order from batch to batch, in any order within one.

    An episode is given out at the reading that ends it, or by a timer once the watermark has passed its sensor's last
    reading by the gap. State: the open episode's two times, least speed and count, and the last reading's time and kind.
    """
    gap = pd.Timedelta(minutes=gap_min)

    def scan(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        begin, end, least, n, last, fast = state.get if state.exists else (None, None, None, 0, None, False)
        if state.hasTimedOut:
            done += [(key[0], begin, end, least, n)] if n else []
            state.remove()
        else:
            rows = pd.concat(list(batches)).dropna(subset=["speed"]).sort_values(["ts", "speed"], ascending=[True, False])
            for ts, speed in zip(rows["ts"], rows["speed"], strict=True):
                is_fast = speed > v_c
                if n and (ts - last > gap or is_fast and fast):
                    done.append((key[0], begin, end, least, n))
                    n = 0
                if not is_fast:
                    begin, least = (ts, speed) if not n else (begin, min(least, speed))
                    end, n = ts, n + 1
                last, fast = ts, is_fast
            if last is not None:
                state.update((begin, end, least, n, last, bool(fast)))
                state.setTimeoutTimestamp(max(int((last + gap).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["sensor_uid", "begin", "end", "min_speed", "n_slow"])

    keyed = readings.withWatermark("ts", late).groupBy("sensor_uid")
    return keyed.applyInPandasWithState(scan, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
