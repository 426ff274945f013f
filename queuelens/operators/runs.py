"""All runs of low speed in a wide window of the day, on smoothed speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def low_runs(rows: DataFrame, keys: list[str], tied: tuple[str, ...] = ()) -> DataFrame:
    """Runs of low speed in each group: rows with keys, t_min, sm (smoothed speed) and cutoff. One row for each run: first
    and last place (from 0), low bins, crossing times in minutes, time and speed of the trough, the cutoff.

    A run goes on until two speeds in a row (or the last one) reach the cutoff: those rows break the series into
    islands, and each island's low rows are a run. The ends are interpolated to the cutoff. ``tied``: the order of
    rows of one time.
    """
    day = W.partitionBy(*keys).orderBy("t_min", *tied)
    df = rows.withColumns({"i": F.row_number().over(day) - 1, "before": F.lag(F.struct("sm", "t_min")).over(day), "after": F.lead(F.struct("sm", "t_min")).over(day)})
    cutoff = F.col("cutoff")
    breaks = (F.col("sm") >= cutoff) & F.coalesce(F.col("after.sm") >= cutoff, F.lit(True))
    df = df.withColumn("island", F.sum(breaks.cast("int")).over(day.rowsBetween(W.unboundedPreceding, 0)))
    low = df.where(F.col("sm") < cutoff)
    cross = lambda a, b, s, t: F.col(f"{a}.{t}") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cutoff - F.col(f"{a}.{s}")) / (F.col(f"{b}.{s}") - F.col(f"{a}.{s}")))) * (F.col(f"{b}.{t}") - F.col(f"{a}.{t}"))
    at = F.struct("sm", "t_min", "before", "after")
    runs = low.groupBy(*keys, "island").agg(
        F.min("i").alias("i_start"), F.max("i").alias("i_end"), F.count(F.lit(1)).alias("n_low"), F.min_by(at, "i").alias("first"), F.max_by(at, "i").alias("last"), F.min(F.struct("sm", "i", "t_min")).alias("trough"), F.first("cutoff").alias("cutoff")
    )
    runs = runs.withColumns({"b": F.col("first.before"), "f": F.struct("first.sm", "first.t_min"), "l": F.struct("last.sm", "last.t_min"), "a": F.col("last.after")})
    t0 = F.coalesce(cross("b", "f", "sm", "t_min"), F.col("f.t_min").cast("double"))
    t3 = F.coalesce(cross("l", "a", "sm", "t_min"), F.col("l.t_min").cast("double"))
    return runs.select(*keys, "i_start", "i_end", "n_low", t0.alias("t0_min"), t3.alias("t3_min"), F.col("trough.t_min").alias("t2_min"), F.col("trough.sm").alias("v_t2"), "cutoff")


def find_runs(states: DataFrame, cutoff: float = 49.0, hours: tuple[int, int] = (5, 22), least_bins: int = 8, smooth: int = 3) -> DataFrame:
    """low_runs() of each sensor and day with at least ``least_bins`` rows in the window, smoothed inside it."""
    half, tied = smooth // 2, tuple(c for c in ("corridor", "road_order") if c in states.columns)
    df = states.withColumns({"date": F.date_format("datetime", "yyyy-MM-dd"), "t_min": F.hour("datetime") * 60 + F.minute("datetime"), "cutoff": F.lit(float(cutoff))})
    day = W.partitionBy("sensor_uid", "date")
    df = df.where((F.hour("datetime") >= hours[0]) & (F.hour("datetime") < hours[1])).withColumn("n", F.count(F.lit(1)).over(day)).where(F.col("n") >= least_bins)
    df = df.withColumn("sm", F.avg("speed_mph").over(day.orderBy("datetime", *tied).rowsBetween(-half, half)))
    return low_runs(df, ["sensor_uid", "date"], tied).drop("cutoff")
