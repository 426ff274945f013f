"""Quality gates: each is a rule over aggregates; all of a table's gates take one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens import schemas as S


def _band(value: Column, good: Column, fair: Column | None = None) -> Column:
    out = F.when(value.isNull(), "N/A").when(good, "PASS")
    return (out.when(fair, "REVIEW") if fair is not None else out).otherwise("REVIEW" if fair is None else "FAIL")


def episode_gates(episodes: DataFrame, capacity: DataFrame) -> DataFrame:
    """(gate, value, status) of episodes with mu_obs_vphpl; capacity: sensor_uid, capacity_vphpl."""
    valid = episodes.where("is_valid_for_mu").join(capacity, "sensor_uid", "left").withColumn("ratio", F.col("mu_obs_vphpl") / F.col("capacity_vphpl"))
    pinned = (F.col("period") == "MD") & (F.col("t3_index") >= 71)
    a = valid.agg(
        F.percentile("capacity_vphpl", F.lit(0.5)).alias("capacity"), F.percentile("ratio", F.lit(0.5)).alias("ratio"), F.count_if(F.col("min_speed_mph") >= F.col("v_c_mph")).cast("double").alias("slow"),
        (F.count_if(pinned) / F.nullif(F.count_if(F.col("period") == "MD"), F.lit(0))).alias("cut"),
    )
    thick = valid.groupBy("sensor_uid", "period").count().agg(F.avg((F.col("count") >= 5).cast("double")).alias("thick"))
    a = a.crossJoin(thick)  # one row each
    c = F.col
    rules = {
        "capacity_band": ("capacity", _band(c("capacity"), c("capacity").between(1500, 2300))),
        "mu_over_capacity": ("ratio", _band(c("ratio"), c("ratio").between(0.85, 0.98), c("ratio").between(0.80, 1.05))),
        "vt2_below_vc": ("slow", _band(c("slow"), c("slow") == 0, c("slow") <= 3)),
        "groups_with_5_valid": ("thick", _band(c("thick"), c("thick") >= 0.5, c("thick") >= 0.3)),
        "md_truncation": ("cut", _band(c("cut"), c("cut") <= 0.2, c("cut") <= 0.35)),
    }
    return a.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), c(v).cast("double").alias("value"), s.alias("status")) for g, (v, s) in rules.items()])))


def run_gates(audited: DataFrame) -> DataFrame:
    """(gate, value, status) over audits.audit(): physics bands, sufficiency, truncation and, for information, weekends."""
    ratio = F.col("mu_obs_vphpl") / F.col("capacity_calibrated_vphpl")
    md = F.col("period") == "MD"
    a = audited.agg(
        F.percentile("capacity_calibrated_vphpl", F.lit(0.5)).alias("capacity"), F.percentile(ratio, F.lit(0.5)).alias("ratio"), F.count_if(F.col("v_t2_mph") >= F.col("v_c_calibrated_mph")).cast("double").alias("slow"),
        F.percentile("mu_consistency", F.lit(0.5)).alias("consistency"), (F.count_if(md & (F.col("t3_index") >= 71)) / F.nullif(F.count_if(md), F.lit(0))).alias("cut"), F.avg((F.weekday(F.to_date("date")) >= 5).cast("double")).alias("weekend"),
    )
    thick = audited.groupBy("sensor_uid", "period").count().agg(F.avg((F.col("count") >= 5).cast("double")).alias("thick"))
    a = a.crossJoin(thick)  # one row each
    c = F.col
    rules = {
        "capacity_band": ("capacity", _band(c("capacity"), c("capacity").between(1500, 2300))),
        "mu_over_capacity": ("ratio", _band(c("ratio"), c("ratio").between(0.85, 0.98), c("ratio").between(0.80, 1.05))),
        "vt2_below_vc": ("slow", _band(c("slow"), c("slow") == 0, c("slow") <= 3)),
        "mu_consistency": ("consistency", _band(c("consistency"), c("consistency") <= 0.10)),
        "groups_with_5_valid": ("thick", _band(c("thick"), c("thick") >= 0.5, c("thick") >= 0.3)),
        "md_truncation": ("cut", _band(c("cut"), c("cut") <= 0.2, c("cut") <= 0.35)),
        "weekend_share": ("weekend", F.when(c("weekend").isNull(), "N/A").otherwise("INFO")),
    }
    return a.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), c(v).cast("double").alias("value"), s.alias("status")) for g, (v, s) in rules.items()])))


def run_comparison(audited: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """period, valid episodes and medians of duration, lowest speed, discharge rate and capacity over audits.audit(); beside
    them, as ref_..., those of a reference run's audit. Periods are those of the current run."""
    mid = lambda c: F.bround(F.percentile(c, F.lit(0.5)), 1)
    columns = {"n_valid": F.count(F.lit(1)), "P_min_median": mid("P_min"), "v_t2_median": mid("v_t2_mph"), "mu_median": mid("mu_obs_vphpl"), "capacity_median": mid("capacity_calibrated_vphpl")}
    out = audited.groupBy("period").agg(*[c.alias(k) for k, c in columns.items()])
    if reference is None:
        return out
    ref = reference.groupBy("period").agg(*[c.alias(f"ref_{k}") for k, c in columns.items() if k != "capacity_median"])
    return out.join(ref, "period", "left")


def trip_gates(trips: DataFrame, errors: DataFrame) -> DataFrame:
    """(period, gate, value, status): medians of the round trip's and the speed profile's errors by period, and the share
    of episodes whose calibration isn't ok. trips: audits.round_trip(); errors: audits.speed_errors()."""
    median = lambda df, g, c, good, fair=None: df.groupBy("period").agg(F.percentile(c, F.lit(0.5)).alias("value")).select("period", F.lit(g).alias("gate"), "value", F.lit(good).alias("good"), F.lit(fair).cast("double").alias("fair"))
    rows = median(trips, "roundtrip_P_err_pct", F.abs("P_err_pct"), 1.0).unionByName(median(trips, "roundtrip_vt2_err_pct", F.abs("vt2_err_pct"), 1.0))
    rows = rows.unionByName(median(errors.where("v_t_MAE is not null"), "vt_speed_MAE", F.col("v_t_MAE"), 10.0, 15.0))
    bad = trips.agg(F.avg((F.col("calibration_status") != "ok").cast("double")).alias("value"))
    rows = rows.unionByName(bad.select(F.lit("all").alias("period"), F.lit("calibration_not_ok_share").alias("gate"), "value", F.lit(0.25).alias("good"), F.lit(0.4).alias("fair")))
    status = F.when(F.col("value").isNull(), "N/A").when(F.col("value") <= F.col("good"), "PASS").when(F.coalesce(F.col("value") <= F.col("fair"), F.lit(False)), "REVIEW").otherwise("FAIL")
    return rows.select("period", "gate", "value", status.alias("status"))


def ranking_gates(agreement: DataFrame, ranking: DataFrame) -> DataFrame:
    """(corridor, gate, value, status): there is a ranking at all, its top five overlap those of a reference. agreement:
    panels.rank_agreement()."""
    there = ranking.groupBy("corridor").agg(F.count(F.lit(1)).cast("double").alias("value")).select("corridor", F.lit("ranking_exists").alias("gate"), "value", F.when(F.col("value") > 0, "PASS").otherwise("FAIL").alias("status"))
    n, top = F.col("n_common"), F.col("top5_overlap")
    some = agreement.select("corridor", F.lit("top5_overlap").alias("gate"), top.cast("double").alias("value"), F.when(n < 5, "N/A").when(top >= 4, "PASS").when(top >= 3, "REVIEW").otherwise("FAIL").alias("status"))
    return there.unionByName(some)


def pipeline_gates(values: DataFrame, measured: bool = True) -> DataFrame:
    """(gate, value, threshold, status) and the row __overall__. values: one row with a column for each gate; a missing
    value is UNKNOWN; the diagram's R2 is N/A where no volume was measured."""
    rules = []
    for g, least in S.PIPELINE_GATES.items():
        v, counts = F.col(g).cast("double"), measured or g != "fd_r2"
        status = F.lit("N/A") if not counts else F.when(v.isNull(), "UNKNOWN").when(v >= least, "PASS").otherwise("FAIL")
        rules.append(F.struct(F.lit(g).alias("gate"), (v if counts else F.lit(None).cast("double")).alias("value"), F.lit(least if counts else None).cast("double").alias("threshold"), status.alias("status")))
    every = F.array(*rules)
    has = lambda s: F.exists("rules", lambda r: r["status"] == s)
    df = values.select(every.alias("rules"))
    total = F.struct(F.lit("__overall__").alias("gate"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), F.when(has("FAIL"), "FAIL").when(has("PASS"), "PASS").otherwise("INCONCLUSIVE").alias("status"))
    return df.select(F.inline(F.concat("rules", F.array(total))))


def fd_fit_ok(r2: str = "r2", capacity: str = "capacity_vphpl", v_f: str = "v_f_mph") -> Column:
    return F.coalesce((F.col(r2) > 0) & F.col(capacity).between(1200, 2600) & F.col(v_f).between(40, 90), F.lit(False))


def overall(gates: DataFrame) -> DataFrame:
    worst = F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "REVIEW"), "REVIEW").when(F.bool_and(F.col("status") == "N/A"), "UNKNOWN").otherwise("PASS")
    return gates.agg(worst.alias("overall"), F.count(F.lit(1)).alias("n_gates"))
