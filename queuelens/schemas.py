"""Contracts: columns of the detector time series, periods, thresholds and priors.

Fixed values: they must equal the published method's for equal results.
"""

from __future__ import annotations

from pyspark.sql import types as T

STATES = T.StructType(
    [
        T.StructField("sensor_uid", T.StringType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("speed_mph", T.DoubleType()),
        T.StructField("flow_vph", T.DoubleType()),
        T.StructField("density_vpm", T.DoubleType()),
        T.StructField("has_volume", T.BooleanType()),
        T.StructField("flow_synthetic", T.BooleanType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("lanes", T.DoubleType()),
        T.StructField("length_mi", T.DoubleType()),
        T.StructField("road_order", T.DoubleType()),
        T.StructField("direction", T.StringType()),
        T.StructField("corridor", T.StringType()),
    ]
)
DT_MIN = 5
KMH_PER_MPH = 1.609

#: First and last hour (exclusive) of each period; NT wraps past midnight. MDPM is the label of merged episodes.
PERIODS = {"AM": (6, 10), "MD": (10, 16), "PM": (16, 20), "NT": (20, 6)}
SLICES = {**PERIODS, "MDPM": (10, 20)}

DEFAULT_VC_MPH = 50.0
UNCONGESTED_BELOW_MIN, RECURRING_FROM_MIN, SEVERE_FROM_MIN = 30.0, 60.0, 120.0
SEVERE_SPEED_RATIO, EVENT_Z = 0.5, 2.5
RELIABLE_FROM = {"high": 20, "medium": 10, "low": 5}
DISCHARGE_MIN_BINS = 6
MAD_SCALE = 1.4826
IQR_FACTOR, MIN_FIT_POINTS = 3.0, 5

#: Time-of-day windows of travel-time reliability: weekday (True), weekend (False) or all days (None), hours.
LOTTR_PERIODS = {"AM_6_10": (True, 6, 10), "MID_10_16": (True, 10, 16), "PM_16_20": (True, 16, 20), "WE_6_20": (False, 6, 20)}
TTTR_PERIODS = {**LOTTR_PERIODS, "OVN_20_6": (None, 20, 6)}
LOTTR_RELIABLE_BELOW, PM3_MIN_EPOCHS = 1.5, 8

#: Default, least and largest value of each queue parameter; values outside turn into the default.
FEASIBLE = {
    "Q_n": (1.24, 1.0, 1.5),
    "Q_s": (1.0, 0.5, 4.0),
    "Q_cd": (1.0, 0.5, 2.0),
    "Q_cp": (0.2, 0.0, 2.0),
    "Q_alpha": (0.27, 0.01, 1.0),
    "Q_beta": (1.14, 0.5, 5.0),
    "P_hours": (0.0, 0.0, 10.0),
}
Q_S_ANCHOR, Q_CD_ANCHOR, Q_N_FALLBACK = 4.0, 1.0, 1.124

#: Priors of the S-shaped diagram: free-flow speed, critical density, shape and lane capacity.
S3_PRIORS = {
    "cbi_default": {"vf_mph": 70.0, "k_critical_vpm": 45.0, "s3_m": 4.0, "lane_capacity_vphpl": 2200.0},
    "urban_freeway": {"vf_mph": 65.0, "k_critical_vpm": 50.0, "s3_m": 4.0, "lane_capacity_vphpl": 2200.0},
    "rural_freeway": {"vf_mph": 75.0, "k_critical_vpm": 32.0, "s3_m": 4.0, "lane_capacity_vphpl": 1900.0},
    "az_tmc_i17": {"vf_mph": 75.0, "k_critical_vpm": 32.0, "s3_m": 4.0, "lane_capacity_vphpl": 1900.0},
    "ca_pems_freeway": {"vf_mph": 65.0, "k_critical_vpm": 50.0, "s3_m": 4.0, "lane_capacity_vphpl": 2200.0},
    "arterial": {"vf_mph": 45.0, "k_critical_vpm": 35.0, "s3_m": 4.0, "lane_capacity_vphpl": 1500.0},
}
#: Pipeline gates: least share of rows that pass, direction confidence, share of valid episodes, diagram R2, gain of R2
#: of valid episodes over all days, fitted groups.
PIPELINE_GATES = {"qc_pass_rate": 0.85, "direction_confidence": 0.50, "valid_episode_pct": 0.05, "fd_r2": 0.70, "mu_r2_gap": 0.10, "qvdf_n_fitted": 5.0}
#: Gates of the average-weekday method.
DEMO_GATES = {"min_n_links": 5, "min_step1_r2": 0.50, "min_step2_r2": 0.30, "max_p_mape": 30.0, "max_vt2_mape": 30.0, "min_vt2_within": 70.0, "min_smooth_r2": 0.90, "min_fd_r2": 0.70}
#: The average-weekday method: minutes of a bin, cutoff over free-flow speed, quantile of the outer layer, periods and
#: search window in minutes, largest demand over capacity, least congested days, days of high reliability, weight of the
#: corridor's median, bounds of parameters, tolerance of lowest speeds.
DEMO_DT, DEMO_CUTOFF, DEMO_OUTER, DEMO_DOC_MAX = 15, 0.70, 0.90, 6.0
DEMO_PERIODS = {"AM": (300, 600), "MD": (600, 840), "PM": (840, 1200)}
DEMO_WINDOW, DEMO_MIN_DAYS, DEMO_HIGH_DAYS, DEMO_K0, DEMO_BOUNDS, DEMO_VT2_TOL = (300, 1320), 3, 5, 2.0, (0.0, 10.0), 10.0
DEMO_MIN_EPISODE_H = 0.5
#: Parameters where a link can't be calibrated, by facility and area; the first is for all others.
DEMO_DEFAULT = {"f_d": 1.30, "n": 1.00, "f_p": 0.20, "s": 1.30}
DEMO_CLASSES = {
    ("freeway", "urban"): {"f_d": 1.15, "n": 1.05, "f_p": 0.15, "s": 1.25},
    ("freeway", "suburban"): {"f_d": 1.30, "n": 1.00, "f_p": 0.10, "s": 1.35},
    ("freeway_managed", "urban"): {"f_d": 1.00, "n": 1.00, "f_p": 0.08, "s": 1.30},
    ("freeway_managed", "suburban"): {"f_d": 1.10, "n": 1.00, "f_p": 0.06, "s": 1.35},
}
