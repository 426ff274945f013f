"""Queue discharge rates: by episode, by link, and shrunk towards the corridor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.operators.episodes import day_periods, sliced


def mu_per_episode(episodes: DataFrame, qc: DataFrame) -> DataFrame:
    """Adds mu_obs_vphpl: the median flow over a valid episode's discharge window, from six known flows on.

    An equi-join on sensor, date and period with the place in the period as a range condition; only rows of periods with
    such an episode get places.
    """
    keys = ["sensor_uid", "date", "period"]
    spans = episodes.where("is_valid_for_mu and discharge_start_idx is not null").select(*keys, "discharge_start_idx", "discharge_end_idx")
    rows = sliced(qc, day_periods(), spans).select(*keys, "idx", "flow_vph")
    inside = rows.join(spans, keys).where("idx between discharge_start_idx and discharge_end_idx and flow_vph is not null")
    mu = inside.groupBy(*keys).agg(F.percentile("flow_vph", F.lit(0.5)).alias("mu"), F.count("flow_vph").alias("n"))
    mu = mu.where(F.col("n") >= S.DISCHARGE_MIN_BINS).select(*keys, F.col("mu").alias("mu_obs_vphpl"))
    return episodes.join(mu, keys, "left")


def mu_per_link(episodes: DataFrame, reliability: DataFrame) -> DataFrame:
    """Median and interquartile range of the valid episodes' rates."""
    valid = F.when(F.col("is_valid_for_mu"), F.col("mu_obs_vphpl"))
    quarter = lambda p: F.percentile(valid, F.lit(p))
    links = episodes.groupBy("sensor_uid").agg(
        F.min("corridor").alias("corridor"),
        F.count(F.lit(1)).alias("n_episodes_total"),
        F.sum(F.col("is_valid_for_mu").cast("long")).alias("n_episodes_valid"),
        quarter(0.5).alias("mu_obs_median_vphpl"),
        (quarter(0.75) - quarter(0.25)).alias("mu_obs_iqr_vphpl"),
    )
    return links.join(reliability.select("sensor_uid", "reliability_class"), "sensor_uid", "left").fillna("not_reliable", ["reliability_class"])


def shrink_to_group(links: DataFrame, group: str = "corridor") -> DataFrame:
    """Low and unreliable links are drawn to the median of their group's reliable links (of all reliable links where the
    group has none); links without a rate take it. Without any reliable link nothing is drawn."""
    mu, n = F.col("mu_obs_median_vphpl"), F.col("n_episodes_valid")
    sound = links.where(F.col("reliability_class").isin("high", "medium"))
    whole = sound.agg(F.count(F.lit(1)).alias("_sound"), F.greatest(F.percentile("n_episodes_valid", F.lit(0.5)), F.lit(1.0)).alias("_k0"), F.percentile("mu_obs_median_vphpl", F.lit(0.5)).alias("_all"))
    groups = sound.groupBy(group).agg(F.percentile("mu_obs_median_vphpl", F.lit(0.5)).alias("_group"), F.lit(True).alias("_has"))
    df = links.join(groups, group, "left").crossJoin(F.broadcast(whole))  # one row
    some = F.col("_sound") > 0
    median = F.when(some, F.when(F.col("_has"), F.col("_group")).otherwise(F.col("_all")))
    alpha = F.when(some, n / (n + F.col("_k0")))
    weak = F.col("reliability_class").isin("low", "not_reliable")
    shrunk = F.when(some & mu.isNull(), median).when(some & weak, alpha * mu + (1 - alpha) * median).otherwise(mu)
    source = F.when(mu.isNull(), "group_only").when(some & weak, "shrunk").otherwise("self")
    return df.select(*links.columns, median.alias("mu_group_median_vphpl"), alpha.alias("alpha_shrinkage"), shrunk.alias("mu_shrunk_vphpl"), source.alias("mu_source"))
