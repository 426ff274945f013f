"""What the average-weekday method hands on: a table of links by time of day, the links' parameters, errors and gammas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions.traffic import gamma_of, predict_vt2
from queuelens.operators.flows import co2_grams_per_mile, corridor_flow
from queuelens.operators.weekday import PARAMETERS, _period

HOURS = S.DEMO_DT / 60


def nodes(links: DataFrame) -> DataFrame:
    """corridor, link_id, from_node_id, to_node_id: a corridor's links in the order of their ids, from node 1 on."""
    place = F.row_number().over(W.partitionBy("corridor").orderBy("link_id"))
    one = links.select("corridor", "link_id").distinct().withColumn("from_node_id", place)
    return one.withColumn("to_node_id", F.col("from_node_id") + 1)


def time_table(modelled: DataFrame, diagrams: DataFrame, m: float = 6.0, least_bins: int = 8) -> DataFrame:
    """One row for each link and bin of the average weekday: nodes, raw, smoothed and modelled speed, counts, miles, hours,
    delay against free flow and against the speed at capacity (neither negative), CO2 at both speeds, and the flow that
    conserves demand where the model is below the cutoff.

    modelled: rows of flows.whole_day; diagrams: corridor, link_id, vf, uc, cap. Links with fewer than ``least_bins`` bins
    have none; without a flow, counts and what follows from them are null. The conserved flow has one density scale a
    corridor, and a slack for each link and period; demand there is the count, or the capacity over the congested time
    where nothing was counted; a link's period with a single congested bin has none. It reads the rounded columns.
    """
    link = W.partitionBy("link_id")
    known = nodes(diagrams).join(diagrams.select("corridor", "link_id", "vf", "uc", "cap"), ["corridor", "link_id"])
    df = modelled.withColumn("_n", F.count(F.lit(1)).over(link)).where(F.col("_n") >= least_bins).drop("period", "_n").join(known, "link_id")
    df = df.withColumns({"period": F.coalesce(_period(F.col("t_min")), F.lit("NT")), "per_lane": F.col("flow_pl") * HOURS})
    df = df.withColumn("total", F.col("per_lane") * F.col("lanes")).withColumn("miles", F.col("total") * F.col("length"))
    df = df.withColumn("hours", F.col("miles") / F.greatest("speed", F.lit(1.0)))
    late = lambda at: F.when(F.col("hours").isNotNull(), F.greatest(F.col("hours") - F.col("miles") / F.col(at), F.lit(0.0)))
    table = df.select(
        "corridor",
        "link_id",
        "from_node_id",
        "to_node_id",
        "t_min",
        "period",
        F.round("speed", 2).alias("speed_raw"),
        F.round("sm", 2).alias("speed_smoothed"),
        F.round("model_speed", 2).alias("speed_model"),
        F.round("per_lane", 1).alias("count_per_lane"),
        "lanes",
        F.round("total", 1).alias("count_total"),
        F.round("length", 3).alias("length_mi"),
        F.col("vf").alias("free_flow"),
        F.round("cutoff", 1).alias("cutoff"),
        F.round("cap", 0).alias("capacity_vphpl"),
        F.round("miles", 2).alias("vmt"),
        F.round("hours", 3).alias("vht"),
        F.round(late("vf"), 3).alias("vdt"),
        F.round(late("uc"), 3).alias("vcdt"),
        F.round(co2_grams_per_mile(F.col("speed")) * F.col("miles"), 1).alias("co2_g_observed"),
        F.round(co2_grams_per_mile(F.col("model_speed")) * F.col("miles"), 1).alias("co2_g_model"),
    )
    part = W.partitionBy("link_id", "period")
    slow = table.where(F.col("speed_model") < F.col("cutoff")).select("corridor", "link_id", "period", "t_min", "lanes", "count_total", "capacity_vphpl", F.col("speed_model").alias("speed"), F.col("free_flow").alias("vf"))
    slow = slow.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_lanes", F.min("lanes").over(part))
    counted = F.coalesce(F.sum("count_total").over(part), F.lit(0.0)) / F.greatest("_lanes", F.lit(1.0))
    slow = slow.withColumn("demand", counted).withColumn("demand", F.when(F.col("demand") > 0, F.col("demand")).otherwise(F.col("capacity_vphpl") * F.col("_n") * HOURS))
    q = corridor_flow(slow.where("_n >= 2 and demand > 0"), ("link_id", "period"), m=m)
    lanes = F.greatest(F.col("_lanes"), F.lit(1.0))
    conserved = q.select("link_id", "t_min", F.round("q", 1).alias("q_per_lane"), F.round(F.col("q") * HOURS * lanes, 1).alias("count_conserved"), F.round("theta", 3).alias("theta"), F.round("slack", 2).alias("slack"), F.round("deviation", 3).alias("deviation"))
    return table.join(conserved, ["link_id", "t_min"], "left")


def link_parameters(episodes: DataFrame, params: DataFrame, diagrams: DataFrame) -> DataFrame:
    """One row for each link of diagrams (corridor, link_id, vf, uc, cap): nodes, the period of its longest episode (ties:
    the first by name; none: null) and that period's f_d, n, f_p, s, alpha and beta, with the diagram's speeds."""
    longest = episodes.where("P > 0").groupBy("link_id").agg(F.min_by("period", F.struct(-F.col("P"), "period")).alias("dominant_period"))
    out = nodes(diagrams).join(diagrams.select("corridor", "link_id", "vf", "uc", "cap"), ["corridor", "link_id"]).join(longest, "link_id", "left")
    out = out.join(params.select("link_id", F.col("period").alias("dominant_period"), *PARAMETERS), ["link_id", "dominant_period"], "left")
    alpha, beta = 8 / 15 * F.col("f_p") * F.pow("f_d", "s"), F.col("n") * F.col("s")
    return out.select(
        "corridor", "link_id", "from_node_id", "to_node_id", "dominant_period", *[F.round(p, 4).alias(p) for p in PARAMETERS], F.round(alpha, 4).alias("alpha"), F.round(beta, 4).alias("beta"),
        F.col("vf").alias("free_flow"), F.round("uc", 1).alias("speed_at_capacity"), F.round(F.col("vf") * S.DEMO_CUTOFF, 1).alias("cutoff"), F.round("cap", 0).alias("capacity_vphpl"),
    )


def link_errors(episodes: DataFrame, params: DataFrame) -> DataFrame:
    """Of each link and period with congested days and parameters (link_id, period, f_d, n, f_p, s): observed mean of the
    lowest speeds, the speed predicted at the mean duration, and the error in mph and in per cent."""
    mean = episodes.where("P > 0").groupBy("link_id", "period").agg(F.count(F.lit(1)).alias("n_cong"), F.avg("P").alias("P"), F.avg("v_t2").alias("seen"), F.first("cutoff").alias("cutoff"))
    df = mean.withColumn("P", F.greatest("P", F.lit(1e-3))).join(params.select("link_id", "period", *PARAMETERS), ["link_id", "period"])
    df = df.withColumn("model", predict_vt2("cutoff", "f_p", "P", "s")).withColumn("error", F.col("model") - F.col("seen"))
    return df.select("link_id", "period", "n_cong", F.round("seen", 3).alias("vt2_observed"), F.round("model", 3).alias("vt2_modelled"), F.round("error", 3).alias("vt2_error"), F.round(F.col("error") / F.greatest("seen", F.lit(1.0)) * 100, 2).alias("vt2_error_pct"))


def weekday_gammas(episodes: DataFrame, params: DataFrame, links: DataFrame) -> DataFrame:
    """Of each link, period and day of the week (Monday is 0) with congested days: mean demand over capacity, the duration
    it leads to, lowest and mean speed, and gamma, the queue's shape at the discharge rate, which is the mean demand over
    the mean duration or the capacity if that is less. links: link_id, uc, cap, length."""
    mean = episodes.where("P > 0").groupBy("link_id", "period", F.weekday(F.to_date("date")).alias("weekday")).agg(F.avg("DC").alias("DC"), F.avg("demand").alias("demand"), F.avg("P").alias("P"), F.first("cutoff").alias("cutoff"))
    df = mean.join(params.select("link_id", "period", *PARAMETERS), ["link_id", "period"]).join(links.select("link_id", "uc", "cap", "length"), "link_id")
    df = df.withColumns({"mu": F.least(F.col("demand") / F.greatest("P", F.lit(0.01)), F.col("cap")), "P_est": F.col("f_d") * F.pow("DC", "n"), "alpha": 8 / 15 * F.col("f_p") * F.pow("f_d", "s"), "beta": F.col("n") * F.col("s")})
    vt2, vbar = F.col("cutoff") / (1 + F.col("f_p") * F.pow("P_est", "s")), F.col("cutoff") / (1 + F.col("alpha") * F.pow("DC", "beta"))
    gamma = gamma_of("mu", "length", "uc", "f_p", F.greatest("P_est", F.lit(1e-3)), "s")
    return df.select("link_id", "period", "weekday", F.round("DC", 4).alias("DC"), F.round("P_est", 4).alias("P_est"), F.round(vt2, 4).alias("vt2"), F.round(vbar, 4).alias("vbar"), F.round(gamma, 3).alias("gamma"))
