"""Huber regressions on several features, of many groups at once: every round is one aggregation over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.linear import dot, solved
from queuelens.session import cut

#: Residuals, in units of the scale, from which on they count linearly; weight of the squared slopes.
EPSILON, ALPHA = 1.35, 1e-4


def huber_regressions(rows: DataFrame, features: tuple[str, ...], target: str, keys: tuple[str, ...], least: int = 10, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """keys, n, coefs, intercept, scale, r2 of each group: the least sum of scale + H(residual / scale) * scale, where H is
    quadratic up to EPSILON and linear beyond, plus ALPHA times the squared slopes. Rows with a missing value don't count;
    groups of fewer than ``least`` rows have nulls.

    Where the set of linear residuals is known, coefficients and scale have closed forms in sums; a round takes these sums
    for the set that the last round's values give, for all groups in one pass, and solves each group's equations. Parameters
    are a small table beside the rows, written once a round; nothing but the largest change comes to the driver. A group whose
    equations end up singular while its values still change has diverged and has no coefficients.
    """
    size, names, keys = len(features) + 1, list(keys), [f"_key{i}" for i in range(len(keys))]
    known = F.lit(True)
    for c in (*features, target):
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    x = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
    df = cut(rows.where(known).select(*[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], x.alias("x"), F.col(target).cast("double").alias("y")))
    number = lambda i, j: F.sum(F.col("w") * F.col("x")[i] * F.col("x")[j])
    ridge = lambda i, j, s: s if i == j and i < size - 1 else F.lit(0.0)
    params = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("scale"))
    start = F.array(*[F.lit(0.0)] * (size - 1), F.col("mean"))
    params = cut(params.where(F.col("n") >= least).select(*keys, "n", start.alias("b"), F.greatest("scale", F.lit(1e-12)).alias("scale"), F.lit(1.0).alias("change"), F.lit(True).alias("fine")))
    for _ in range(rounds):
        r = F.col("y") - dot(F.col("x"), F.col("b"))
        inside = F.abs(r) <= EPSILON * F.col("scale")
        met = df.join(params.select(*keys, "b", "scale"), keys).withColumns({"r": r, "w": inside.cast("double"), "sign": F.when(inside, 0.0).otherwise(F.signum(r))})
        sums = met.groupBy(*keys).agg(
            F.array(*[F.array(*[number(i, j) for j in range(size)]) for i in range(size)]).alias("a"), F.array(*[F.sum(F.col("w") * F.col("x")[i] * F.col("y")) for i in range(size)]).alias("g"), F.array(*[F.sum(F.col("sign") * F.col("x")[i]) for i in range(size)]).alias("far"),
            F.sum(1 - F.col("w")).alias("out"), F.sum(F.col("w") * F.col("r") * F.col("r")).alias("rss"),
        )
        at = params.join(sums, keys)
        scale = F.greatest(F.sqrt(F.col("rss") / F.greatest(F.col("n") - F.col("out") * EPSILON**2, F.lit(1e-9))), F.lit(1e-12))
        at = at.withColumn("s", F.when(F.col("rss") > 0, scale).otherwise(F.col("scale") / 2))
        lhs = F.array(*[F.array(*[F.col("a")[i][j] + ridge(i, j, ALPHA * F.col("s")) for j in range(size)]) for i in range(size)])
        rhs = F.zip_with("g", "far", lambda g, s: g + EPSILON * F.col("s") * s)
        at = at.withColumn("new", solved(lhs, rhs, size))
        fine = F.coalesce(F.forall("new", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
        new = F.when(fine, F.col("new")).otherwise(F.col("b"))
        move = F.aggregate(F.zip_with(new, "b", lambda p, q: F.abs(p - q) / (1 + F.abs(q))), F.lit(0.0), lambda m, v: F.greatest(m, v)) + F.abs(F.col("s") - F.col("scale")) / (1 + F.col("scale"))
        params = cut(at.select(*keys, "n", new.alias("b"), F.col("s").alias("scale"), move.alias("change"), fine.alias("fine")))
        if (params.agg(F.max("change")).first()[0] or 0.0) < tolerance:
            break
    params = params.withColumn("b", F.when(F.col("fine") | (F.col("change") < tolerance), F.col("b")))
    rest = F.col("y") - dot(F.col("x"), F.col("b"))
    fit = df.join(params.select(*keys, "b", "scale"), keys, "left").withColumn("r", rest)
    out = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b"), F.first("scale").alias("scale"), F.sum(F.col("r") * F.col("r")).alias("rss"), (F.var_pop("y") * F.count(F.lit(1))).alias("tss"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, keys, strict=True)], "n", F.slice("b", 1, size - 1).alias("coefs"), F.col("b")[size - 1].alias("intercept"), "scale", F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).alias("r2"))


def predicted_vs_observed(episodes: DataFrame, capacity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """mode, n, coefs (of D/C and P in hours), intercept, scale, r2 of discharge rates: valid_only has the valid episodes,
    all_days all of them, a missing rate as zero. With ``keys`` for each of these groups; both modes are fitted together.

    episodes: discharge.mu_per_episode(); capacity: sensor_uid, capacity_vphpl. No capacity, or none above zero, no row.
    """
    df = episodes.join(capacity.select("sensor_uid", "capacity_vphpl"), "sensor_uid", "left")
    doc = F.col("demand_veh") / F.nullif(F.col("capacity_vphpl"), F.lit(0.0))
    df = df.select(*keys, "is_valid_for_mu", doc.alias("D_over_C"), (F.col("P_min") / 60).alias("P_hours"), F.col("mu_obs_vphpl").alias("mu"))
    valid = df.where("is_valid_for_mu").withColumn("mode", F.lit("valid_only"))
    every = df.withColumns({"mu": F.coalesce("mu", F.lit(0.0)), "mode": F.lit("all_days")})
    return huber_regressions(valid.unionByName(every), ("D_over_C", "P_hours"), "mu", ("mode", *keys))


def r2_gap(fits: DataFrame) -> DataFrame:
    """One row: how much better the rates of valid episodes are explained than those of all days."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("r2")))
    return fits.agg((of("valid_only") - of("all_days")).alias("mu_r2_gap"))
