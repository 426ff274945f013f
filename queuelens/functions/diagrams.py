"""Fundamental diagrams: speed by density (or density by speed) as column expressions, with their fit objectives.

Each model is one formula over named parameters; a fit's objective is a sum over rows, so evaluating a set of
candidate parameters is one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.traffic import col

Model = Callable[..., Column]


def _van_aerde(v, vf, vc, kj, qm):
    c = vf / (kj * vc * vc)
    c1, c2 = c * (2 * vc - vf), c * (vf - vc) ** 2
    return 1 / (c1 + c2 / (vf - v) + (1 / qm - c1 / vc - c2 / (vc * (vf - vc))) * v)


#: Parameters, and speed as a function of density.
SPEED_MODELS: dict[str, tuple[tuple[str, ...], Model]] = {
    "S3": (("vf", "kc", "m"), lambda k, vf, kc, m: vf / F.pow(1 + F.pow(k / kc, F.lit(m)), F.lit(2 / m))),
    "Greenshields": (("vf", "kj"), lambda k, vf, kj: vf * (1 - k / kj)),
    "Greenberg": (("vc", "kj"), lambda k, vc, kj: vc * F.log(kj / k)),
    "Underwood": (("vf", "kc"), lambda k, vf, kc: vf * F.exp(-k / kc)),
    "NF": (("vf", "lam", "kj"), lambda k, vf, lam, kj: vf * (1 - F.exp(-(lam / vf) * (1 / k - 1 / kj)))),
    "GHR_M1": (("vf", "kc"), lambda k, vf, kc: vf * F.exp(-0.5 * (k / kc) * (k / kc))),
    "GHR_M2": (("vf", "kj", "m"), lambda k, vf, kj, m: vf * (1 - F.pow(k / kj, F.lit(m)))),
    "GHR_M3": (("vf", "kj", "m"), lambda k, vf, kj, m: vf * F.signum(1 - k / kj) * F.pow(F.abs(1 - k / kj), F.lit(m))),
    "KK": (("vf", "kc", "c1", "c2", "c3"), lambda k, vf, kc, c1, c2, c3: vf * (1 / (1 + F.exp((k / kc - c1) / c2)) - c3)),
    "Jayakrishnan": (("vj", "vf", "kj", "m"), lambda k, vj, vf, kj, m: vj + (vf - vj) * F.signum(1 - k / kj) * F.pow(F.abs(1 - k / kj), F.lit(m))),
    "MacNicholas": (("vf", "kj", "m", "c"), lambda k, vf, kj, m, c: vf * (kj**m - F.pow(k, F.lit(m))) / (kj**m + c * F.pow(k, F.lit(m)))),
    "Wang_3PL": (("vf", "kc", "theta"), lambda k, vf, kc, theta: vf / (1 + F.exp((k - kc) / theta))),
    "Wang_4PL": (("vf", "vb", "kc", "theta"), lambda k, vf, vb, kc, theta: vb + (vf - vb) / (1 + F.exp((k - kc) / theta))),
    "Wang_5PL": (("vf", "vb", "kc", "theta1", "theta2"), lambda k, vf, vb, kc, theta1, theta2: vb + (vf - vb) / F.pow(1 + F.exp((k - kc) / theta1), F.lit(theta2))),
}
#: Parameters, and density as a function of speed.
DENSITY_MODELS: dict[str, tuple[tuple[str, ...], Model]] = {
    "Van_Aerde": (("vf", "vc", "kj", "qm"), _van_aerde),
    "Ni": (("gamma", "tau", "l", "vf"), lambda v, gamma, tau, l, vf: 1 / ((gamma * v * v + tau * v + l) * (1 - F.log(1 - v / vf)))),  # noqa: E741
}


def predicted(model: str, x, params: dict[str, float]) -> Column:
    """The model's speed at a density, or its density at a speed for Van_Aerde and Ni."""
    names, f = {**SPEED_MODELS, **DENSITY_MODELS}[model]
    return f(col(x), **{n: float(params[n]) for n in names})


def objectives(rows: DataFrame, candidates: list[tuple[str, dict[str, float]]], joint: bool = True) -> DataFrame:
    """(model, candidate, n, sse, joint_sse) of rows (speed, flow, density): plain squared errors, and with the flows'
    weighted by var(v) / var(q). One pass over the rows for all candidates."""
    out = []
    weight = rows.agg((F.var_pop("speed") / F.var_pop("flow")).alias("w"))
    rows = rows.crossJoin(F.broadcast(weight)) if joint else rows.withColumn("w", F.lit(0.0))  # one row
    for i, (model, params) in enumerate(candidates):
        if model in DENSITY_MODELS:
            hat = predicted(model, "speed", params)
            error, flow_hat = hat - F.col("density"), hat * F.col("speed")
        else:
            hat = predicted(model, "density", params)
            error, flow_hat = hat - F.col("speed"), hat * F.col("density")
        dq = flow_hat - F.col("flow")
        out.append(F.struct(F.lit(model).alias("model"), F.lit(i).alias("candidate"), F.count(error).alias("n"), F.sum(error * error).alias("sse"), F.sum(error * error + F.col("w") * dq * dq).alias("joint_sse")))
    return rows.agg(F.array(*out).alias("all")).select(F.inline("all"))
