"""Scalar functions of speed, flow and density as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from queuelens import schemas as S


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def period_of(ts) -> Column:
    """AM, MD, PM or NT by the hour."""
    h = F.hour(col(ts))
    out = F.lit("NT")
    for name, (a, b) in S.PERIODS.items():
        if a < b:
            out = F.when((h >= a) & (h < b), name).otherwise(out)
    return out


def in_slice(hour, period: str) -> Column:
    a, b = S.SLICES[period]
    h = col(hour)
    return (h >= a) & (h < b) if a <= b else (h >= a) | (h < b)


def regime(p_min, v_min, v_c, z=0.0) -> Column:
    """uncongested, event, severe, recurring or mild, in this order of rules."""
    p, v, c = col(p_min), col(v_min), col(v_c)
    return (
        F.when(p.isNull() | v.isNull() | (p < S.UNCONGESTED_BELOW_MIN) | (v >= c), "uncongested")
        .when(F.abs(col(z)) > S.EVENT_Z, "event")
        .when((p >= S.SEVERE_FROM_MIN) & (v < S.SEVERE_SPEED_RATIO * c), "severe")
        .when(p >= S.RECURRING_FROM_MIN, "recurring")
        .otherwise("mild")
    )


def reliability(n) -> Column:
    x, out = col(n), F.lit("not_reliable")
    for name, least in reversed(S.RELIABLE_FROM.items()):
        out = F.when(x >= least, name).otherwise(out)
    return out


def s3_flow(speed, v_f, k_c, m, cap=None) -> Column:
    """Flow of the S-shaped three-parameter diagram at a speed; null for negative or missing speeds."""
    v, vf = col(speed), col(v_f)
    s = F.least(v, 0.99 * vf)
    r = F.greatest(vf / F.greatest(F.lit(1.0), s), F.lit(1.00001))
    q = s * col(k_c) * F.pow(F.greatest(F.pow(r, col(m) / 2) - 1, F.lit(1e-8)), 1 / col(m))
    top = col(cap) if cap is not None else s3_capacity(v_f, k_c, m)
    return F.when(v >= 0, F.least(q, top))


def s3_capacity(v_f, k_c, m) -> Column:
    return col(k_c) * col(v_f) / F.pow(F.lit(2.0), 2 / col(m))


def density(flow, speed) -> Column:
    return F.when(col(speed) > 1, col(flow) / col(speed))


def clip_to_default(name: str, value, default=None) -> Column:
    """The value where it lies in its feasible range, else the default: not a clamp."""
    std, lo, hi = S.FEASIBLE[name]
    x = col(value)
    return F.when((x >= lo) & (x <= hi), x).otherwise(F.lit(std) if default is None else col(default))


def shape(name: str, tau) -> Column:
    """Speed shapes over a queue, 0 at its worst (tau 0) and 1 at its ends."""
    t = col(tau)
    phi = {"quartic_symmetric": 1 - F.pow(1 - t * t, 2), "quadratic_symmetric": t * t, "quadratic_early": F.when(t < 0, t * t).otherwise(F.pow(t, 1.5))}[name]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), phi))


def geh(model, observed) -> Column:
    m, o = col(model), col(observed)
    return F.sqrt(2 * (m - o) * (m - o) / F.greatest(m + o, F.lit(1e-6)))


def smoothstep(x) -> Column:
    t = col(x)
    return t * t * (3 - 2 * t)


def gamma_of(mu, length, u_c, f_p, p, s) -> Column:
    return 64 * col(mu) * (col(length) / col(u_c)) * col(f_p) * F.pow(col(p), col(s) - 4)


def predict_vt2(cutoff, f_p, p, s) -> Column:
    c = col(cutoff)
    return F.least(F.greatest(c / (1 + col(f_p) * F.pow(col(p), col(s))), F.lit(1.0)), c)
