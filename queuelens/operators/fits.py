"""Fits that need a kernel for each sensor: robust diagrams and resampled medians. Scores of completion on held-out blocks.

Spark groups the rows; a kernel is a few lines of numpy over one sensor's own series.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.operators.completion import complete_speeds
from queuelens.session import cut

#: The bounds of the parameters in order, beside speed by density.
ROBUST_MODELS = {
    "S3": (lambda k, vf, kc, m: vf / (1 + (k / kc) ** m) ** (2 / m), (20, 10, 1), (85, 200, 8)),
    "Greenshields": (lambda k, vf, kj: np.clip(vf * (1 - k / kj), 0, vf), (20, 50), (85, 300)),
    "Newell": (lambda k, vf, kj, a: np.clip(vf * (1 - np.exp(np.minimum(-a * (1 / k - 1 / kj), 700))), 0, vf), (20, 50, 0.01), (85, 300, 5)),
    "Underwood": (lambda k, vf, kc: vf * np.exp(-k / kc), (20, 10), (85, 200)),
    "VanAerde": (lambda k, vf, kc, c1, c2: np.clip(vf * (1 - k / (4 * kc)) / (1 + c1 * k + c2 * k * k), 0, vf), (20, 10, 0, 0), (85, 200, 1, 1)),
    "LCM": (lambda k, vf, kc, b: vf / (1 + (k / kc) ** b), (20, 10, 1), (85, 200, 8)),
}
GRID = np.linspace(1, 200, 400)


#: Padded cells of the fits that take their steps together: their arrays stay in a core's cache.
BLOCK = 32_768


def _step(p: np.ndarray) -> np.ndarray:
    return 1e-6 * np.maximum(1, np.abs(p))


# The curves of ROBUST_MODELS for many fits at once: rows of densities and their logarithms, a column of each parameter. Beside
# speeds (the caller's to change) they give slopes, worked out of the same powers: those of forward differences by _step (to
# its second order), which needs no further powers and has less of their noise. True slopes lead elsewhere where a fit ends at
# its last step.


def _s3(k, log_k, vf, kc, m):
    x = log_k - np.log(kc)
    u = m * x
    b = np.exp(u, out=u) + 1
    rest = np.log(b)
    v = -2 / m * rest
    np.exp(v, out=v)

    def slopes():
        share, h = u / b, _step(kc)
        s, e = share * v, np.expm1(-m * np.log1p(h / kc))
        by_kc = (vf * (m + 2) / m**2 * e * e / h * share - 2 * vf / m * e / h) * s
        h = _step(m)
        z = share * x
        y = 2 / (m * (m + h)) * rest - 2 / (m + h) * (z + h / 2 * z * (x - z))
        return v, by_kc, vf * v * (y + h / 2 * y * y)

    return vf * v, slopes


def _greenshields(k, log_k, vf, kj):
    x = np.maximum(1 - k / kj, 0)
    return vf * x, lambda: (x, vf / (kj * (kj + _step(kj))) * k * (x > 0))


def _newell(k, log_k, vf, kj, a):
    gap = 1 / k - 1 / kj
    e = np.exp(np.minimum(-a * gap, 700))
    x = np.maximum(1 - e, 0)

    def slopes():
        s = vf * e * (x > 0)
        return x, a / (kj * (kj + _step(kj))) * s, (1 - _step(a) / 2 * gap) * gap * s

    return vf * x, slopes


def _underwood(k, log_k, vf, kc):
    e = k / -kc
    np.exp(e, out=e)

    def slopes():
        h = _step(kc)
        z = 1 / (kc * (kc + h))
        return e, (vf * z + vf * z * z * h / 2 * k) * k * e

    return vf * e, slopes


def _van_aerde(k, log_k, vf, kc, c1, c2):
    d = 1 + (c1 + c2 * k) * k
    x = np.maximum(1 - k / (4 * kc), 0) / d

    def slopes():
        s = -vf * x * k
        return x, vf / (4 * kc * (kc + _step(kc))) * k * (x > 0) / d, s / (d + _step(c1) * k), s * k / (d + _step(c2) * k * k)

    return vf * x, slopes


def _lcm(k, log_k, vf, kc, b):
    x = log_k - np.log(kc)
    w = b * x
    np.divide(1, np.add(np.exp(w, out=w), 1, out=w), out=w)

    def slopes():
        g, h = 1 - w, _step(kc)
        s, f = g * w, -np.expm1(-b * np.log1p(h / kc))
        return w, vf * f / h * (1 + f * g) * s, (vf * _step(b) * x * (g - 0.5) - vf) * x * s

    return vf * w, slopes


CURVES = {"S3": _s3, "Greenshields": _greenshields, "Newell": _newell, "Underwood": _underwood, "VanAerde": _van_aerde, "LCM": _lcm}


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses; of matrices that have none in doubles, those that least squares use."""
    try:
        out = np.linalg.inv(a)
        near = ~((a * a).sum(axis=(1, 2)) * (out * out).sum(axis=(1, 2)) < 1e26)
    except np.linalg.LinAlgError:
        out, near = np.empty_like(a), np.ones(len(a), bool)
    if near.any():
        out[near] = np.linalg.pinv(a[near], rcond=a.shape[1] * np.finfo(float).eps)
    return out


def _together(sets: list[tuple[np.ndarray, np.ndarray]], model: str, eps: float, steps: int) -> np.ndarray:
    """Parameters of the fits to some sets of rows. All try their next step at once; each has its own damping, and leaves
    when it is done."""
    curve, (_, lo, hi) = CURVES[model], ROBUST_MODELS[model]
    lo, hi = np.array(lo, float), np.array(hi, float)
    n, shape = len(lo), (len(sets), max(len(k) for k, _ in sets))
    ks, pull, seen = np.ones(shape), np.zeros(shape), np.zeros(shape)  # cells after a set's end pull nowhere
    for i, (k, q) in enumerate(sets):
        ks[i, : len(k)] = pull[i, : len(k)] = k
        seen[i, : len(k)] = q / k
    log_k, pull2 = np.minimum(np.log(ks), 80), pull * pull  # so that no power overflows
    found = np.tile((lo + hi) / 2, (shape[0], 1))
    left, new = np.arange(shape[0]), found.copy()
    p, loss, damp = new, np.full(shape[0], np.inf), np.full(shape[0], 3e-2)
    taken, tries = np.full(shape[0], -1), np.zeros(shape[0], int)
    a, g = np.zeros((shape[0], n, n)), np.zeros((shape[0], n))
    while True:
        v, slopes = curve(ks, log_k, *(new[:, i, None] for i in range(n)))
        off = np.subtract(v, seen, out=v)
        size = off * pull
        size = np.add(np.abs(size, out=size), 1e-300, out=size)
        inner = np.minimum(size, eps)
        new_loss = np.vecdot(inner, size) - np.vecdot(inner, inner) / 2
        better = (new_loss < loss) | (taken < 0)
        if better.any():
            w = np.multiply(np.divide(inner, size, out=size), pull2, out=size)
            cells = (*slopes(), off)
            for i in range(n):
                weighted = np.multiply(cells[i], w, out=inner)
                g[better, i] = np.vecdot(weighted, off)[better]
                for j in range(i + 1):
                    a[better, i, j] = a[better, j, i] = np.vecdot(weighted, cells[j])[better]
        still = better & (taken >= 0) & (np.abs(new - p).max(axis=1) <= 1e-7)
        p, loss, damp = np.where(better[:, None], new, p), np.where(better, new_loss, loss), np.where(better, damp / 3, damp * 4)
        taken, tries = taken + better, np.where(better, 0, tries + 1)
        done = still | (taken >= steps) | (tries >= 12)
        if done.any():
            found[left[done]] = p[done]
            left, p, loss, damp, taken, tries, a, g, ks, pull, pull2, seen, log_k = (c[~done] for c in (left, p, loss, damp, taken, tries, a, g, ks, pull, pull2, seen, log_k))
            if not len(left):
                return found
        damped = a + damp[:, None, None] * (np.eye(n) * np.maximum(a, 1e-9))
        sound = np.isfinite(damped).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
        inverse = _inverse(np.where(sound[:, None, None], damped, np.eye(n)))
        new = np.clip(p - (inverse @ np.where(sound[:, None], g, 0)[:, :, None])[:, :, 0], lo, hi)


def huber_fits(sets: list[tuple[np.ndarray, np.ndarray]], model: str, eps: float = 1.35, steps: int = 60) -> list[tuple[np.ndarray, float, float] | None]:
    """Parameters, R2 and RMSE of flow for each set of densities and flows: projected Levenberg-Marquardt with Huber weights,
    from the middle of the bounds. Sets of like length take their steps together."""
    usable = [np.isfinite(k) & np.isfinite(q) & (k > 0) for k, q in sets]
    sets = [(k[ok], q[ok]) for (k, q), ok in zip(sets, usable, strict=True)]
    out, speed = [None] * len(sets), ROBUST_MODELS[model][0]
    queue = sorted((i for i, (k, _) in enumerate(sets) if len(k) >= 10), key=lambda i: -len(sets[i][0]))
    while queue:
        some = queue[: max(1, BLOCK // len(sets[queue[0]][0]))]
        queue = queue[len(some) :]
        for i, p in zip(some, _together([sets[j] for j in some], model, eps, steps), strict=True):
            k, q = sets[i]
            r, total = k * speed(k, *p) - q, ((q - q.mean()) ** 2).sum()
            out[i] = (p, float(1 - (r @ r) / total) if total > 0 else float("nan"), float(np.sqrt(np.mean(r * r))))
    return out


def huber_fit(k: np.ndarray, q: np.ndarray, model: str, eps: float = 1.35, steps: int = 60) -> tuple[np.ndarray, float, float] | None:
    """``huber_fits`` of one set."""
    return huber_fits([(k, q)], model, eps, steps)[0]


def _best(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple | None]:
    fits = {m: huber_fits(sets, m) for m in ROBUST_MODELS}
    each = [[(f[i][1], m, f[i]) for m, f in fits.items() if f[i] is not None and np.isfinite(f[i][1])] for i in range(len(sets))]
    return [max(e, key=lambda x: (x[0], x[1])) if e else None for e in each]


FD_SCHEMA = "sensor_uid string, regime string, n long, model string, params array<double>, r2 double, rmse double, capacity_vphpl double, k_c double, v_f_mph double, month int"


def regimes(v: np.ndarray, k: np.ndarray, v_c: float, k_c: float, v_f: float) -> dict[str, np.ndarray]:
    """Rows of free flow, near capacity and of congestion, by a diagram's critical speed and density."""
    return {"free_flow": (v >= 0.95 * v_f) & (k < 0.6 * k_c), "near_capacity": (k >= 0.6 * k_c) & (k <= 1.2 * k_c), "congested": (k > 1.2 * k_c) | (v < v_c)}


def _critical(model: str, p: np.ndarray) -> tuple[float, float, float]:
    """Capacity, its density and free-flow speed."""
    flow = GRID * ROBUST_MODELS[model][0](GRID, *p)
    at = int(np.argmax(flow))
    return float(flow[at]), float(GRID[at]), float(p[0])


def _whole(batches: Iterator[pd.DataFrame], together: int) -> Iterator[list[tuple[tuple, np.ndarray]]]:
    """Lists of (sensor and month, its speeds, densities and flows) out of sorted rows: as many sensors' months as have
    ``together`` rows, the last one with all of its own. Each one's rows are put in order of flow, density and speed."""

    def ordered(parts: list[np.ndarray]) -> np.ndarray:
        columns = np.concatenate(parts).T
        return np.ascontiguousarray(columns[:, np.lexsort(columns)])

    found, n = [], 0
    for pdf in batches:
        keys = list(zip(pdf.sensor_uid, pdf.month, strict=True))
        values = pdf[["speed_mph", "density_vpm", "flow_vph"]].to_numpy(float)
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        for i, j in pairwise(starts):
            if found and found[-1][0] == keys[i]:
                found[-1][1].append(values[i:j])
                n += j - i
                continue
            if n >= together:
                yield [(key, ordered(parts)) for key, parts in found]
                found, n = [], 0
            found.append((keys[i], [values[i:j]]))
            n += j - i
    if found:
        yield [(key, ordered(parts)) for key, parts in found]


def fit_diagrams(states: DataFrame, least: int = 10, months: int = 1, together: int = 200_000) -> DataFrame:
    """The model of six with the highest R2 for each sensor and month (or ``months`` of them), over all rows and over those
    of each regime of that diagram. A task sees the rows of some sensors' months at a time (``together``, or one sensor's
    month), however long their history. Their order is fixed, as a fit that ends at its last step depends on it."""
    month = F.floor((F.year("datetime") * 12 + F.month("datetime") - 1) / months).cast("int") if "datetime" in states.columns else F.lit(0)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _whole(batches, together):
            full = [(key, "full", v, k, q) for key, (v, k, q) in groups if len(v) >= least]
            rows = []

            def add(sets: list[tuple]) -> list[tuple | None]:
                found = []
                for (key, regime, v, _, _), best in zip(sets, _best([(k, q) for *_, k, q in sets]), strict=True):
                    found.append(best and _critical(best[1], best[2][0]))
                    if best is not None:
                        _, model, (p, r2, rmse) = best
                        rows.append((key[0], regime, len(v), model, p.tolist(), r2, rmse, *found[-1], int(key[1])))  # noqa: B023
                return found

            parts = []
            for (key, _, v, k, q), critical in zip(full, add(full), strict=True):
                if critical is not None:
                    capacity, k_c, v_f = critical
                    parts += [(key, regime, v[m], k[m], q[m]) for regime, m in regimes(v, k, capacity / k_c, k_c, v_f).items() if m.sum() >= least]
            add(parts)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FD_SCHEMA.split(", ")])

    rows = states.select("sensor_uid", F.coalesce(month, F.lit(0)).alias("month"), "density_vpm", "flow_vph", "speed_mph")
    # Without a number of partitions, small ones are merged: more sensors take their steps together.
    return rows.repartition("sensor_uid", "month").sortWithinPartitions("sensor_uid", "month").mapInPandas(fit, FD_SCHEMA)


def bootstrap_diagrams(states: DataFrame, model: str = "S3", n_boot: int = 200, seed: int = 42) -> DataFrame:
    """sensor_uid, parameter (p0, p1, ..., capacity), p5, p50, p95 of a model fitted to resampled rows; sensors with fewer
    than 20 usable rows have none."""

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        k, q = pdf.density_vpm.to_numpy(float), pdf.flow_vph.to_numpy(float)
        ok = np.isfinite(k) & np.isfinite(q) & (k > 0) & (q >= 0)
        k, q, rng, found = k[ok], q[ok], np.random.default_rng(seed), []
        for _ in range(n_boot if len(k) >= 20 else 0):
            i = rng.integers(0, len(k), len(k))
            if (fit := huber_fit(k[i], q[i], model)) is not None:
                found.append([*fit[0], float((GRID * ROBUST_MODELS[model][0](GRID, *fit[0])).max())])
        names = [*(f"p{i}" for i in range(len(ROBUST_MODELS[model][1]))), "capacity"]
        rows = [(pdf.sensor_uid.iloc[0], n, *map(float, np.percentile(c, [5, 50, 95]))) for n, c in zip(names, np.array(found).T, strict=True)] if len(found) >= 10 else []
        return pd.DataFrame(rows, columns=["sensor_uid", "parameter", "p5", "p50", "p95"])

    return states.select("sensor_uid", "flow_vph", "density_vpm").groupBy("sensor_uid").applyInPandas(resample, "sensor_uid string, parameter string, p5 double, p50 double, p95 double")


def borrowed_diagrams(states: DataFrame, capacity: float = 2000.0, v_f: float = 65.0, v_c: float = 50.0, least: int = 20) -> DataFrame:
    """Diagrams of sensors without flow: free-flow speed by the 95th percentile, all else borrowed."""
    n = F.count("speed_mph")
    return states.groupBy("sensor_uid").agg(F.when(n >= least, F.percentile("speed_mph", F.lit(0.95))).otherwise(v_f).alias("v_f_mph"), n.alias("n")).withColumns({"v_c_mph": F.lit(v_c), "capacity_vphpl": F.lit(capacity), "model": F.lit("speed_only_borrow")})


def bootstrap_medians(values: DataFrame, keys: tuple[str, ...], value: str, priors: dict[str, float] | None = None, n_boot: int = 500, seed: int = 42, k0: float = 5.0) -> DataFrame:
    """Median, 5th and 95th percentile of resampled medians, and the median drawn to ``prior`` by n / (n + k0), for each
    group; ``priors`` is by the last key."""
    priors = priors or {}
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, median double, p5 double, p95 double, alpha double, shrunk double"

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].to_numpy(float))
        v = v[np.isfinite(v)]
        n, prior = len(v), priors.get(key[-1], np.nan)
        mid = float(np.median(v)) if n else np.nan
        lo = hi = mid
        if n >= 3:
            rng = np.random.default_rng(seed)
            boot = np.median(v[rng.integers(0, n, (n_boot, n))], axis=1)
            lo, hi = np.percentile(boot, [5, 95])
        alpha = n / (n + k0)
        shrunk = alpha * mid + (1 - alpha) * prior if n and np.isfinite(prior) else mid if n else prior
        return pd.DataFrame([(*key, n, mid, lo, hi, alpha, shrunk)], columns=[*keys, "n", "median", "p5", "p95", "alpha", "shrunk"])

    return values.select(*keys, value).groupBy(*keys).applyInPandas(resample, schema)


def held_out(states: DataFrame, share: float = 0.3, seed: int = 7, hours: int | None = 2) -> DataFrame:
    """states with ``truth`` and, in speed_mph, nothing where a sensor's block of hours (or, without hours, a single row) is
    held out. The choice follows from hashes, so it is the same however rows are partitioned."""
    at = F.to_date("datetime").cast("string") if hours else F.col("datetime").cast("string")
    block = F.floor(F.hour("datetime") / hours).cast("string") if hours else F.lit("")
    chance = F.pmod(F.xxhash64("sensor_uid", at, block, F.lit(seed)), F.lit(1_000_000)) / 1e6
    hold = (chance < share) & F.col("speed_mph").isNotNull()
    return states.withColumns({"truth": F.col("speed_mph"), "held": hold}).withColumn("speed_mph", F.when(~hold, F.col("speed_mph")))


def persisted(held: DataFrame, value: str = "speed_mph") -> DataFrame:
    """Adds guess: the line between the known values before and after within a sensor's day, held at its ends."""
    tied = [c for c in ("corridor", "road_order") if c in held.columns]  # rows of one time never stand as they arrive
    day = W.partitionBy("sensor_uid", F.to_date("datetime")).orderBy("datetime", *tied)
    t = F.unix_timestamp(F.col("datetime").cast("timestamp"))
    known = F.when(F.col(value).isNotNull(), F.struct(t.alias("t"), F.col(value).alias("v")))
    df = held.withColumns({"_b": F.last(known, True).over(day.rowsBetween(W.unboundedPreceding, 0)), "_a": F.first(known, True).over(day.rowsBetween(0, W.unboundedFollowing)), "_t": t})
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_t") - F.col("_b.t")) / F.when(F.col("_a.t") != F.col("_b.t"), F.col("_a.t") - F.col("_b.t"))
    return df.withColumn("guess", F.coalesce(line, "_a.v", "_b.v")).drop("_a", "_b", "_t")


def time_of_day(held: DataFrame, minutes: int = 5) -> DataFrame:
    """Adds guess: the sensor's mean of the known values at the time of day."""
    slot = F.floor((F.hour("datetime") * 60 + F.minute("datetime")) / minutes)
    return held.withColumn("guess", F.avg("speed_mph").over(W.partitionBy("sensor_uid", slot)))


def engine_scores(guessed: DataFrame, engine: str, congested_below: float = 45.0) -> DataFrame:
    """One row: mean absolute and root mean square error of held-out rows, and of those in congestion."""
    err = F.when(F.col("held") & F.col("guess").isNotNull(), F.abs(F.col("guess") - F.col("truth")))
    low = F.when(F.col("truth") < congested_below, err)
    return guessed.agg(F.lit(engine).alias("engine"), F.count(err).alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count(low).alias("n_congested"), F.avg(low).alias("mae_congested"))


def engine_arena(states: DataFrame, share: float = 0.3, minutes: int = 60, methods: tuple[str, ...] = ("matrix", "tensor", "rpca"), rank: int = 3) -> DataFrame:
    """Scores of persistence, the time-of-day profile and each completion method on the same held-out blocks of means."""
    slot = F.window("datetime", f"{minutes} minutes")["start"]
    cells = states.groupBy("corridor", "sensor_uid", slot.alias("datetime")).agg(F.avg("speed_mph").alias("speed_mph"))
    held = cut(held_out(cells, share))
    out = engine_scores(persisted(held), "persistence").unionByName(engine_scores(time_of_day(held, minutes), "tod_profile"))
    keys = ["corridor", "sensor_uid", "date", "slot"]
    marked = held.withColumns({"date": F.date_format("datetime", "yyyy-MM-dd"), "slot": F.expr(f"(hour(datetime) * 60 + minute(datetime)) div {minutes}").cast("int")})
    for m in methods:
        guess = complete_speeds(held, m, minutes, rank=rank).select(*keys, F.col("completed").alias("guess"))
        out = out.unionByName(engine_scores(marked.join(guess, keys), m))
    return out


def conserve_volume(rows: DataFrame, cap: str = "capacity_vphpl") -> DataFrame:
    """Adds flow_conserved: clip(flow0 + x, 0, cap) for each link, with the x that makes the sum equal to the link's
    total. Needs link_id, flow0, total and the capacity."""

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        q, top, total = pdf.flow0.to_numpy(float), pdf[cap].to_numpy(float), float(pdf.total.iloc[0])
        lo, hi = -float(q.max()) - 1, float(top.max()) + 1
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(q + mid, 0, top).sum() < total else (lo, mid)
        return pdf.assign(flow_conserved=np.clip(q + (lo + hi) / 2, 0, top))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", flow_conserved double"
    return rows.groupBy("link_id").applyInPandas(shift, schema)
