"""Bounded fits of the 16 fundamental diagrams: damped Gauss-Newton whose normal equations are sums over rows, for all
models and all groups in one pass a round."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.diagrams import DENSITY_MODELS
from queuelens.session import cut

#: Where each parameter starts, its least and its largest value (None: unbounded).
BOUNDS: dict[str, dict[str, tuple[float, float, float | None]]] = {
    "S3": {"vf": (70, 60, 80), "kc": (35, 20, 60), "m": (3.6, 1, 10)},
    "Greenshields": {"vf": (70, 60, 80), "kj": (140, 120, 200)},
    "Greenberg": {"vc": (35, 20, 70), "kj": (140, 140, 180)},
    "Underwood": {"vf": (70, 60, 80), "kc": (35, 20, 60)},
    "NF": {"vf": (70, 60, 80), "kj": (140, 140, 200), "lam": (1, 0, 5000)},
    "GHR_M1": {"vf": (70, 60, 80), "kc": (35, 20, 60)},
    "GHR_M2": {"vf": (70, 60, 80), "kj": (140, 133, 200), "m": (2, 0, 10)},
    "GHR_M3": {"vf": (70, 60, 80), "kj": (140, 133, 200), "m": (2, 0.0001, 10)},
    "KK": {"vf": (70, 60, 80), "kc": (35, 20, 60), "c1": (0.25, 0, None), "c2": (0.06, 0, None), "c3": (3.72e-06, 0, None)},
    "Jayakrishnan": {"vf": (70, 60, 80), "vj": (3, 0, 10), "kj": (140, 133, 200), "m": (2, 0, None)},
    "Van_Aerde": {"vf": (70, 60, 80), "vc": (35, 20, 70), "kj": (130, 133, 200), "qm": (1700, 1400, 2000)},
    "MacNicholas": {"vf": (70, 60, 80), "kj": (140, 140, 200), "m": (3, 1, 10), "c": (2, 0, None)},
    "Wang_3PL": {"vf": (70, 60, 80), "kc": (35, 20, 60), "theta": (1, 1, 20)},
    "Wang_4PL": {"vf": (70, 60, 80), "vb": (5, 0, 10), "kc": (35, 20, 60), "theta": (1, 1, 20)},
    "Wang_5PL": {"vf": (70, 60, 80), "vb": (5, 0, 10), "kc": (35, 20, 60), "theta1": (1, 1, 20), "theta2": (1, 0, 1)},
    "Ni": {"vf": (70, 60, 80), "gamma": (-3.48e-6, -1, 0), "tau": (1 / 3600, 0, 3), "l": (7.5e-3, 0, 10)},
}
#: Numbers a model has at most; what an unbounded parameter may reach; the least value of one that divides.
SIZE, UNBOUNDED, LEAST = 5, 1e6, 1e-6
DIVISORS = {"c2"}
#: A start so flat that a fit can't leave it: NF's is taken from where it rises.
STARTS = {("NF", "lam"): 2000.0}
#: Least share of the free-flow bound that a speed must stay under where density is modelled by speed.
UNDER_FREE = 0.98
PENALTY = 1e4
#: Rows of a group that are summed at once, about.
BLOCK = 4096


def _table() -> list[tuple]:
    rows = []
    for model, params in BOUNDS.items():
        at = [(STARTS.get((model, k), x), max(lo, LEAST) if k in DIVISORS else lo, UNBOUNDED if hi is None else hi) for k, (x, lo, hi) in params.items()]
        at = [(float(min(max(x, lo), hi)), float(lo), float(hi)) for x, lo, hi in at] + [(0.0, 0.0, 0.0)] * (SIZE - len(at))
        rows.append((model, *(list(c) for c in zip(*at, strict=True))))
    return rows


def _van_aerde(v, vf, vc, kj, qm):
    c = vf / (kj * vc * vc)
    c1, c2 = c * (2 * vc - vf), c * (vf - vc) ** 2
    return 1 / (c1 + c2 / (vf - v) + (1 / qm - c1 / vc - c2 / (vc * (vf - vc))) * v)


#: The formulas of functions.diagrams over arrays, parameters in the order of BOUNDS.
CURVES: dict[str, Callable[..., np.ndarray]] = {
    "S3": lambda k, vf, kc, m: vf / (1 + (k / kc) ** m) ** (2 / m),
    "Greenshields": lambda k, vf, kj: vf * (1 - k / kj),
    "Greenberg": lambda k, vc, kj: vc * np.log(kj / k),
    "Underwood": lambda k, vf, kc: vf * np.exp(-k / kc),
    "NF": lambda k, vf, kj, lam: vf * (1 - np.exp(-(lam / vf) * (1 / k - 1 / kj))),
    "GHR_M1": lambda k, vf, kc: vf * np.exp(-0.5 * (k / kc) ** 2),
    "GHR_M2": lambda k, vf, kj, m: vf * (1 - (k / kj) ** m),
    "GHR_M3": lambda k, vf, kj, m: vf * np.sign(1 - k / kj) * np.abs(1 - k / kj) ** m,
    "KK": lambda k, vf, kc, c1, c2, c3: vf * (1 / (1 + np.exp((k / kc - c1) / c2)) - c3),
    "Jayakrishnan": lambda k, vf, vj, kj, m: vj + (vf - vj) * np.sign(1 - k / kj) * np.abs(1 - k / kj) ** m,
    "Van_Aerde": _van_aerde,
    "MacNicholas": lambda k, vf, kj, m, c: vf * (kj**m - k**m) / (kj**m + c * k**m),
    "Wang_3PL": lambda k, vf, kc, theta: vf / (1 + np.exp((k - kc) / theta)),
    "Wang_4PL": lambda k, vf, vb, kc, theta: vb + (vf - vb) / (1 + np.exp((k - kc) / theta)),
    "Wang_5PL": lambda k, vf, vb, kc, theta1, theta2: vb + (vf - vb) / (1 + np.exp((k - kc) / theta1)) ** theta2,
    "Ni": lambda v, vf, gamma, tau, l: 1 / ((gamma * v * v + tau * v + l) * (1 - np.log(1 - v / vf))),  # noqa: E741
}
STARTING = {model: np.array(x0) for model, x0, _, _ in _table()}
LIMITS = {model: (np.array(lo), np.array(hi)) for model, _, lo, hi in _table()}
PAIRS = [(a, b) for a in range(SIZE) for b in range(a, SIZE)]
SUMS = ["n", "sse", "flow_sse", *(f"a{a}{b}" for a, b in PAIRS), *(f"g{i}" for i in range(SIZE))]


def _finite(h: np.ndarray) -> np.ndarray:
    return np.abs(h) < PENALTY


def _sums(k: np.ndarray, v: np.ndarray, q: np.ndarray, model: str, trial: np.ndarray) -> list[float] | None:
    """SUMS of some rows of a group: their number, squared errors of the model and of its flows, products of the derivatives
    by the parameters, and gradients; None where no row counts."""
    dense, curve, size = model in DENSITY_MODELS, CURVES[model], len(BOUNDS[model])
    if dense:
        near = v < UNDER_FREE * BOUNDS[model]["vf"][1]
        k, v, q = k[near], v[near], q[near]
    if not len(k):
        return None
    x, y, p = (v, k, trial[:size]) if dense else (k, v, trial[:size])
    h = curve(x, *p)
    fine = _finite(h)
    r = np.where(fine, h - y, PENALTY)
    j = np.zeros((SIZE, len(x)))
    step = 1e-6 * np.maximum(np.maximum(np.abs(p), np.abs(STARTING[model][:size]) * 0.01), 1e-12)
    for i in range(size):
        moved = p.copy()
        moved[i] += step[i]
        there = curve(x, *moved)
        j[i] = np.where(fine & _finite(there), (there - h) / step[i], 0.0)
    a, dq = j @ j.T, h * x - q
    return [float(len(x)), float(r @ r), float(dq @ dq), *(float(a[i]) for i in PAIRS), *map(float, j @ r)]


def _summed(blocks: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model and SUMS of each group's models at their trials: a block's sums by arrays, then one aggregation."""
    one = at.groupBy(*keys).agg(F.collect_list(F.struct("model", "trial")).alias("fits")).select(*keys, F.col("fits.model").alias("models"), F.flatten("fits.trial").alias("trials"))
    met = blocks.join(one, keys)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for pdf in batches:
                found = []
                for row in pdf.itertuples(index=False):
                    of = row[: len(keys)]
                    k, v, q = (np.asarray(c, float) for c in (row.k, row.v, row.q))
                    for model, trial in zip(row.models, np.asarray(row.trials, float).reshape(-1, SIZE), strict=True):
                        if (sums := _sums(k, v, q, model, trial)) is not None:
                            found.append((*of, model, *sums))
                yield pd.DataFrame(found, columns=[*keys, "model", *SUMS])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "model string", *(f"{c} double" for c in SUMS)])
    return met.select(*keys, "k", "v", "q", "models", "trials").mapInPandas(parts, schema).groupBy(*keys, "model").agg(*[F.sum(c).alias(c) for c in SUMS])


def _step(model: str, p: np.ndarray, a: np.ndarray, g: np.ndarray, damp: float) -> np.ndarray:
    """The next trial: the damped equations solved, but for parameters that have no derivatives or stay at their bound."""
    lo, hi = LIMITS[model]
    full = np.zeros((SIZE, SIZE))
    for x, (i, j) in zip(a, PAIRS, strict=True):
        full[i, j] = full[j, i] = x
    held = (np.diag(full) <= 0) | (p <= lo) & (g > 0) | (p >= hi) & (g < 0)
    full = full * (1 + damp * np.eye(SIZE))
    full[held, :] = full[:, held] = 0.0
    full[held, held] = 1.0
    try:
        step = np.linalg.solve(full, np.where(held, 0.0, -g))
    except np.linalg.LinAlgError:
        step = np.zeros(SIZE)
    return np.clip(p + (step if np.isfinite(step).all() else 0.0), lo, hi)


def _moved(fit: dict, sums: list[float] | None, tolerance: float) -> dict:
    """A fit (model, trial, p, sse, a, g, damp, going) after a round: its trial taken if that is better, damping changed, the
    next trial. sums: squared errors, products and gradients at the trial."""
    better = sums is not None and sums[0] < fit["sse"]
    gain = np.inf
    if better:
        gain = (fit["sse"] - sums[0]) / max(sums[0], 1e-12)
        fit = fit | {"p": fit["trial"], "sse": sums[0], "a": sums[1 : 1 + len(PAIRS)], "g": sums[1 + len(PAIRS) :]}
    damp = max(fit["damp"] / 5, 1e-9) if better else fit["damp"] * 6
    p, a, g = (np.asarray(fit[c], float) for c in ("p", "a", "g"))
    trial = _step(fit["model"], p, a, g, damp)
    move = float((np.abs(trial - p) / np.maximum(np.abs(p), 1e-9)).sum())
    return fit | {"trial": trial, "damp": damp, "going": bool(fit["going"] and move > tolerance and damp < 1e9 and gain >= tolerance * 0.01)}


def _start(model: str) -> dict:
    x0 = STARTING[model]
    return {"model": model, "trial": x0, "p": x0, "sse": np.inf, "a": np.zeros(len(PAIRS)), "g": np.zeros(SIZE), "damp": 1e-2, "going": True}


def _stepped(met: DataFrame, state: DataFrame, tolerance: float) -> DataFrame:
    """state after a round; met: state with ``new``, the sums at its trials."""
    names = state.columns

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [_moved(row, None if row["new"] is None else list(row["new"]), tolerance) for row in pdf.to_dict("records")]
            yield pd.DataFrame([[row[c] for c in names] for row in done], columns=names)

    return met.mapInPandas(steps, state.schema)


def _in_one_block(blocks: DataFrame, keys: list[str], rounds: int, tolerance: float) -> DataFrame:
    """keys, model, trial of groups that are one block each: the same rounds, on its own sums."""

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for pdf in batches:
                found = []
                for row in pdf.itertuples(index=False):
                    k, v, q = (np.asarray(c, float) for c in (row.k, row.v, row.q))
                    for model in BOUNDS:
                        fit = _start(model)
                        for _ in range(rounds):
                            sums = _sums(k, v, q, model, np.asarray(fit["trial"], float))
                            fit = _moved(fit, None if sums is None else [sums[1], *sums[3:]], tolerance)
                            if not fit["going"]:
                                break
                        found.append((*row[: len(keys)], model, np.asarray(fit["p"], float)))
                yield pd.DataFrame(found, columns=[*keys, "model", "trial"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return blocks.select(*keys, "k", "v", "q").mapInPandas(fits, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "model string", "trial array<double>"]))


def _tops(best: DataFrame, keys: list[str]) -> DataFrame:
    """best with capacity: the largest flow on each model's curve at whole densities, or speeds."""
    grid = np.arange(1.0, 201.0)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for pdf in batches:
                found = []
                for model, trial in zip(pdf.model, pdf.trial, strict=True):
                    x = grid[grid < UNDER_FREE * BOUNDS[model]["vf"][1]] if model in DENSITY_MODELS else grid
                    flow = CURVES[model](x, *np.asarray(trial, float)[: len(BOUNDS[model])]) * x
                    flow = flow[flow < PENALTY]
                    found.append(float(flow.max()) if len(flow) else None)
                yield pdf.assign(capacity=pd.Series(found, index=pdf.index, dtype=float))

    kinds = {f.name: f.dataType.simpleString() for f in best.schema}
    out = best.select(*keys, "model", "trial").mapInPandas(tops, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "model string", "trial array<double>", "capacity double"]))
    return out.withColumn("capacity", F.nanvl("capacity", F.lit(None).cast("double")))


def fitted_diagrams(rows: DataFrame, keys: tuple[str, ...] = ("corridor",), least: int = 10, rounds: int = 25, tolerance: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """keys, model, n, params (map), rmse, flow_rmse, capacity of each group and each of the 16 models, within BOUNDS.

    rows: keys, speed, flow, density; those without a positive density don't count, nor, for the two models of density by
    speed, those near free flow. rmse is the error of what a model gives: speed, or density. capacity is the largest flow
    on the model's curve at whole densities (speeds). Groups of fewer than ``least`` rows have none.

    A round is one aggregation: blocks of about ``block`` rows at most of a group meet its 16 trial parameter sets, and squared
    errors, derivatives' products and gradients are summed. A trial that is better is taken and the damping falls; else it
    rises. Parameters at a bound that the gradient pushes outwards stay there. The next trial solves the damped equations. A
    group of one block takes its rounds in the task that has the block; the others' sums go through an aggregation. No task
    has more than a block, however large a group is, and the driver sees one flag a round.
    """
    spark, keys_out, keys = rows.sparkSession, list(keys), [f"_key{i}" for i in range(len(keys))]
    use = (F.col("density") > 0) & F.col("speed").isNotNull() & F.col("flow").isNotNull()
    df = cut(rows.where(use).select(*[F.col(c).alias(k) for c, k in zip(keys_out, keys, strict=True)], F.col("density").cast("double").alias("k"), F.col("speed").cast("double").alias("v"), F.col("flow").cast("double").alias("q"))).withColumn("_at", F.monotonically_increasing_id())
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    # Rows of a group in blocks, dealt by their place in the written table.
    dealt = df.join(groups, keys).withColumn("n_blocks", F.ceil(F.col("rows") / block)).withColumn("block", F.pmod(F.xxhash64("_at"), F.col("n_blocks")))
    lists = dealt.groupBy(*keys, "block").agg(F.first("n_blocks").alias("n_blocks"), *[F.collect_list(c).alias(c) for c in ("k", "v", "q")])
    blocks = cut(lists.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys))
    best = _in_one_block(blocks.where("n_blocks = 1"), keys, rounds, tolerance)
    several = blocks.where("n_blocks > 1")
    if not several.isEmpty():
        zeros = lambda n: F.array(*[F.lit(0.0)] * n)
        models = spark.createDataFrame([(m, x0) for m, x0, _, _ in _table()], "model string, trial array<double>")
        state = cut(several.select(*keys).distinct().crossJoin(F.broadcast(models)).select(*keys, "model", "trial", F.col("trial").alias("p"), F.lit(float("inf")).alias("sse"), zeros(len(PAIRS)).alias("a"), zeros(SIZE).alias("g"), F.lit(1e-2).alias("damp"), F.lit(True).alias("going")))  # 16 models
        for _ in range(rounds):
            sums = _summed(several, state.where("going"), keys).select(*keys, "model", F.array("sse", *SUMS[3:]).alias("new"))
            state = cut(_stepped(state.join(sums, [*keys, "model"], "left"), state, tolerance))
            if state.where("going").isEmpty():
                break
        best = best.unionByName(state.select(*keys, "model", F.col("p").alias("trial")))
    best = cut(best)
    errors = _summed(blocks, best, keys).select(*keys, "model", F.col("n").cast("long").alias("n"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), F.sqrt(F.col("flow_sse") / F.col("n")).alias("flow_rmse"))
    names = F.lit(None).cast("array<string>")
    for model, params in BOUNDS.items():
        names = F.when(F.col("model") == model, F.array(*map(F.lit, params))).otherwise(names)
    params = F.map_from_arrays(names, F.slice("trial", F.lit(1), F.size(names))).alias("params")
    return _tops(best, keys).join(errors, [*keys, "model"]).select(*[F.col(k).alias(c) for c, k in zip(keys_out, keys, strict=True)], "model", "n", params, "rmse", "flow_rmse", "capacity")
