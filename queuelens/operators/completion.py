"""Low-rank completion of speed fields and cubes by alternating least squares: every update of a mode's factors is a join
with those of the other modes and one aggregation of small sums, so no task holds a corridor's cube."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.linear import dot, solved
from queuelens.session import cut

#: Rounds of plain least squares before a robust fit clips its residuals; rounds from one look at the movement to the next.
WARM, LOOK = 2, 2


@dataclass(frozen=True)
class LowRank:
    """A fit: keys and mean of each group, and for each mode its values' factors ``f``."""

    keys: list[str]
    modes: list[str]
    groups: DataFrame
    factors: dict[str, DataFrame]

    def at(self, grid: DataFrame) -> DataFrame:
        """grid with guess. Where a value of a mode was never seen, it is the group's mean; an unknown group has null."""
        for m in self.modes:
            grid = grid.join(self.factors[m].withColumnRenamed("f", f"_f_{m}"), [*self.keys, m], "left")
        x = _product([f"_f_{m}" for m in self.modes])
        grid = grid.join(self.groups.select(*self.keys, F.col("mean").alias("_mean")), self.keys, "left")
        guess = F.col("_mean") + F.coalesce(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
        return grid.withColumn("guess", guess).drop("_mean", *[f"_f_{m}" for m in self.modes])


def _product(names: list[str]) -> Column:
    return functools.reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p * q), [F.col(n) for n in names])


def _start(m: str, rank: int, size: Column) -> Column:
    """Numbers of both signs that follow from the value of a mode alone, however rows are partitioned."""
    at = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(m).cast("string"), F.lit(str(k)))), 1, 8), 16, 10).cast("double") / 2.0**31 - 1
    return F.array(*[at(k) * size for k in range(rank)])


def low_rank(cells: DataFrame, modes: Sequence[str], keys: Sequence[str] = ("corridor",), value: str = "v", rank: int = 3, ridge: float = 0.02, rounds: int = 6, tolerance: float = 0.02, robust: bool = False) -> LowRank:
    """The fit of each group's known cells (keys, modes, value) by its mean and ``rank`` products of one number a mode value.

    Least squares with ``ridge`` times the norm of the group's centred cells on the factors: for two modes these are, at
    convergence and with enough rank, the cells that soft-thresholding singular values by the same number would give; for
    three the cube's canonical products. ``robust`` splits off what is sparse: residuals count linearly beyond the penalty
    over the root of the longest mode. Null and NaN cells don't count; a null in a key or mode leaves a cell out. Cells of
    equal keys and modes count each. A group with one value has no more than its mean.

    A round updates the modes in turn. The fit ends when the last mode's factors, at a look every second round, move by less than ``tolerance`` of their
    norm in every group; the driver sees that one number. Sums are combined before they are shuffled, so that a mode value
    with very many cells is no hot group.
    """
    keys, modes = list(keys), list(modes)
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for c in (*keys, *modes):
        known = known & F.col(c).isNotNull()
    known_cells = cells.where(known).select(*keys, *modes, F.col(value).cast("double").alias("v"))
    sizes = [F.countDistinct(m).alias(f"_n_{m}") for m in modes] if robust else []
    longest = F.greatest(*[F.col(f"_n_{m}") for m in modes]) if robust else F.lit(1)
    groups = known_cells.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"), *sizes)
    groups = groups.withColumn("lam", F.greatest(ridge * F.col("sd") * F.sqrt("n"), F.lit(1e-9)))
    groups = cut(groups.withColumn("tau", F.col("lam") / F.sqrt(longest)).select(*keys, "mean", "sd", "lam", "tau"))
    z = cut(known_cells.join(groups, keys).select(*keys, *modes, (F.col("v") - F.col("mean")).alias("y"), "lam", "tau"))
    size = F.pow(F.greatest("sd", F.lit(1e-9)), 1.0 / len(modes))
    factors = {m: z.select(*keys, m).distinct().join(groups, keys).select(*keys, m, _start(m, rank, size).alias("f")) for m in modes[1:]}
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]

    def updated(m: str, clipped: bool) -> DataFrame:
        met = z
        for o in modes if clipped else [o for o in modes if o != m]:
            met = met.join(factors[o].withColumnRenamed("f", f"_f_{o}"), [*keys, o])
        met = met.withColumn("x", _product([f"_f_{o}" for o in modes if o != m]))
        if clipped:
            hat = dot(F.col(f"_f_{m}"), F.col("x"))
            met = met.withColumn("y", hat + F.greatest(-F.col("tau"), F.least(F.col("tau"), F.col("y") - hat)))
        x = [F.col("x")[i] for i in range(rank)]
        sums = met.groupBy(*keys, m).agg(F.max("lam").alias("lam"), *[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * F.col("y")).alias(f"g{i}") for i in range(rank)])
        entry = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}") + (F.col("lam") if i == j else F.lit(0.0))
        a = F.array(*[F.array(*[entry(i, j) for j in range(rank)]) for i in range(rank)])
        return cut(sums.select(*keys, m, solved(a, F.array(*[F.col(f"g{i}") for i in range(rank)]), rank).alias("f")))

    last = modes[-1]
    for t in range(rounds):
        before = factors[last]
        for m in modes:
            factors[m] = updated(m, robust and t >= WARM)
        if not tolerance or t % LOOK != LOOK - 1 or t < WARM * robust:
            continue
        moved = factors[last].join(before.withColumnRenamed("f", "old"), [*keys, last])
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
        norms = moved.groupBy(*keys).agg(F.sum(square(F.zip_with("f", "old", lambda p, q: p - q))).alias("move"), F.sum(square(F.col("f"))).alias("norm"))
        if (norms.agg(F.max(F.col("move") / F.greatest("norm", F.lit(1e-12)))).first()[0] or 0.0) < tolerance**2:
            break
    return LowRank(keys, modes, groups, factors)


def speed_cells(states: DataFrame, minutes: int = 60, days: int = 28) -> DataFrame:
    """corridor, span, sensor_uid, slot, date, v: mean speeds; spans have at most ``days`` days."""
    slot = F.expr(f"(hour(datetime) * 60 + minute(datetime)) div {minutes}").cast("int")
    date = F.date_format("datetime", "yyyy-MM-dd")
    cells = states.groupBy("corridor", "sensor_uid", slot.alias("slot"), date.alias("date")).agg(F.avg("speed_mph").alias("v"))
    return cells.withColumn("span", F.floor(F.datediff(F.col("date"), F.lit("2000-01-03")) / days))


def whole_grid(cells: DataFrame, modes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Every combination of the mode values that occur in a group."""
    seen = [cells.select(*keys, m).distinct() for m in modes]
    return functools.reduce(lambda a, b: a.join(b, list(keys)), seen)


def complete_speeds(states: DataFrame, method: str = "tensor", minutes: int = 60, ranks: tuple[int, int, int] = (8, 10, 4), days: int = 28, rank: int = 3, rounds: int = 6, tolerance: float = 0.02) -> DataFrame:
    """(corridor, sensor_uid, date, slot, observed, completed) of each corridor's sensor x slot x day cube. "matrix" fits
    sensor and slot by day, "tensor" all three modes; known cells stay. "tucker" rebuilds the tensor's filling from its
    leading vectors, "rpca" is the low-rank part beside sparse residuals: both replace known cells too. Spans of ``days``
    days are completed on their own."""
    keys, axes = ["corridor", "span"], ["sensor_uid", "slot", "date"]
    cells = cut(speed_cells(states, minutes, days).withColumn("row", F.concat_ws(":", "sensor_uid", "slot")))
    grid = whole_grid(cells, axes, keys).join(cells.select(*keys, *axes, "v"), [*keys, *axes], "left").withColumn("row", F.concat_ws(":", "sensor_uid", "slot"))
    modes = ["row", "date"] if method in ("matrix", "rpca") else axes
    at = low_rank(cells, modes, keys, rank=rank, rounds=rounds, tolerance=tolerance, robust=method == "rpca").at(grid)
    done = F.col("guess") if method == "rpca" else F.coalesce("v", "guess")
    out = at.select(*keys, *axes, F.col("v").alias("observed"), done.alias("completed"))
    if method == "tucker":
        rebuilt = tucker(out.withColumnRenamed("completed", "v"), dict(zip(axes, ranks, strict=True)), keys)
        out = out.drop("completed").join(rebuilt.withColumnRenamed("v", "completed"), [*keys, *axes])
    return out.select("corridor", "sensor_uid", "date", "slot", "observed", "completed")


def mode_gram(cells: DataFrame, mode: str, modes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, i, j, g: inner products of the slices of a mode, i up to j. Slices meet where their other modes agree."""
    on = [*keys, *[m for m in modes if m != mode]]
    a, b = cells.select(*on, F.col(mode).alias("i"), F.col("v").alias("p")), cells.select(*on, F.col(mode).alias("j"), F.col("v").alias("q"))
    return a.join(b, on).where("i <= j").groupBy(*keys, "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("g"))


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    axis = np.sort(pd.unique(pd.concat([pdf.i, pdf.j])))
    g, i, j = np.zeros((len(axis),) * 2), np.searchsorted(axis, pdf.i.to_numpy()), np.searchsorted(axis, pdf.j.to_numpy())
    g[i, j] = g[j, i] = pdf.g.to_numpy(float)
    return axis, g


def spectra(cells: DataFrame, modes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, mode, size, participation, k90, k99 of whole cubes: the participation ratio of the energies of each mode's
    singular vectors, and how many of them hold 90 and 99 % of it. A task gets the inner products of one mode's slices (as
    many as the square of its length), never the cells."""

    def rank_statistics(pdf: pd.DataFrame) -> pd.DataFrame:
        _, g = _square(pdf)
        e = np.maximum(np.linalg.eigvalsh(g)[::-1], 0)
        share = e.cumsum() / max(e.sum(), 1e-300)
        row = (len(e), float(e.sum() ** 2 / max((e * e).sum(), 1e-300)), *[min(int(np.searchsorted(share, x)) + 1, len(e)) for x in (0.9, 0.99)])
        return pd.DataFrame([(*pdf.iloc[0][[*keys, "mode"]], *row)], columns=[*keys, "mode", "size", "participation", "k90", "k99"])

    grams = [mode_gram(cells, m, modes, keys).select(*keys, F.lit(m).alias("mode"), F.col("i").cast("string"), F.col("j").cast("string"), "g") for m in modes]
    schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return functools.reduce(DataFrame.unionByName, grams).groupBy(*keys, "mode").applyInPandas(rank_statistics, f"{schema}, mode string, size int, participation double, k90 int, k99 int")


def mode_spectra(states: DataFrame, minutes: int = 60, rounds: int = 6) -> DataFrame:
    """Rank statistics of each corridor's filled cube and mode, over all days that are given."""
    filled = cut(complete_speeds(states, "tensor", minutes, rounds=rounds).withColumnRenamed("completed", "v"))
    return spectra(filled, ("sensor_uid", "slot", "date"), ("corridor",)).withColumn("mode", F.when(F.col("mode") == "sensor_uid", "sensor").otherwise(F.col("mode")))


def _leading(mode: str, rank: int, keys: list[str]):
    def vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        axis, g = _square(pdf)
        u = np.linalg.eigh(g)[1][:, ::-1][:, :rank]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(axis) for k in keys}, mode: axis, "u": list(u)})

    return vectors


def tucker(cells: DataFrame, ranks: dict[str, int], keys: Sequence[str]) -> DataFrame:
    """keys, modes, v: whole cubes rebuilt from the leading ``ranks`` vectors of each mode, one mode after the other. The
    vectors come from the mode's inner products; the projection is a join, sums of a few numbers and a join back."""
    modes, keys = list(ranks), list(keys)
    cells = cells.select(*keys, *modes, "v")
    for m, rank in ranks.items():
        of = cells.schema[m].dataType.simpleString()
        schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
        u = cut(mode_gram(cells, m, modes, keys).groupBy(*keys).applyInPandas(_leading(m, rank, keys), f"{schema}, {m} {of}, u array<double>"))
        others = [*keys, *[o for o in modes if o != m]]
        core = cells.join(u, [*keys, m]).groupBy(*others).agg(F.array(*[F.sum(F.coalesce(F.get("u", F.lit(i)), F.lit(0.0)) * F.col("v")) for i in range(rank)]).alias("core"))
        cells = cut(core.join(u, keys).select(*keys, *modes, dot(F.slice("core", F.lit(1), F.size("u")), F.col("u")).alias("v")))
    return cells


def space_time_cells(rows: DataFrame, position: str, time: str, n_pos: int = 40, n_time: int = 50, lane: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """rows with pi and ti: equal parts of each group's stretch of road and of time. With ``lane``, rows of no positive lane
    go, and li is the lane. Rows without position or time go."""
    keys = list(keys)
    df = rows.where(F.col(position).isNotNull() & F.col(time).isNotNull())
    df = df.where(F.col(lane) > 0).withColumn("li", F.col(lane).cast("int")) if lane else df
    ends = df.groupBy(*keys).agg(F.min(position).alias("_p0"), F.max(position).alias("_p1"), F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    df = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    part = lambda c, a, b, n: F.greatest(F.least(F.floor((F.col(c) - F.col(a)) / (F.col(b) - F.col(a) + 1e-9) * n), F.lit(n - 1)), F.lit(0)).cast("int")
    return df.withColumns({"pi": part(position, "_p0", "_p1", n_pos), "ti": part(time, "_t0", "_t1", n_time)}).drop("_p0", "_p1", "_t0", "_t1")


def sampled(vehicle: Column, trial: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 for each vehicle and trial, the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", vehicle.cast("string"), trial.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2.0**32


def probe_completion(rows: DataFrame, penetrations: Sequence[float], trials: int = 5, modes: Sequence[str] = ("pi", "ti"), keys: Sequence[str] = (), vehicle: str = "vehicle", speed: str = "speed", rank: int = 3, ridge: float = 0.02, rounds: int = 6, tolerance: float = 0.02, seed: int = 0) -> DataFrame:
    """keys, penetration, trial, n_probes, n_seen, n_unseen, obs_frac, r2, rmse: how well the mean speeds of all vehicles'
    cells come back from those of a share of the vehicles. Scores are of cells that other vehicles drove through and no
    probe; r2 and rmse are null without such cells, r2 also where they don't differ. A trial without any probe has no row.

    Every trial and penetration is a group of one fit, so all are completed together; a vehicle that is a probe at one
    penetration is one at every higher one. ``modes`` may hold a third, the lane. Each vehicle's readings in a cell become
    one sum and count, written once: draws of all trials repeat these, not the readings.
    """
    keys, modes = list(keys), list(modes)
    rows = rows.where(F.col(speed).isNotNull() & F.col(vehicle).isNotNull()).select(*keys, *modes, F.col(vehicle).alias("_veh"), F.col(speed).cast("double").alias("_v"))
    run = ["penetration", "trial"]
    rows = cut(rows.groupBy(*keys, *modes, "_veh").agg(F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_n")))
    mean = F.sum("_v") / F.sum("_n")
    truth = cut(rows.groupBy(*keys, *modes).agg(mean.alias("truth")))
    drawn = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_u", sampled(F.col("_veh"), F.col("trial"), seed))
    drawn = drawn.withColumn("penetration", F.explode(F.filter(F.array(*map(F.lit, map(float, penetrations))), lambda p: F.col("_u") < p)))
    seen = cut(drawn.groupBy(*keys, *run, *modes).agg(mean.alias("v")))
    probes = drawn.groupBy(*keys, *run).agg(F.countDistinct("_veh").alias("n_probes"))
    fit = low_rank(seen, modes, [*keys, *run], rank=rank, ridge=ridge, rounds=rounds, tolerance=tolerance)
    runs = fit.groups.select(*keys, *run)
    every = truth.join(runs, keys) if keys else truth.crossJoin(F.broadcast(runs))  # a row a trial and penetration
    at = fit.at(every.join(seen, [*keys, *run, *modes], "left"))
    hidden = F.col("v").isNull()
    e, t = F.when(hidden, F.col("guess") - F.col("truth")), F.when(hidden, F.col("truth"))
    out = at.groupBy(*keys, *run).agg(F.count("v").alias("n_seen"), F.count(e).alias("n_unseen"), (F.count("v") / F.count(F.lit(1))).alias("obs_frac"), F.avg(e * e).alias("mse"), F.var_pop(t).alias("var"))
    return out.join(probes, [*keys, *run]).select(*keys, *run, "n_probes", "n_seen", "n_unseen", "obs_frac", F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).alias("r2"), F.sqrt("mse").alias("rmse"))


def probe_curve(trials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over the trials of each penetration."""
    return trials.groupBy(*keys, "penetration").agg(F.count(F.lit(1)).alias("n_trials"), F.avg("obs_frac").alias("obs_frac"), F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))
