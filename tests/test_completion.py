"""Low-rank completion against thresholded singular values and plain recomputation in memory."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.operators import completion


def soft_impute(x, ridge):
    """Centred cells by soft-thresholded singular values, from cold, to convergence."""
    known = np.isfinite(x)
    mean = x[known].mean()
    y = np.where(known, x - mean, 0.0)
    lam, z = ridge * np.linalg.norm(y), np.zeros_like(y)
    for _ in range(20000):
        u, s, vt = np.linalg.svd(np.where(known, y, z), full_matrices=False)
        new = (u * np.maximum(s - lam, 0)) @ vt
        if np.abs(new - z).max() < 1e-10:
            break
        z = new
    return mean + new


def start(value, rank, size):
    return size * np.array([int(hashlib.md5(f"{value}:{k}".encode()).hexdigest()[:8], 16) / 2**31 - 1 for k in range(rank)])


def plain(x, rank, ridge, rounds, robust=False, at=None):
    """The same rounds as loops over arrays; ``at`` names the places of each axis, else 0, 1, ..."""
    at = at or [range(n) for n in x.shape]
    known = np.isfinite(x)
    mean, sd, n, axes = x[known].mean(), x[known].std(), known.sum(), range(x.ndim)
    lam = ridge * sd * np.sqrt(n)
    tau, y = lam / np.sqrt(max(x.shape)), x - mean
    f = [np.zeros((x.shape[0], rank))] + [np.array([start(i, rank, sd ** (1 / x.ndim)) for i in at[m]]) for m in axes[1:]]
    letters = "abc"[: x.ndim]
    for t in range(rounds):
        for m in axes:
            others = [o for o in axes if o != m]
            hat = np.einsum(",".join(f"{c}r" for c in letters) + "->" + letters, *f)
            target = hat + np.clip(y - hat, -tau, tau) if robust and t >= 2 else y
            for i in range(x.shape[m]):
                here = np.argwhere(np.moveaxis(known, m, 0)[i])
                b = np.prod([f[o][here[:, k]] for k, o in enumerate(others)], axis=0)
                f[m][i] = np.linalg.solve(b.T @ b + lam * np.eye(rank), b.T @ np.moveaxis(target, m, 0)[i][tuple(here.T)])
    return mean + np.einsum(",".join(f"{c}r" for c in letters) + "->" + letters, *f)


def as_cells(spark, x, modes, group="c"):
    rows = [(group, *map(int, at), float(x[at])) for at in np.ndindex(x.shape) if np.isfinite(x[at])]
    return spark.createDataFrame(rows, f"corridor string, {', '.join(f'{m} int' for m in modes)}, v double")


def whole(spark, shape, modes, group="c"):
    return spark.createDataFrame([(group, *map(int, at)) for at in np.ndindex(shape)], f"corridor string, {', '.join(f'{m} int' for m in modes)}")


def as_array(df, shape, modes, column):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[m] for m in modes)] = r[column]
    return out


def holed(rng, shape, share):
    x = np.where(rng.random(shape) < share, np.nan, 0.0)
    x[tuple(np.arange(max(shape)) % n for n in shape)] = 0.0  # something of every row and column
    return x


def test_two_modes_are_thresholded_singular_values(spark):
    rng, modes = np.random.default_rng(3), ("a", "b")
    x = 50 + 10 * rng.normal(size=(14, 2)) @ rng.normal(size=(2, 6)) + rng.normal(0, 1, (14, 6)) + holed(rng, (14, 6), 0.3)
    y = 20 + 5 * rng.normal(size=(5, 1)) @ rng.normal(size=(1, 4))
    both = as_cells(spark, x, modes).unionByName(as_cells(spark, y, modes, "d"))
    fit = completion.low_rank(both, modes, rank=3, ridge=0.1, rounds=3, tolerance=0)
    got = fit.at(whole(spark, x.shape, modes).unionByName(whole(spark, y.shape, modes, "d"))).cache()
    for z, group in ((x, "c"), (y, "d")):
        assert np.abs(as_array(got.where(F.col("corridor") == group), z.shape, modes, "guess") - plain(z, 3, 0.1, 3)).max() < 1e-8
    assert np.abs(plain(x, 6, 0.1, 3000) - soft_impute(x, 0.1)).max() < 1e-4  # where the rounds lead


def test_cube_of_three_modes(spark):
    rng, modes = np.random.default_rng(0), ("a", "b", "c")
    t = 40 + 6 * np.einsum("ir,jr,kr->ijk", *(rng.normal(size=(n, 2)) for n in (6, 8, 5)))
    holes = t + np.where(rng.random(t.shape) < 0.25, np.nan, 0)
    fit = completion.low_rank(as_cells(spark, holes, modes), modes, rank=2, ridge=0.001, rounds=2, tolerance=0)
    assert np.abs(as_array(fit.at(whole(spark, t.shape, modes)), t.shape, modes, "guess") - plain(holes, 2, 0.001, 2)).max() < 1e-8
    assert np.sqrt(np.mean((plain(holes, 3, 0.001, 60) - t)[np.isnan(holes)] ** 2)) < 0.15 * t.std()


def test_sparse_outliers_are_split_off(spark):
    rng, modes = np.random.default_rng(1), ("a", "b")
    low = 55 + 8 * rng.normal(size=(20, 1)) @ rng.normal(size=(1, 10))
    out = rng.random(low.shape) < 0.06
    x = low - 40 * out
    fit = completion.low_rank(as_cells(spark, x, modes), modes, rank=2, ridge=0.02, rounds=4, tolerance=0, robust=True)
    assert np.abs(as_array(fit.at(whole(spark, x.shape, modes)), x.shape, modes, "guess") - plain(x, 2, 0.02, 4, True)).max() < 1e-8
    error = [np.abs(plain(x, 2, 0.02, 60, robust) - low)[~out].mean() for robust in (False, True)]
    assert error[1] < 0.6 * error[0]


def test_odd_cells(spark):
    schema = "corridor string, a int, b int, v double"
    none = completion.low_rank(spark.createDataFrame([], schema), ("a", "b"))
    assert none.at(spark.createDataFrame([("c", 1, 1)], "corridor string, a int, b int")).first().guess is None
    rows = [("c", a, b, 30.0) for a in range(3) for b in range(3)] + [("c", 0, 0, None), ("c", 0, 1, float("nan")), (None, 0, 0, 9.0), ("c", None, 0, 9.0), ("e", 1, 1, 7.0)]
    fit = completion.low_rank(spark.createDataFrame(rows, schema), ("a", "b"))
    at = fit.at(spark.createDataFrame([("c", 1, 1), ("c", 99, 1), ("e", 1, 1), ("f", 1, 1)], "corridor string, a int, b int")).collect()
    assert {(r.corridor, r.a): r.guess for r in at} == {("c", 1): 30.0, ("c", 99): 30.0, ("e", 1): 7.0, ("f", 1): None}


def test_tucker_and_spectra(spark):
    rng, modes = np.random.default_rng(5), ("a", "b", "c")
    t = 30 + rng.normal(size=(4, 6, 5)) * 5
    cells, ranks, want = as_cells(spark, t, modes), (2, 3, 5), t
    for axis, r in enumerate(ranks):
        m = np.moveaxis(want, axis, 0)
        u = np.linalg.svd(m.reshape(len(m), -1), full_matrices=False)[0][:, :r]
        want = np.moveaxis(np.tensordot(u @ u.T, m, 1), 0, axis)
    got = completion.tucker(cells, dict(zip(modes, ranks, strict=True)), ("corridor",))
    assert np.abs(as_array(got, t.shape, modes, "v") - want).max() < 1e-9
    for r in completion.spectra(cells, modes, ("corridor",)).collect():
        axis = modes.index(r["mode"])
        e = np.linalg.svd(np.moveaxis(t, axis, 0).reshape(t.shape[axis], -1), compute_uv=False) ** 2
        share = e.cumsum() / e.sum()
        assert (r["size"], r.k90, r.k99) == (t.shape[axis], np.searchsorted(share, 0.9) + 1, np.searchsorted(share, 0.99) + 1)
        assert r.participation == pytest.approx(e.sum() ** 2 / (e * e).sum())


def test_speeds_are_completed(spark):
    df = spark.createDataFrame([("c", f"s{i}", f"2024-01-0{d} {h:02d}:00:00", 50.0 + i + h) for i in range(3) for d in range(1, 4) for h in range(24) if (i + d + h) % 5], "corridor string, sensor_uid string, t string, speed_mph double").withColumn("datetime", F.col("t").cast("timestamp_ntz"))
    for method in ("matrix", "tensor", "tucker", "rpca"):
        out = completion.complete_speeds(df, method, rank=2, rounds=4, tolerance=0).toPandas()
        assert len(out) == 3 * 3 * 24 and out.completed.notna().all()
        if method in ("matrix", "tensor"):
            assert (out.completed == out.observed)[out.observed.notna()].all()
            truth = 50.0 + out.sensor_uid.str[1:].astype(int) + out.slot
            assert (out.completed - truth)[out.observed.isna()].abs().mean() < 3
    got = completion.mode_spectra(df, rounds=2).toPandas().set_index("mode")
    assert got["size"].to_dict() == {"sensor": 3, "slot": 24, "date": 3} and (got.k90 <= got.k99).all()


def test_probes_against_plain_trials(spark):
    rng = np.random.default_rng(2)
    field = 55 - 30 * np.exp(-(((np.arange(10)[:, None] - 5) / 2) ** 2) - ((np.arange(12)[None] - 6) / 3) ** 2)
    trips = []
    for veh in range(40):
        t0, p0 = int(rng.integers(0, 12)), int(rng.integers(0, 7))
        trips += [(f"v{veh}", p, min(11, t0 + p // 5), float(field[p, min(11, t0 + p // 5)] + rng.normal(0, 1))) for p in range(p0, p0 + 4)]
    df = spark.createDataFrame([*trips, ("v1", 0, 0, None), (None, 0, 0, 5.0)], "vehicle string, pi int, ti int, speed double")
    pens, trials = (0.2, 0.5, 1.0), 2
    got = completion.probe_completion(df, pens, trials, rank=2, ridge=0.05, rounds=2, tolerance=0).collect()
    assert len(got) == 6
    mean = lambda rows: {k: np.mean([s for *k2, s in rows if tuple(k2) == k]) for k in {(p, t) for p, t, _ in rows}}
    truth = mean([(p, t, s) for _, p, t, s in trips])
    for r in got:
        share = lambda v, r=r: int(hashlib.md5(f"{v}:{r.trial}:0".encode()).hexdigest()[:8], 16) / 2**32
        probes = {v for v, *_ in trips if share(v) < r.penetration}
        seen = mean([(p, t, s) for v, p, t, s in trips if v in probes])
        rows, cols = sorted({p for p, _ in seen}), sorted({t for _, t in seen})
        x = np.full((len(rows), len(cols)), np.nan)
        for (p, t), s in seen.items():
            x[rows.index(p), cols.index(t)] = s
        if r.penetration == 1:
            assert (r.n_unseen, r.obs_frac, r.r2, r.rmse) == (0, 1.0, None, None)
            continue
        z, fallback = plain(x, 2, 0.05, 2, at=(rows, cols)), np.mean(list(seen.values()))
        unseen = [k for k in truth if k not in seen]
        guess = np.array([z[rows.index(p), cols.index(t)] if p in rows and t in cols else fallback for p, t in unseen])
        want = np.array([truth[k] for k in unseen])
        assert (r.n_probes, r.n_seen, r.n_unseen) == (len(probes), len(seen), len(unseen))
        assert r.obs_frac == pytest.approx(len(seen) / len(truth))
        assert r.rmse == pytest.approx(np.sqrt(np.mean((guess - want) ** 2)), rel=1e-6)
        assert r.r2 == pytest.approx(1 - np.sum((guess - want) ** 2) / np.sum((want - want.mean()) ** 2), abs=1e-6)
    curve = {r.penetration: r for r in completion.probe_curve(spark.createDataFrame(got)).collect()}
    assert curve[0.5].obs_frac > curve[0.2].obs_frac and curve[0.2].n_trials == 2


def test_space_time_cells_of_lanes(spark):
    rows = [("v", 0.0, 0, 1), ("v", 50.0, 5, 1), ("w", 100.0, 10, 2), ("w", 100.0, 10, 0), ("x", None, 1, 1), ("x", 1.0, None, 1)]
    df = spark.createDataFrame(rows, "vehicle string, y double, t int, lane int")
    got = completion.space_time_cells(df, "y", "t", 4, 2, "lane").collect()
    assert sorted((r.vehicle, r.pi, r.ti, r.li) for r in got) == [("v", 0, 0, 1), ("v", 1, 0, 1), ("w", 3, 1, 2)]
    assert len(completion.space_time_cells(df, "y", "t", 4, 2).collect()) == 4
