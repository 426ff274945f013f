"""DuckDB SQL of low-rank completion with two factors and a fixed number of rounds: each update is a grouping and a closed
solution of two equations."""

from queuelens.plans.oracles import RAW, STATES


def _update(name: str, keys: str, mode: str, other: str, factors: str) -> str:
    return f"""{name} as materialized (
  select {keys}, {mode}, (g0 * (a11 + lam) - g1 * a01) / ((a00 + lam) * (a11 + lam) - a01 * a01) as f0, (g1 * (a00 + lam) - g0 * a01) / ((a00 + lam) * (a11 + lam) - a01 * a01) as f1
  from (select {keys}, {mode}, any_value(lam) as lam, sum(f0 * f0) as a00, sum(f0 * f1) as a01, sum(f1 * f1) as a11, sum(f0 * y) as g0, sum(f1 * y) as g1 from z join {factors} using ({keys}, {other}) group by all))"""


def _low_rank(cells: str, keys: str, a: str, b: str, rounds: int) -> str:
    start = lambda k: f"(cast('0x' || substr(md5({b} || ':{k}'), 1, 8) as bigint) / 2147483648.0::double - 1) * sqrt(greatest(sd, 1e-9))"
    steps = [_update(f"a{t}", keys, a, b, f"b{t}") + ",\n" + _update(f"b{t + 1}", keys, b, a, f"a{t}") for t in range(rounds)]
    return f"""groups as materialized (select {keys}, avg(v) as mean, stddev_pop(v) as sd, greatest(0.02::double * stddev_pop(v) * sqrt(count(*)), 1e-9) as lam from {cells} group by all),
z as materialized (select {keys}, {a}, {b}, v - mean as y, lam from {cells} join groups using ({keys})),
b0 as (select {keys}, {b}, {start(0)} as f0, {start(1)} as f1 from (select distinct {keys}, {b} from {cells}) join groups using ({keys})),
""" + ",\n".join(steps)


def sql() -> dict[str, str]:
    rounds = 3
    fa, fb = f"a{rounds - 1}", f"b{rounds}"
    return {
        "low_rank_speeds": f"""with {STATES},
cells as materialized (
  select corridor, date_diff('day', date '2000-01-03', cast(datetime as date)) // 28 as span, sensor_uid, hour(datetime) as slot, strftime(datetime, '%Y-%m-%d') as date, sensor_uid || ':' || hour(datetime) as row, avg(speed_mph) as v from states group by all),
{_low_rank("cells", "corridor, span", "row", "date", rounds)},
grid as (
  select corridor, span, sensor_uid, slot, date, sensor_uid || ':' || slot as row from (select distinct corridor, span, sensor_uid from cells) join (select distinct corridor, span, slot from cells) using (corridor, span)
  join (select distinct corridor, span, date from cells) using (corridor, span))
select g.corridor, g.sensor_uid, g.date, cast(g.slot as integer) as slot, round(v, 4) as observed, round(coalesce(v, mean + coalesce({fa}.f0 * {fb}.f0 + {fa}.f1 * {fb}.f1, 0)), 4) as completed
from grid g join groups using (corridor, span) left join cells c on c.corridor = g.corridor and c.span = g.span and c.row = g.row and c.date = g.date
left join {fa} on {fa}.corridor = g.corridor and {fa}.span = g.span and {fa}.row = g.row left join {fb} on {fb}.corridor = g.corridor and {fb}.span = g.span and {fb}.date = g.date""",
        "probe_completion": f"""with {RAW},
trips as materialized (select 'C' || (number // 8) as corridor, sensor_uid as pi, strftime(ts, '%Y-%m-%d %H') as ti, user_id, speed from raw),
truth as (select corridor, pi, ti, avg(speed) as truth from trips group by all),
drawn as materialized (
  select * from trips cross join (select unnest([0, 1]) as trial) cross join (select unnest([0.3::double, 0.6::double]) as penetration)
  where cast('0x' || substr(md5(user_id || ':' || trial || ':0'), 1, 8) as bigint) / 4294967296.0::double < penetration),
seen as materialized (select corridor, penetration, trial, pi, ti, avg(speed) as v from drawn group by all),
{_low_rank("seen", "corridor, penetration, trial", "pi", "ti", rounds)},
probes as (select corridor, penetration, trial, count(distinct user_id) as n_probes from drawn group by all),
fit as (
  select g.corridor, g.penetration, g.trial, truth, v, mean + coalesce({fa}.f0 * {fb}.f0 + {fa}.f1 * {fb}.f1, 0) as guess
  from groups g join truth t on t.corridor = g.corridor left join seen s on s.corridor = g.corridor and s.penetration = g.penetration and s.trial = g.trial and s.pi = t.pi and s.ti = t.ti
  left join {fa} on {fa}.corridor = g.corridor and {fa}.penetration = g.penetration and {fa}.trial = g.trial and {fa}.pi = t.pi
  left join {fb} on {fb}.corridor = g.corridor and {fb}.penetration = g.penetration and {fb}.trial = g.trial and {fb}.ti = t.ti)
select corridor, penetration, cast(trial as integer) as trial, n_probes, count(v) as n_seen, count(*) filter (v is null) as n_unseen, round(count(v) / count(*), 6) as obs_frac,
  round(1 - avg((guess - truth) * (guess - truth)) filter (v is null) / nullif(var_pop(truth) filter (v is null), 0), 5) as r2, round(sqrt(avg((guess - truth) * (guess - truth)) filter (v is null)), 5) as rmse
from fit join probes using (corridor, penetration, trial) group by corridor, penetration, trial, n_probes""",
    }
