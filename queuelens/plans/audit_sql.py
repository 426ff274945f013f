"""DuckDB SQL of the audits, gates and direction checks, written apart from their Spark plans."""

import math

from queuelens.plans import oracles
from queuelens.plans.oracles import EPISODES, MU, QC, RANKING, RELIABILITY, STATES

_DROPS = f"""recursive {QC},
d as (
  select s.corridor, strftime(datetime, '%Y-%m-%d') as date, place - 1 as i, min((hour(datetime) * 60 + minute(datetime)) // 5) as drop
  from states s join places using (corridor, sensor_uid) where speed_mph < 50 group by all),
big as (select corridor, date from d group by all having count(*) >= 3),
m as (
  select d.*, min(drop) over (partition by corridor, date order by i range between 5 preceding and 5 following) as near, lag(i) over (partition by corridor, date order by i) as before
  from d join big using (corridor, date)),
low as (select * from m where drop <= near),
heads as (
  select corridor, date, min(i) as b from low group by all
  union all select h.corridor, h.date, min(l.i) from heads h join low l on l.corridor = h.corridor and l.date = h.date and l.i > h.b + 5 group by h.corridor, h.date, h.b),
segments as (select corridor, date, b, coalesce((lag(b) over (partition by corridor, date order by b) + b) // 2 + 1, 0) as upto from heads),
walk as (
  select s.corridor, s.date, s.b, s.upto, s.b as pos, m.drop as last, cast(null as boolean) as ok from segments s join m on m.corridor = s.corridor and m.date = s.date and m.i = s.b
  union all
  select w.corridor, w.date, w.b, w.upto, p.i, case when p.drop >= w.last - 1 then p.drop else w.last end, p.drop >= w.last - 1
  from walk w join m c on c.corridor = w.corridor and c.date = w.date and c.i = w.pos join m p on p.corridor = c.corridor and p.date = c.date and p.i = c.before and p.i >= w.upto),
totals as (select corridor, date, count(ok) as n_checked, count(*) filter (ok) as n_ok, coalesce(string_agg(distinct cast(pos as varchar), ',' order by cast(pos as varchar)) filter (ok = false), '') as reversed from walk group by all),
slopes as (select corridor, date, regr_slope(drop, i) as slope from m group by all),
first_heads as (select h.corridor, h.date, arg_min(h.b, m.drop * 10000 + h.b) as bottleneck from heads h join m on m.corridor = h.corridor and m.date = h.date and m.i = h.b group by all),
days as (
  select corridor, date, bottleneck, n_ok, n_checked, reversed, case when n_checked > 0 then n_ok / n_checked when slope > 1 then 0.0 end as confidence
  from totals join slopes using (corridor, date) join first_heads using (corridor, date))"""

_PANEL = f"""{MU},
panel as (
  select sensor_uid, date, period, P_min, min_speed_mph as v2, demand_veh, mu_obs, demand_veh / cap as doc, cap from episodes join caps using (sensor_uid) left join mu using (sensor_uid, date, period) where is_valid_for_mu)"""

_AUDIT = f"""{MU},
windows as (
  select sensor_uid, date, period, count(*) as n, quantile_cont(slots2.flow_vph, 0.5) as mu_obs, avg(speed_mph_clean) as mean_speed
  from (
    select sensor_uid, date, period, row_number() over (partition by sensor_uid, date, period order by datetime) - 1 as idx, flow_vph, speed_mph_clean
    from (select * from labelled union all select * replace ('MDPM' as period) from labelled where hour(datetime) between 10 and 19)) slots2
  join episodes using (sensor_uid, date, period) where is_valid_for_mu and idx between discharge_start_idx and discharge_end_idx group by all),
audited as (
  select e.sensor_uid, e.date, e.period, e.corridor, e.P_min, e.min_speed_mph as v2, e.t3_index, coalesce(w.n, 0) as n, w.mu_obs, w.mean_speed, c.cap, c.vc,
    least(least(mean_speed, 69.3) * 45 * pow(greatest(pow(greatest(70 / greatest(1, least(mean_speed, 69.3)), 1.00001), 2) - 1, 1e-8), 0.25), 2200.0) as mu_check
  from episodes e join caps c using (sensor_uid) left join windows w using (sensor_uid, date, period) where is_valid_for_mu),
consistent as (select *, case when mu_obs > 0 then abs(mu_obs - mu_check) / mu_obs end as consistency from audited)"""

#: Calibrated episodes with their round trip.
_TRIPS = f"""{EPISODES},
e0 as (select sensor_uid, corridor, date, period, t2_index, P_min / 60 as p, demand_veh, demand_veh / cap as d, min_speed_mph as v2, cap, vf from episodes join caps using (sensor_uid) where P_min > 0 and demand_veh > 0),
e1 as (select *, ln(p) / case when abs(ln(d)) < 1e-6 then case when ln(d) >= 0 then 1e-5 else -1e-5 end else ln(d) end as n0 from e0),
e2 as (select *, case when n0 < 1.001 then 1.124 else n0 end as nr, case when n0 < 1.001 then p / greatest(pow(d, 1.124), 1e-9) else 1.0 end as cdr,
  case when v2 > 0 then (50 / greatest(v2, 1e-4) - 1) / greatest(pow(p, 4), 1e-5) end as cpr, case when n0 < 1.001 then 'Q_n_below_1' else 'ok' end as status from e1),
e3 as (select *, case when nr between 1 and 1.5 then nr else 1.24 end as n, case when cdr between 0.5 and 2 then cdr else 1.0 end as cd, case when cpr between 0 and 2 then cpr else 0.2 end as cp from e2),
e4 as (select *, case when cd * pow(d, n) between 0 and 10 then cd * pow(d, n) else 0 end as ph, case when 8.0 / 15 * cp * pow(cd, 4) between 0.01 and 1 then 8.0 / 15 * cp * pow(cd, 4) else 0.27 end as alpha,
  case when n * 4 between 0.5 and 5 then n * 4 else 1.14 end as beta from e3),
e5 as (select *, 50 / greatest(cp * pow(ph, 4) + 1, 1e-3) as vh from e4),
trips as (select *, (ph - p) / p * 100 as p_err, case when v2 > 0 then (vh - v2) / greatest(v2, 1) * 100 end as v_err from e5)"""

_PROFILES = f"""{_TRIPS},
f0 as (select *, case when ph > 0.15 then least(cap, demand_veh / greatest(ph, 0.01)) else cap end as mu, 50 / (1 + alpha * pow(d, beta)) as vq, 8.0 as t2 from trips),
f1 as (select *, case when ph > 0.15 then (1.0 / greatest(vh, 1e-3) - 1.0 / 50) * 64 * mu / pow(greatest(ph, 1e-3), 4) else 0 end as gamma, greatest(0, t2 - greatest(p, ph) * 0.6) as a, least(24, t2 + greatest(p, ph) * 0.6) as b, t2 - ph / 2 as ta, t2 + ph / 2 as tb from f0),
f2 as (select *, greatest(1, cast(round_even((b - a) * 60 / 5, 0) as integer)) as steps from f1),
f3 as (select *, a + step * (b - a) / steps as t from (select *, unnest(range(0, steps + 1)) as step from f2)),
f4 as (select *, t >= ta and t <= tb and ph > 0.15 as queued, 0.25 * gamma * (t - ta) * (t - ta) * (t - tb) * (t - tb) as q, greatest(0, least(1, (t - a) / greatest(1e-3, ta - a))) as rise,
  greatest(0, least(1, (t - tb) / greatest(1e-3, b - tb))) as fall, greatest(50, vq) as edge from f3),
profiles as (select sensor_uid, date, period, step, t as hour, case when queued then 1 / greatest(q / greatest(mu, 1e-3) + 1.0 / 50, 1e-6) when t < ta then (1 - rise) * vf + rise * edge else (1 - fall) * edge + fall * vf end as td_speed_mph,
  case when queued then q else 0 end as td_queue_veh from f4)"""

_SEEN = f"""{_PROFILES},
seen as (
  select sensor_uid, date, period, hour(datetime) + minute(datetime) / 60.0 as clock, speed_mph_clean as v
  from (select * from labelled union all select * replace ('MDPM' as period) from labelled where hour(datetime) between 10 and 19)),
met as (
  select p.sensor_uid, p.date, p.period, step, any_value(td_speed_mph) as model, arg_min(v, round(abs(clock - hour), 9) * 1000 + clock / 1e6) filter (abs(clock - hour) <= 5 / 60.0 + 1e-6) as v
  from profiles p left join seen s on p.sensor_uid = s.sensor_uid and p.date = s.date and p.period = s.period and abs(clock - hour) <= 5 / 60.0 + 1e-6 group by all),
errors as (
  select sensor_uid, date, period, count(v) as n, avg(abs(model - v)) as mae, avg(abs(model - v) / greatest(v, 1)) * 100 as mape, sqrt(avg((model - v) * (model - v))) as rmse
  from (select sensor_uid, date, period, step, model, case when v > 1 then v end as v from met) group by all)"""


#: The Huber regressions of discharge rates, by the closed forms of their last set of linear residuals; after MU.
HUBER = """obs as (
  select mode, demand_veh / nullif(cap, 0) as x1, P_min / 60 as x2, case when mode = 'all_days' then coalesce(mu_obs, 0) else mu_obs end as y
  from episodes left join caps using (sensor_uid) left join mu using (sensor_uid, date, period), (select unnest(['valid_only', 'all_days']) as mode) where mode = 'all_days' or is_valid_for_mu),
known as (select * from obs where x1 is not null and x2 is not null and y is not null),
h(it, mode, n, b1, b2, b0, s) as (
  select 0, mode, count(*), 0.0::double, 0.0::double, avg(y), greatest(stddev_pop(y), 1e-12) from known group by mode having count(*) >= 10
  union all
  select it + 1, mode, n, (r1 * (c22 * c33 - c23 * c23) - c12 * (r2 * c33 - c23 * r3) + c13 * (r2 * c23 - c22 * r3)) / det, (c11 * (r2 * c33 - c23 * r3) - r1 * (c12 * c33 - c23 * c13) + c13 * (c12 * r3 - r2 * c13)) / det,
    (c11 * (c22 * r3 - r2 * c23) - c12 * (c12 * r3 - r2 * c13) + r1 * (c12 * c23 - c22 * c13)) / det, s
  from (
    select *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13) as det
    from (
      select it, mode, n, s, a11 + 1e-4 * s as c11, a12 as c12, a13 as c13, a22 + 1e-4 * s as c22, a23 as c23, a33 as c33, g1 + 1.35 * s * f1 as r1, g2 + 1.35 * s * f2 as r2, g3 + 1.35 * s * f3 as r3
      from (
        select it, mode, n, case when rss > 0 then greatest(sqrt(rss / greatest(n - far * 1.35 * 1.35, 1e-9)), 1e-12) else s / 2 end as s, a11, a12, a13, a22, a23, a33, g1, g2, g3, f1, f2, f3
        from (
          select it, mode, n, s, sum(w * x1 * x1) as a11, sum(w * x1 * x2) as a12, sum(w * x1) as a13, sum(w * x2 * x2) as a22, sum(w * x2) as a23, sum(w) as a33, sum(w * x1 * y) as g1, sum(w * x2 * y) as g2, sum(w * y) as g3,
            sum((1 - w) * sign(r) * x1) as f1, sum((1 - w) * sign(r) * x2) as f2, sum((1 - w) * sign(r)) as f3, sum(1 - w) as far, sum(w * r * r) as rss
          from (select h.*, x1, x2, y, y - b1 * x1 - b2 * x2 - b0 as r, case when abs(y - b1 * x1 - b2 * x2 - b0) <= 1.35 * s then 1.0::double else 0.0::double end as w from h join known using (mode) where it < 40)
          group by it, mode, n, s))))),
huber as (
  select mode, h.n, b1, b2, b0, s, 1 - sum((y - b1 * x1 - b2 * x2 - b0) * (y - b1 * x1 - b2 * x2 - b0)) / (var_pop(y) * count(*)) as r2
  from h join known using (mode) where it = 40 group by all)"""

_HELD = f"{STATES}, held as (select *, speed_mph as truth, (hour(datetime) + day(datetime)) % 5 = 0 as held, case when not ((hour(datetime) + day(datetime)) % 5 = 0) then speed_mph end as v from states)"
_SCORES = """select '{}' as engine, count(e) as n, round(avg(e), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, count(e) filter (truth < 45) as n_congested, round(avg(e) filter (truth < 45), 6) as mae_congested
from (select *, case when held then abs(guess - truth) end as e from g)"""


def sql() -> dict[str, str]:
    fits_sql = oracles.sql()["queue_fits"].removeprefix(f"with {EPISODES},\ne as (")
    fits_sql = "with e as (" + fits_sql
    band = "case when x is null then 'N/A' when {} then 'PASS' {} end"
    gates = [
        ("capacity_band", "(select quantile_cont(cap, 0.5) from consistent)", band.format("x between 1500 and 2300", "else 'REVIEW'")),
        ("mu_over_capacity", "(select quantile_cont(mu_obs / cap, 0.5) from consistent)", band.format("x between 0.85 and 0.98", "when x between 0.8 and 1.05 then 'REVIEW' else 'FAIL'")),
        ("vt2_below_vc", "(select count(*) from consistent where v2 >= vc)", band.format("x = 0", "when x <= 3 then 'REVIEW' else 'FAIL'")),
        ("mu_consistency", "(select quantile_cont(consistency, 0.5) from consistent)", band.format("x <= 0.10", "else 'REVIEW'")),
        ("groups_with_5_valid", "(select avg((c >= 5)::int) from (select count(*) as c from consistent group by sensor_uid, period))", band.format("x >= 0.5", "when x >= 0.3 then 'REVIEW' else 'FAIL'")),
        ("md_truncation", "(select avg((t3_index >= 71)::int) from consistent where period = 'MD')", band.format("x <= 0.2", "when x <= 0.35 then 'REVIEW' else 'FAIL'")),
        ("weekend_share", "(select avg((isodow(cast(date as date)) >= 6)::int) from consistent)", "case when x is null then 'N/A' else 'INFO' end"),
    ]
    found = {
        "state_tokens": f"""with {RANKING},
sl as (
  select sensor_uid, date, period, row_number() over (partition by sensor_uid, date, period order by datetime) - 1 as idx, datetime
  from (select sensor_uid, date, period, datetime from labelled union all select sensor_uid, date, 'MDPM', datetime from labelled where hour(datetime) between 10 and 19)),
ep as (
  select e.*, a.datetime as t1, b.datetime as t2, c.datetime as t3 from episodes e
  left join sl a on a.sensor_uid = e.sensor_uid and a.date = e.date and a.period = e.period and a.idx = e.t0_index
  left join sl b on b.sensor_uid = e.sensor_uid and b.date = e.date and b.period = e.period and b.idx = e.t2_index
  left join sl c on c.sensor_uid = e.sensor_uid and c.date = e.date and c.period = e.period and c.idx = e.t3_index where is_valid_for_mu),
rw as (select sensor_uid, date, datetime, speed_mph_clean as v, qc_pass, row_number() over w as i, coalesce(speed_mph_clean >= lead(speed_mph_clean) over w, false) as rises, count(*) over (partition by sensor_uid, date) as n
  from labelled window w as (partition by sensor_uid, date order by datetime)),
mk as (select ep.*, (select min(i) from rw where rw.sensor_uid = ep.sensor_uid and rw.date = ep.date and rw.datetime >= ep.t1) as i1, (select min(i) from rw where rw.sensor_uid = ep.sensor_uid and rw.date = ep.date and rw.datetime >= ep.t3) as i3 from ep),
ag as (
  select k.sensor_uid, k.date, k.period, max(i) filter (i < i1 and i >= i1 - 12 and not rises) as stop, min(i) filter (i >= i3 and not coalesce(v < 58.5, false)) as clear, any_value(n) as n, any_value(i1) as i1,
    sum(greatest(50 - v, 0)) filter (i >= i1 and i <= i3) as deficit, avg(qc_pass::int) as rate from mk k join rw using (sensor_uid, date) group by all),
cl as (select sensor_uid, bottleneck_class, row_number() over (partition by sensor_uid order by count(*) desc, bottleneck_class) as r from ranking group by 1, 2)
select k.sensor_uid, k.date, k.period, k.corridor as facility, case when isodow(cast(k.date as date)) >= 6 then 'weekend_surge' else 'weekday' end as day_regime, coalesce(c.bottleneck_class, 'unclassified') as bottleneck_class,
  p.datetime as T0_PRE_BREAKDOWN, t1 as T1_ONSET, t2 as T2_WORST_STATE, t3 as T3_RECOVERY, q.datetime as T4_RESIDUAL_CLEARANCE, P_min as congestion_duration_min, epoch(t3 - t2) / 60 as recovery_duration_min, min_speed_mph,
  round_even(coalesce(deficit, 0) * 5 / 60, 1) as speed_deficit_area_mph_h, case when rate >= 0.9 then 'high' when rate >= 0.7 then 'medium' else 'low' end as support_level,
  case when c.bottleneck_class in ('active_bottleneck', 'spillback_source') then 'supply' when isodow(cast(k.date as date)) >= 6 then 'demand' else 'uncertain' end as demand_supply_status,
  coalesce(nullif(concat_ws(',', case when regime = 'event' then 'CAUSE_INCIDENT' end, case when isodow(cast(k.date as date)) >= 6 then 'CAUSE_DEMAND_SURGE' end, case when c.bottleneck_class in ('active_bottleneck', 'spillback_source') then 'CAUSE_CAPACITY_DROP' end), ''), 'CAUSE_UNKNOWN') as likely_cause
from mk k join ag using (sensor_uid, date, period) left join cl c on c.sensor_uid = k.sensor_uid and c.r = 1
  join rw p on p.sensor_uid = k.sensor_uid and p.date = k.date and p.i = coalesce(ag.stop + 1, greatest(k.i1 - 12, 1)) join rw q on q.sensor_uid = k.sensor_uid and q.date = k.date and q.i = coalesce(ag.clear, ag.n)""",
        "shape_fits": f"""with {EPISODES},
sl as (select sensor_uid, date, period, row_number() over (partition by sensor_uid, date, period order by datetime) - 1 as idx, v from labelled),
r as (select sensor_uid, date, period, cast(idx - t0_index as double) as t, cast(t3_index - t0_index as double) as w, 50 - v as d from sl join episodes using (sensor_uid, date, period)
  where dc_existence and idx between t0_index and t3_index and v is not null),
f as (select *, t * (w - t) as f1, t * (w - t) * (0.85 * w - t) as f2, 0.25 * t * t * (t - w) * (t - w) as f3,
  greatest(0, least(least(t / greatest(0.25 * w, 1), 1), (w - t) / greatest(0.25 * w, 1))) as f4 from r),
g as (select sensor_uid, date, period, count(*) as points, sum(d * d) as dd, var_pop(d) * count(*) as ss, """ + ", ".join(f"sum(d * f{i}) as a{i}, sum(f{i} * f{i}) as b{i}" for i in range(1, 5)) + """ from f group by all having count(*) >= 6),
h as (select *, """ + ", ".join(f"case when ss > 0 and b{i} > 0 then round_even(1 - (dd - a{i} * a{i} / b{i}) / ss, 4) end as r{i}" for i in range(1, 5)) + """ from g)
select sensor_uid, date, period, points, r1 as newell_quadratic, r2 as paq_cubic, r3 as qvdf_quartic, r4 as trapezoid,
  list_max([{'r': coalesce(r1, -1e308), 'n': 'newell_quadratic'}, {'r': coalesce(r2, -1e308), 'n': 'paq_cubic'}, {'r': coalesce(r3, -1e308), 'n': 'qvdf_quartic'}, {'r': coalesce(r4, -1e308), 'n': 'trapezoid'}]).n as winner from h""",
        "persistence_scores": f"""with {_HELD},
k as (select *, epoch(datetime) as t, case when v is not null then epoch(datetime) end as tk from held),
w as (select *, last_value(v ignore nulls) over b as v0, last_value(tk ignore nulls) over b as t0, first_value(v ignore nulls) over a as v1, first_value(tk ignore nulls) over a as t1 from k
  window b as (partition by sensor_uid, cast(datetime as date) order by datetime rows between unbounded preceding and current row), a as (partition by sensor_uid, cast(datetime as date) order by datetime rows between current row and unbounded following)),
g as (select *, coalesce(case when t1 <> t0 then v0 + (v1 - v0) * (t - t0) / (t1 - t0) end, v1, v0) as guess from w)
{_SCORES.format("persistence")}""",
        "time_of_day_scores": f"with {_HELD}, g as (select *, avg(v) over (partition by sensor_uid, (hour(datetime) * 60 + minute(datetime)) // 5) as guess from held) {_SCORES.format('tod_profile')}",
        "borrowed_diagrams": f"with {STATES} select sensor_uid, round(case when count(speed_mph) >= 20 then quantile_cont(speed_mph, 0.95) else 65 end, 6) as v_f_mph, count(speed_mph) as n, 50.0::double as v_c_mph, 2000.0::double as capacity_vphpl, 'speed_only_borrow' as model from states group by 1",
        "direction_days": f"with {_DROPS} select corridor, date, cast(bottleneck as integer) as bottleneck, cast(n_ok as integer) as n_ok, cast(n_checked as integer) as n_checked, reversed, round(confidence, 6) as confidence from days",
        "direction_check": f"""with {_DROPS},
modes as (select corridor, bottleneck, row_number() over (partition by corridor order by count(*) desc, bottleneck) as r from days group by corridor, bottleneck)
select corridor, round(quantile_cont(confidence, 0.5), 6) as direction_confidence, cast(case when count(confidence) > 0 then any_value(m.bottleneck) end as integer) as bottleneck, count(confidence) as n_days
from days join (select corridor, bottleneck from modes where r = 1) m using (corridor) group by corridor""",
        "s3_priors": f"""with {STATES}, v as (select sensor_uid, case when count(*) filter (speed_mph > 0) >= 200 then quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) end as seen from states group by 1),
w as (select *, coalesce(seen, 75.0) as vf from v)
select sensor_uid, round(vf, 6) as vf_mph, round(1900 / (0.7 * vf), 6) as k_critical_vpm, round(2 * ln(2) / ln(vf / (0.7 * vf)), 6) as s3_m, 1900.0::double as lane_capacity_vphpl,
case when seen is not null then 'vf calibrated | ' else '' end || 'k_c and m rederived' as changes from w""",
        "episode_flags": f"""with {_PANEL},
f as (select *, coalesce(doc > 1 and P_min < 15, false) as a, coalesce(doc < 0.5 and P_min > 60, false) as b, coalesce(mu_obs > 1.05 * cap, false) as c, coalesce(doc > 1.5 and mu_obs < 0.3 * cap, false) as d,
  coalesce(v2 >= 50, false) as e, coalesce(v2 < 5, false) as g from panel)
select sensor_uid, date, period, round(doc, 6) as D_over_C_hours, a::int + b::int + c::int + d::int + e::int + g::int as outlier_n_flags, a or b or c or d or e or g as is_outlier,
concat_ws(';', case when a then 'doc_high_P_zero' end, case when b then 'doc_low_P_high' end, case when c then 'mu_above_capacity' end, case when d then 'mu_starved' end, case when e then 'vt2_above_vc' end, case when g then 'vt2_too_low' end) as outlier_reasons from f""",
        "episode_residual_flags": f"""with recursive {_PANEL},
pairs as (
  select sensor_uid, date, period, unnest([
    {{'rule': 'doc_P', 'x': ln(greatest(doc, 1e-6)), 'y': ln(greatest(P_min / 60, 1e-6))}}, {{'rule': 'doc_mu', 'x': doc, 'y': mu_obs}}, {{'rule': 'P_vt2', 'x': ln(greatest(P_min / 60, 1e-6)), 'y': ln(greatest(v2, 1e-6))}}], recursive := true) from panel),
known as (select * from pairs where x is not null and y is not null),
h(it, rule, n, b1, b0, s) as (
  select 0, rule, count(*), 0.0::double, avg(y), greatest(stddev_pop(y), 1e-12) from known group by rule having count(*) >= 8
  union all
  select it + 1, rule, n, (r1 * a22 - a12 * r2) / (c11 * a22 - a12 * a12), (c11 * r2 - a12 * r1) / (c11 * a22 - a12 * a12), s
  from (
    select it, rule, n, s, a11 + 1e-4 * s as c11, a12, a22, g1 + 1.35 * s * f1 as r1, g2 + 1.35 * s * f2 as r2
    from (
      select it, rule, n, case when rss > 0 then greatest(sqrt(rss / greatest(n - far * 1.35 * 1.35, 1e-9)), 1e-12) else s / 2 end as s, a11, a12, a22, g1, g2, f1, f2
      from (
        select it, rule, n, s, sum(w * x * x) as a11, sum(w * x) as a12, sum(w) as a22, sum(w * x * y) as g1, sum(w * y) as g2, sum((1 - w) * sign(r) * x) as f1, sum((1 - w) * sign(r)) as f2, sum(1 - w) as far, sum(w * r * r) as rss
        from (select h.*, k.x, k.y, y - b1 * x - b0 as r, case when abs(y - b1 * x - b0) <= 1.35 * s then 1 else 0 end as w from h join known k using (rule) where it < 40) group by it, rule, n, s)))),
rest as (select known.*, y - b1 * x - b0 as r from known join h using (rule) where it = 40),
mads as (select rule, quantile_cont(abs(r - m), 0.5) * 1.4826::double as mad from rest join (select rule, quantile_cont(r, 0.5) as m from rest group by 1) using (rule) group by 1),
far as (select sensor_uid, date, period, bool_or(rule = 'doc_P') as u, bool_or(rule = 'doc_mu') as v, bool_or(rule = 'P_vt2') as w from rest join mads using (rule) where mad > 0 and abs(r) > 3 * mad group by all),
f as (select panel.*, coalesce(doc > 1 and P_min < 15, false) as a, coalesce(doc < 0.5 and P_min > 60, false) as b, coalesce(mu_obs > 1.05 * cap, false) as c, coalesce(doc > 1.5 and mu_obs < 0.3 * cap, false) as d,
  coalesce(v2 >= 50, false) as e, coalesce(v2 < 5, false) as g, coalesce(u, false) as u, coalesce(v, false) as v, coalesce(w, false) as w from panel left join far using (sensor_uid, date, period))
select sensor_uid, date, period, a::int + b::int + c::int + d::int + e::int + g::int + u::int + v::int + w::int as outlier_n_flags, a or b or c or d or e or g or u or v or w as is_outlier,
concat_ws(';', case when a then 'doc_high_P_zero' end, case when b then 'doc_low_P_high' end, case when c then 'mu_above_capacity' end, case when d then 'mu_starved' end, case when e then 'vt2_above_vc' end, case when g then 'vt2_too_low' end,
  case when u then 'huber_resid_doc_P' end, case when v then 'huber_resid_doc_mu' end, case when w then 'huber_resid_P_vt2' end) as outlier_reasons from f""",
        "episode_audit": f"""with {_AUDIT} select sensor_uid, date, period, n as discharge_n_intervals, n * 5.0 as discharge_duration_min, round(mu_obs, 4) as mu_obs_vphpl, round(mu_check, 4) as mu_check_vphpl, round(consistency, 6) as mu_consistency from consistent""",
        "run_gates": f"with {_AUDIT} " + " union all ".join(f"select '{g}' as gate, round(cast(x as double), 6) as value, {s} as status from (select {v} as x)" for g, v, s in gates),
        "round_trips": f"with {_TRIPS} select sensor_uid, date, period, round(ph - p, 6) + 0.0 as P_err_hours, round(p_err, 5) + 0.0 as P_err_pct, round(vh - v2, 6) + 0.0 as vt2_err_mph, round(v_err, 5) + 0.0 as vt2_err_pct from trips",
        "queue_profiles": f"with {_PROFILES} select sensor_uid, date, period, cast(step as integer) as step, round(hour, 6) as hour, round(td_speed_mph, 5) as td_speed_mph, round(td_queue_veh, 5) as td_queue_veh from profiles",
        "speed_errors": f"with {_SEEN} select sensor_uid, date, period, case when n >= 3 then round(mae, 4) end as v_t_MAE, case when n >= 3 then round(mape, 4) end as v_t_MAPE_pct, case when n >= 3 then round(rmse, 4) end as v_t_RMSE, n as v_t_n from errors",
        "trip_gates": f"""with {_SEEN},
g as (
  select period, 'roundtrip_P_err_pct' as gate, quantile_cont(abs(p_err), 0.5) as x, 1.0 as good, cast(null as double) as fair from trips group by 1
  union all select period, 'roundtrip_vt2_err_pct', quantile_cont(abs(v_err), 0.5), 1.0, null from trips group by 1
  union all select period, 'vt_speed_MAE', quantile_cont(mae, 0.5), 10.0, 15.0 from errors where n >= 3 group by 1
  union all select 'all', 'calibration_not_ok_share', avg((status <> 'ok')::int), 0.25, 0.40 from trips)
select period, gate, round(x, 5) as value, case when x is null then 'N/A' when x <= good then 'PASS' when x <= fair then 'REVIEW' else 'FAIL' end as status from g""",
        "corridor_parameters": f"""with {_TRIPS},
s as (select corridor, period, sensor_uid, date, unnest([{{'p': 'Q_n', 'v': n, 'r': 1.24}}, {{'p': 'Q_s', 'v': 4.0, 'r': 1.0}}, {{'p': 'Q_cd', 'v': cd, 'r': 1.0}}, {{'p': 'Q_cp', 'v': cp, 'r': 0.2}}, {{'p': 'Q_alpha', 'v': alpha, 'r': 0.27}}, {{'p': 'Q_beta', 'v': beta, 'r': 1.14}}]) as u
  from trips where status = 'ok'),
t as (select corridor, period, u.p as parameter, count(*) as n, count(distinct sensor_uid) as ns, count(distinct date) as nd, quantile_cont(u.v, 0.5) as med, quantile_cont(u.v, 0.75) - quantile_cont(u.v, 0.25) as iqr, any_value(u.r) as prior from s group by all),
w as (select *, n / (n + 5.0) as alpha, n / (n + 5.0) * med + (1 - n / (n + 5.0)) * prior as raw from t)
select corridor, period, parameter, n as n_episodes_used, ns as n_distinct_sensors, nd as n_distinct_dates, n as n_values, round(med, 6) as median, case when n >= 4 then round(iqr, 6) end as iqr, round(alpha, 6) as alpha_shrinkage, prior::double as prior,
round(case when parameter = 'Q_n' and raw not between 1 and 1.5 or parameter = 'Q_s' and raw not between 0.5 and 4 or parameter = 'Q_cd' and raw not between 0.5 and 2 or parameter = 'Q_cp' and raw not between 0 and 2
  or parameter = 'Q_alpha' and raw not between 0.01 and 1 or parameter = 'Q_beta' and raw not between 0.5 and 5 then prior else raw end, 6) as shrunk,
case when alpha >= 0.7 then 'self' else 'shrunk' end as source, case when n >= 20 then 'high' when n >= 10 then 'medium' when n >= 5 then 'low' else 'not_reliable' end as reliability_class, n < 5 as flag_low_sample from w""",
        "pipeline_gates": f"""with {_DROPS.replace(QC, MU)},
{HUBER},
diagram as (select states.*, vf / pow(1 + pow(density_vpm / (cap / vc), {2 * math.log(2) / -math.log(0.7)!r}::double), 2 / {2 * math.log(2) / -math.log(0.7)!r}::double) as hat from states join caps using (sensor_uid) where speed_mph > 0 and density_vpm > 0),
r2s as (select sensor_uid, 1 - sum((speed_mph - hat) * (speed_mph - hat)) / (var_pop(speed_mph) * count(*)) as r2 from diagram group by 1),
fitted as ({fits_sql}),
v(gate, value, threshold) as (
  select 'qc_pass_rate', (select avg(qc_pass::int) from passed), 0.85 union all select 'direction_confidence', (select quantile_cont(confidence, 0.5) from days), 0.50
  union all select 'valid_episode_pct', (select count(*) filter (is_valid_for_mu) / greatest(count(*), 1) from episodes), 0.05 union all select 'fd_r2', (select quantile_cont(r2, 0.5) from r2s), 0.70 union all select 'mu_r2_gap', (select max(r2) filter (mode = 'valid_only') - max(r2) filter (mode = 'all_days') from huber), 0.10
  union all select 'qvdf_n_fitted', (select count(f_d) from fitted), 5.0),
s as (select gate, round(cast(value as double), 6) as value, cast(threshold as double) as threshold, case when value is null then 'UNKNOWN' when value >= threshold then 'PASS' else 'FAIL' end as status from v)
select * from s union all select '__overall__', null, null, case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status = 'PASS') then 'PASS' else 'INCONCLUSIVE' end from s""",
        "episode_gates": f"with {_AUDIT} " + " union all ".join(f"select '{g}' as gate, round(cast(x as double), 6) as value, {s} as status from (select {v.replace('v2 >= vc', 'v2 >= 50')} as x)" for g, v, s in gates if g not in ("mu_consistency", "weekend_share")),
    }
    text, m = oracles.sql()["text_issues"], repr(2 * math.log(2) / -math.log(0.7)) + "::double"
    weight = "case source when 'dot_feed' then 0.25 when 'news' then 0.15 when 'document' then 0.15 when 'web' then 0.1 else 0.0 end"
    graph = f"""tok as ({found["state_tokens"]}),
few as (
  select sensor_uid, period, facility, count(*) as n, min(bottleneck_class) as cls, quantile_cont(congestion_duration_min, 0.5) as minutes, quantile_cont(min_speed_mph, 0.5) as speed, avg(case support_level when 'high' then 0.85::double when 'medium' then 0.7::double else 0.45::double end) as conf
  from tok where not contains(likely_cause, 'CAUSE_INCIDENT') group by all),
found as (
  select sensor_uid, period, 0 as k, '' as date, 'recurring_bottleneck' as type, facility as corridor, period as time_window, round_even(conf, 2) as confidence, case when minutes >= 120 then 'high' else 'medium' end as severity,
    'episodes=' || n || ';median_minutes=' || cast(round_even(minutes, 0) as bigint) || ';class=' || cls || ';median_min_speed=' || cast(round_even(speed, 0) as bigint) as evidence, 'CALIBRATION_TARGET;SCENARIO_COMPARISON_TARGET' as recommended_token
  from few where n >= 2 and cls in ('active_bottleneck', 'spillback_source')
  union all select sensor_uid, period, 1, date, 'incident_pattern_day', facility, date || ' ' || period, 0.6, 'low', 'duration_outlier;minutes=' || cast(round_even(congestion_duration_min, 0) as bigint), 'EXCLUDE_FROM_RECURRING_CALIBRATION'
  from tok where contains(likely_cause, 'CAUSE_INCIDENT')),
bad as (
  with {STATES},
  caps as (select sensor_uid, min(corridor) as corridor, quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) as vf, quantile_cont(flow_vph, 0.98) as cap from states group by 1),
  diagram as (select s.*, vf / pow(1 + pow(density_vpm / (cap / (0.7::double * vf)), {m}), 2 / {m}) as hat from states s join caps using (sensor_uid) where speed_mph > 0 and density_vpm > 0),
  r2s as (select sensor_uid, 1 - sum((speed_mph - hat) * (speed_mph - hat)) / (var_pop(speed_mph) * count(*)) as r2 from diagram group by 1)
  select sensor_uid, corridor, cap, r2 from caps join r2s using (sensor_uid) where not (r2 > 0 and cap between 1200 and 2600 and vf between 40 and 90)),
ordered as (
  select 0 as part, * from found
  union all select 1, sensor_uid, '', 0, '', 'fd_fit_implausible', corridor, null, 0.85, 'medium', 'capacity=' || cast(round_even(cap, 0) as bigint) || ';r2=' || cast(round_even(r2, 3) as varchar), 'REVIEW_DETECTOR_DATA;EXCLUDE_FROM_FD_POOL' from bad),
graph as (select 'I-' || lpad(cast(row_number() over (order by part, sensor_uid, period, k, date) as varchar), 3, '0') as issue_id, * exclude (part, period, k, date) from ordered)"""
    mid = "round_even(quantile_cont({}, 0.5), 1)"
    found["run_comparison"] = f"""with {_AUDIT},
ref as (
  with {_AUDIT.replace(EPISODES, oracles.EPISODES_BY_SENSOR)}
  select period, count(*) as ref_n_valid, {mid.format("P_min")} as "ref_P_min_median", {mid.format("v2")} as ref_v_t2_median, {mid.format("mu_obs")} as ref_mu_median from consistent group by 1)
select c.*, ref.* exclude (period) from (select period, count(*) as n_valid, {mid.format("P_min")} as "P_min_median", {mid.format("v2")} as v_t2_median, {mid.format("mu_obs")} as mu_median, {mid.format("cap")} as capacity_median from consistent group by 1) c left join ref using (period)"""
    found["issues"] = f"with {graph} select issue_id, type, corridor, sensor_uid, time_window, confidence::double as confidence, severity, evidence, recommended_token, 'open' as status from graph"
    found["corroborated_reports"] = f"""with {graph}, rep as ({text}),
more as (
  select r.doc_id, r.issue_id, r.type, r.corridor, round_even(least(0.35 + 0.1 * least(n_cues, 3) + case when regexp_matches(text, '(?i)\\b(I|US|SR|AZ|CA|Loop)[- ]?([0-9]{{1,3}})\\b') then 0.15 else 0 end + case when milepost is not null then 0.05 else 0 end + {weight}, 0.85), 2)::double as conf,
    upper(regexp_extract(text, '(?i)\\b(northbound|southbound|eastbound|westbound|NB|SB|EB|WB)\\b', 1)) as dir, nullif(regexp_extract(text, '(?i)\\b([0-9]{{1,2}})(?::([0-9]{{2}}))?\\s?(a\\.?m\\.?|p\\.?m\\.?)\\b', 0), '') as time_mention
  from rep r join documents using (doc_id)),
backing as (select 'I' || corridor[2:] || '5' as name, min(issue_id) as hit from graph where type in ('recurring_bottleneck', 'unreliable_segment_lottr') group by 1),
met as (select m.*, (select min(hit) from backing b where m.corridor is not null and replace(upper(m.corridor), '-', '') <> '' and contains(b.name, replace(upper(m.corridor), '-', ''))) as hit from more m)
select doc_id, issue_id, type, corridor, case when dir = '' then null when length(dir) > 2 then dir[1] || 'B' else dir end as direction, time_mention,
  case when hit is not null and type in ('recurring_congestion_report', 'capacity_event_report') then round_even(least(conf + 0.15, 0.9), 2) else conf end as confidence, hit as corroborates, hit is null as needs_detector_check from met"""
    return found
