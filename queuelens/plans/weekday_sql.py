"""DuckDB SQL of the average-weekday method, written apart from its Spark plans."""

from queuelens.plans.oracles import STATES

#: STATES has a table of five-minute bins of its own.
START = f"""with {STATES.replace("bins as (", "bins0 as (").replace("from bins)", "from bins0)")},
bins as (
  select sensor_uid as link_id, strftime(datetime, '%Y-%m-%d') as date, cast((hour(datetime) * 60 + minute(datetime)) // 15 * 15 as integer) as t_min, cast(min(isodow(datetime) - 1) as integer) as weekday,
    avg(speed_mph) as speed, avg(flow_vph) as flow_pl, min(length_mi) as length, min(lanes) as lanes from states group by all),
profiles as (select link_id, 'Weekday' as date, t_min, avg(speed) as speed, avg(flow_pl) as flow_pl, min(length) as length, min(lanes) as lanes from bins where weekday < 5 group by all)"""

_KNOWN = "known as (select *, flow_pl / speed as density from bins where speed > 0 and flow_pl > 0 and flow_pl / speed >= 1 and flow_pl / speed < 220)"

EPISODES = """
wide as (select *, count(*) over (partition by link_id, date) as n from bins where t_min >= 300 and t_min < 1320),
sm as (select *, avg(speed) over (partition by link_id, date order by t_min rows between 1 preceding and 1 following) as sm, row_number() over (partition by link_id, date order by t_min) - 1 as i from wide where n >= 8),
nb as (select *, lag(sm) over w as sb, lag(t_min) over w as tb, lead(sm) over w as sa, lead(t_min) over w as ta from sm window w as (partition by link_id, date order by t_min)),
isl as (select *, sum(case when sm >= 49 and coalesce(sa >= 49, true) then 1 else 0 end) over (partition by link_id, date order by t_min) as island from nb),
runs as (
  select link_id, date, island, min(i) as i0,
    coalesce(arg_min(case when tb is not null then tb + greatest(0, least(1, (49 - sb) / (sm - sb))) * (t_min - tb) else t_min end, i), 0)::double as t0,
    arg_max(case when ta is not null then t_min + greatest(0, least(1, (49 - sm) / (sa - sm))) * (ta - t_min) else t_min end, i)::double as t3,
    arg_min(t_min, (sm, i)) as t2, min(sm) as v from isl where sm < 49 group by all),
tagged as (select *, case when t2 >= 300 and t2 < 600 then 'AM' when t2 >= 600 and t2 < 840 then 'MD' when t2 >= 840 and t2 < 1200 then 'PM' end as period from runs),
kept as (select * from tagged where period is not null and (t3 - t0) / 60 >= 0.5),
days as (select link_id, date, sum(flow_pl * 0.25) as total, arg_min(t_min, (sm, t_min)) as tl, min(sm) as vl, avg(sm) as mean from sm group by all),
found as (
  select k.link_id, k.date, k.period, (t3 - t0) / 60 as P, sum(flow_pl * 0.25) as demand, any_value(v) as v_t2, any_value(t2) / 60.0 as t2, any_value(t0) / 60 as t0, any_value(t3) / 60 as t3, avg(sm) as mean
  from kept k join sm s on s.link_id = k.link_id and s.date = k.date and s.t_min between t0 and t3 group by k.link_id, k.date, k.period, k.i0, t0, t3),
congestion as (
  select f.link_id, f.date, period, P, demand, least(demand / 1900, 6.0) as DC, v_t2, t2, t0, t3, case when total > 0 then demand / total else 0 end as qdf, f.mean as cd_mean_speed, case when v_t2 > 0 then 49 / v_t2 - 1 else 0 end as magnitude
  from found f join days d using (link_id, date)
  union all select link_id, date, unnest(['AM', 'MD', 'PM']), 0, total, least(total / 1900, 6.0), vl, tl / 60.0, 0, 0, 1, mean, 0 from days where (link_id, date) not in (select (link_id, date) from kept))"""

_QUALITY = """
cq as (select *, 1.3 * DC as p_hat, 0.2 * pow(P, 1.3) as m_hat, 49 / (1 + 0.2 * pow(P, 1.3)) as v_hat, 49 / v_t2 - 1 as m from congestion where P > 0 and DC < 5.99),
quality as (
  select period, count(*) as n_episodes, count(distinct link_id) as n_links, round(greatest(-1, least(1, case when var_pop(P) > 0 then 1 - sum((P - p_hat) * (P - p_hat)) / (var_pop(P) * count(*)) end)), 3) as step1_r2,
    round(greatest(-1, least(1, case when var_pop(m) > 0 then 1 - sum((m - m_hat) * (m - m_hat)) / (var_pop(m) * count(*)) end)), 3) as step2_r2, round(avg(abs(P - p_hat)), 2) as p_mae_h, round(avg(abs((P - p_hat) / P)) * 100, 1) as p_mape,
    round(avg(abs(v_t2 - v_hat)), 1) as vt2_mae, round(avg(abs((v_t2 - v_hat) / v_t2)) * 100, 1) as vt2_mape, round(avg((abs(v_t2 - v_hat) <= 10)::int) * 100, 1) as vt2_within,
    round(avg(abs(t0 - (t2 - 0.5 * p_hat))) * 60, 1) as t0_mae_min, round(avg(abs(t3 - (t2 + 0.5 * p_hat))) * 60, 1) as t3_mae_min from cq group by period having count(*) >= 3)"""

_SERIES = """
pw as (select *, count(*) over (partition by link_id) as n from profiles where t_min >= 300 and t_min < 1320),
ps as (select link_id, t_min, speed as raw, avg(speed) over (partition by link_id order by t_min rows between 1 preceding and 1 following) as sm from pw where n >= 8),
fit as (select link_id, round(case when var_pop(raw) > 0 then 1 - sum((raw - sm) * (raw - sm)) / (var_pop(raw) * count(*)) end, 3) as smooth_r2, round(sqrt(avg((raw - sm) * (raw - sm))), 2) as smooth_rmse from ps group by 1),
dd as (select b.link_id, b.date, b.t_min, b.speed, ps.sm from bins b left join ps using (link_id, t_min) where b.weekday < 5 and b.t_min >= 300 and b.t_min < 1320 and b.link_id in (select link_id from ps)),
each_day as (select link_id, date, sqrt(avg((speed - sm) * (speed - sm))) as rmse, case when count(*) >= 2 and var_pop(speed) > 0 then 1 - sum((speed - sm) * (speed - sm)) / (var_pop(speed) * count(*)) end as r2 from dd group by all),
per_link as (select link_id, count(*) as n_weekdays, round(avg(rmse), 2) as day_rmse, round(avg(r2), 3) as day_r2 from each_day group by 1),
cvs as (select link_id, round(avg(cv), 3) as day_cv from (select link_id, t_min, stddev_samp(speed) / greatest(avg(speed), 1) as cv from dd group by all) group by 1),
series as (select * from fit join per_link using (link_id) join cvs using (link_id))"""


def sql() -> dict[str, str]:
    gates = [("n_links", "n_links", 5, 1), ("step1_r2", "step1_r2", 0.5, 1), ("step2_r2", "step2_r2", 0.3, 1), ("p_mape", "p_mape", 30, -1), ("vt2_mape", "vt2_mape", 30, -1), ("vt2_within", "vt2_within", 70, 1), ("smooth_r2_median", "smooth", 0.9, 1)]
    return {
        "weekday_profiles": f"{START} select link_id, t_min, round(speed, 4) as speed, round(flow_pl, 4) as flow_pl, round(avg(speed) over (partition by link_id order by t_min rows between 1 preceding and 1 following), 4) as sm from profiles",
        "outer_layers": f"""{START}, {_KNOWN},
w as (select *, count(*) over (partition by link_id) as n, greatest(1, cast(floor((max(speed) over (partition by link_id) - min(speed) over (partition by link_id)) / 20) as integer)) as width from known),
b as (select *, cast(floor(speed / width) as integer) as band from w where n >= 30),
q as (select *, quantile_cont(density, 0.9) over (partition by link_id, band) as q from b)
select link_id, band, round(avg(density) filter (density >= q), 4) as density, round(avg(speed), 4) as speed, round(max(density), 4) as most from q group by all""",
        "diagram_quality": f"""{START}, {_KNOWN}, m as (select *, 70 / pow(1 + pow(density / 35, 4), 0.5) as model from known)
select link_id, count(*) as n, round(case when var_pop(speed) > 0 then 1 - sum((speed - model) * (speed - model)) / (var_pop(speed) * count(*)) end, 6) as fd_r2 from m group by 1 having count(*) >= 30""",
        "weekday_congestion": f"{START}, {EPISODES} select link_id, date, period, round(P, 9) as P, round(demand, 7) as demand, round(DC, 9) as DC, round(v_t2, 9) as v_t2, round(t2, 9) as t2, round(t0, 9) as t0, round(t3, 9) as t3, round(qdf, 9) as qdf, round(cd_mean_speed, 9) as cd_mean_speed, round(magnitude, 9) as magnitude from congestion",
        "congested_days": f"""{START}, {EPISODES} select link_id, period, count(distinct date) as n_days, count(distinct date) filter (P > 0) as n_congested, round_even(count(distinct date) filter (P > 0) / count(distinct date) * 100, 0) as pct_congested,
round_even(coalesce(avg(P) filter (P > 0), 0), 2) as mean_P from congestion group by all""",
        "calibration_quality": f"{START}, {EPISODES}, {_QUALITY} select * from quality",
        "series_quality": f"{START}, {_SERIES} select * from series",
        "weekday_gates": f"{START}, {EPISODES}, {_QUALITY}, {_SERIES}, j as (select *, (select round(quantile_cont(smooth_r2, 0.5), 3) from series) as smooth from quality) "
        + " union all ".join(f"select period, '{g}' as gate, cast({c} as double) as value, {x}::double as threshold, coalesce({c} * {s} >= {x} * {s}, false) as passed from j" for g, c, x, s in gates),
        "whole_day_models": f"""{START},
w as (select *, case when t_min < 600 then 'AM' when t_min < 840 then 'MD' else 'PM' end as period, avg(speed) over (partition by link_id order by t_min rows between 1 preceding and 1 following) as sm from profiles where t_min >= 300 and t_min < 1320),
f as (select link_id, quantile_cont(speed, 0.99) as ff, min(t_min) as t0, max(t_min) as t9, arg_min(sm, t_min) as v0, arg_max(sm, t_min) as v9 from w group by 1),
p as (select link_id, period, count(*) filter (sm < 49) * 0.25 as hours, min(sm) as low, arg_min(t_min, (sm, t_min)) as at_low, arg_max(sm, t_min) as last, max(t_min) as ends from w group by all),
a as (
  select link_id, at_low as t, least(greatest(49 / (1 + 0.2 * pow(hours, 1.3)), 1), 49) as v, 1 as o from p where low < 49
  union all select p.link_id, least(t9, ends + 15), least(last, ff), 2 from p join f using (link_id)
  union all select link_id, t0, least(v0, ff), 0 from f union all select link_id, t9, least(v9, ff), 3 from f),
b as (select link_id, t, arg_min(v, (v, o)) as v from a group by all),
c as (select link_id, t, v, lead(t) over n as tn, lead(v) over n as vn from b window n as (partition by link_id order by t)),
m as (select w.link_id, w.t_min, ff, w.v + (coalesce(w.vn, w.v) - w.v) * x * x * (3 - 2 * x) as model from (select w.*, c.t, c.v, c.vn, case when tn is null then 0 else (w.t_min - c.t) / (tn - c.t) end as x from w join c on c.link_id = w.link_id and w.t_min >= c.t and (w.t_min < c.tn or c.tn is null)) w
  join f on f.link_id = w.link_id)
select link_id, t_min, round(least(greatest(model, 1), ff), 6) as model_speed from m""",
        "conserved_flows": f"""{START}, {EPISODES},
c as (select *, unnest(range(300, 1320, 15)) as minute from congestion where P > 0),
d as (select *, minute / 60.0 as t, least(greatest(t2, t0 + 1e-3), t3 - 1e-3) as tm, least(greatest(49 / (1 + 0.2 * pow(P, 1.3)), 1), 49) as low from c where minute between t0 * 60 and t3 * 60),
e as (select *, greatest(0, least(1, case when t <= tm then (t - t0) / (tm - t0) else (t3 - t) / (t3 - tm) end)) as x from d),
v as (select *, greatest(0, least(70, case when t >= t0 and t <= t3 then 49 - (49 - low) * x * x * (3 - 2 * x) when t < t0 then 70 - 21 * (t - 5) / greatest(0.01, t0 - 5) else 49 + 21 * (t - t3) / greatest(0.01, 22 - t3) end)) as speed from e),
g as (select *, speed * pow(greatest(pow(70 / greatest(speed, 1e-6), 3) - 1, 0), 1 / 6.0) as g from v),
h as (select *, case when sum(g) over w > 0 then demand / (0.25 * sum(g) over w) else 0 end as theta from g window w as (partition by link_id, date, period, t0))
select link_id, date, period, round(t0, 9) as t0, cast(minute as integer) as minute, round(theta, 6) as theta, round(theta * g, 6) as q,
round(least(greatest(0.080 - 0.0022 * least(greatest(speed, 3), 80) + 0.0000235 * least(greatest(speed, 3), 80) * least(greatest(speed, 3), 80), 0.02), 0.20) * 8887, 6) as co2_g_mi from h""",
        "queue_curves": f"""{START}, {EPISODES},
c as (select *, unnest(range(300, 1320, 15)) as minute from congestion where P > 0),
d as (select *, minute / 60.0 as t, least(greatest(t2, t0 + 1e-3), t3 - 1e-3) as tm, least(greatest(49 / (1 + 0.2 * pow(P, 1.3)), 1), 49) as low from c),
e as (select *, greatest(0, least(1, case when t <= tm then (t - t0) / (tm - t0) else (t3 - t) / (t3 - tm) end)) as x from d)
select link_id, date, period, round(t0, 9) as t0, cast(minute as integer) as minute, round(greatest(0, least(70, case when t >= t0 and t <= t3 then 49 - (49 - low) * x * x * (3 - 2 * x) when t < t0 then 70 - 21 * (t - 5) / greatest(0.01, t0 - 5) else 49 + 21 * (t - t3) / greatest(0.01, 22 - t3) end)), 8) as model_speed from e""",
    }
