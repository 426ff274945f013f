"""DuckDB SQL of stations day by day, written apart from their plans."""

from queuelens.plans.oracles import EPISODES, STATES
from queuelens.plans.weekday_sql import START

_DAYS = f"""{STATES},
seen as (
  select sensor_uid, strftime(datetime, '%Y-%m-%d') as date, (hour(datetime) * 60 + minute(datetime) - 660) // 5 as i, avg(speed_mph) as v, avg(flow_vph) as q from states
  where hour(datetime) >= 11 and hour(datetime) < 20 group by all),
grid as (select d.sensor_uid, d.date, g.i, v, q from (select distinct sensor_uid, date from seen) d cross join (select unnest(range(108)) as i) g left join seen s on s.sensor_uid = d.sensor_uid and s.date = d.date and s.i = g.i),
own as (select sensor_uid, 0.7::double * quantile_cont(v, 0.95) as v_co, quantile_cont(q, 0.98) as cap from grid group by 1),
g as (select *, count(v) over (partition by sensor_uid, date) as known, count(v) over (partition by sensor_uid, date order by i) as run from grid join own using (sensor_uid)),
r as (select *, count(*) filter (v is null) over (partition by sensor_uid, date, run) as gap from g where known >= 60),
w as (select sensor_uid, date, arg_min(i, (v, i)) filter (v is not null) as t2, min(v) as vt2 from r group by all),
b as (select r.sensor_uid, r.date, max(i) filter (i < t2) as lo, min(i) filter (i > t2) as hi from r join w using (sensor_uid, date) where v >= v_co or v is null and gap > 6 group by all),
days as (
  select r.sensor_uid, r.date, case when any_value(vt2) < any_value(v_co) then count(*) filter (i > coalesce(lo, -1) and i < coalesce(hi, 108)) * 5 / 60.0::double else 0.0::double end as P,
    case when any_value(vt2) < any_value(v_co) then coalesce(sum(q) filter (i > coalesce(lo, -1) and i < coalesce(hi, 108)), 0) * 5 / 60 / any_value(cap) end as DC, case when any_value(vt2) < any_value(v_co) then any_value(vt2) end as vt2,
    case when any_value(vt2) < any_value(v_co) then avg(v) filter (i > coalesce(lo, -1) and i < coalesce(hi, 108)) end as vbar,
    case when any_value(vt2) < any_value(v_co) then quantile_cont(q, 0.5) filter (i >= t2 and i < coalesce(hi, 108)) end as mu, any_value(v_co) as v_co, any_value(cap) as cap
  from r join w using (sensor_uid, date) left join b using (sensor_uid, date) group by all)"""


def sql() -> dict[str, str]:
    return {
        "period_accounting": f"""{START},
caps as (select sensor_uid as link_id, quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) as vf from states group by 1),
few as (select *, count(*) over (partition by link_id) as n from profiles where t_min >= 300 and t_min < 1320 and flow_pl is not null),
r as (select *, case when t_min < 600 then 'AM' when t_min < 840 then 'MD' when t_min < 1200 then 'PM' else 'NT' end as period, flow_pl * 0.25 * lanes * length as vmt from few join caps using (link_id) where n >= 8),
s as (select *, vmt / greatest(speed, 1) as vht, vmt / vf as free, vmt / (0.7::double * vf) as at_capacity from r)
select period, round(sum(vmt), 3) as vmt, round(sum(vht), 3) as vht, round(sum(free), 3) as vfftt, round(sum(greatest(vht - free, 0)), 3) as vdt, round(sum(greatest(vht - at_capacity, 0)), 3) as vcdt,
  round(sum(vmt) / sum(vht), 3) as avg_speed, round(sum(greatest(vht - free, 0)) / sum(vht) * 100, 3) as delay_share_pct from s group by 1""",
        "shape_predictions": f"""with {EPISODES},
tau as (select i, i * 0.01::double - 1 as t from (select unnest(range(201)) as i)),
phi as (
  select 'quartic_symmetric' as shape, i, greatest(0, least(1, 1 - pow(1 - t * t, 2))) as p from tau union all select 'quadratic_symmetric', i, greatest(0, least(1, t * t)) from tau
  union all select 'quadratic_early', i, greatest(0, least(1, case when t < 0 then t * t else pow(t, 1.5) end)) from tau),
means as (select shape, sum(case when i in (0, 200) then p / 2 else p end) / 200 as m from phi group by 1)
select sensor_uid, date, period, shape, round(m, 8) as phi_mean, round(min_speed_mph + (vf - min_speed_mph) * m, 5) as v_avg_pred, round(min_speed_mph, 5) as v_min_pred
from episodes join caps using (sensor_uid), means where dc_existence""",
        "day_statistics": f"with {_DAYS} select sensor_uid, date, round(P, 6) as P, round(DC, 5) as DC, round(vt2, 4) as vt2, round(vbar, 5) as vbar, round(mu, 4) as mu, round(v_co, 5) as v_co, round(cap, 5) as cap from days",
        "station_laws": f"""with {_DAYS},
c as (select *, v_co / vt2 - 1 as m from days where P > 0.25),
f as (
  select sensor_uid, count(*) as n_days, case when count(*) filter (DC > 0) >= 5 then exp(regr_intercept(ln(P), ln(DC)) filter (DC > 0)) end as f_d, case when count(*) filter (DC > 0) >= 5 then regr_slope(ln(P), ln(DC)) filter (DC > 0) end as n,
    case when count(*) filter (m > 0) >= 5 then exp(regr_intercept(ln(m), ln(P)) filter (m > 0)) end as f_p, case when count(*) filter (m > 0) >= 5 then regr_slope(ln(m), ln(P)) filter (m > 0) end as s, avg(vbar) / avg(vt2) as theta, var_pop(P) as var from c group by 1),
e as (select sensor_uid, avg(pow(f_d * pow(DC, n) - P, 2)) as rest from c join f using (sensor_uid) group by 1)
select sensor_uid, n_days, round(f_d, 5) as f_d, round(n, 5) as n, round(f_p, 5) as f_p, round(s, 5) as s, round(theta, 6) as theta, round(case when var > 0 then 1 - rest / var end, 4) as r2 from f join e using (sensor_uid)""",
        "anomaly_days": f"""with {STATES},
cells as (select corridor, sensor_uid, (hour(datetime) * 60 + minute(datetime)) // 5 as slot, strftime(datetime, '%Y-%m-%d') as date, avg(speed_mph) as v from states group by all),
grid as (
  select s.corridor, s.sensor_uid, t.slot, d.date from (select distinct corridor, sensor_uid from cells) s join (select distinct corridor, date from cells) d using (corridor) cross join (select unnest(range(288)) as slot) t),
filled as (
  select g.*, coalesce(c.v, m.mean, e.every) as v, isodow(cast(g.date as date)) > 5 as weekend from grid g left join cells c using (corridor, sensor_uid, slot, date)
  left join (select sensor_uid, slot, avg(v) as mean from cells group by all) m using (sensor_uid, slot) join (select corridor, avg(v) as every from cells group by 1) e using (corridor)),
rest as (select *, v - quantile_cont(v, 0.5) over (partition by sensor_uid, slot, weekend) as residual from filled),
cut as (select corridor, 4 / sqrt(count(distinct sensor_uid) * 288) as cut from cells group by 1)
select corridor, date, round(sum(greatest(-residual - cut, 0)), 3) as energy, count(*) filter (-residual - cut > 0) as n_cells from rest join cut using (corridor) group by all""",
    }
