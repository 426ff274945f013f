"""DuckDB SQL of what the average-weekday method hands on, written apart from its plans."""

from queuelens.plans.weekday_sql import EPISODES, START

#: Each sensor's own diagram, the cutoff being its critical speed; modelled speeds between anchors, as in whole_day_models.
_OWN = f"""{START},
own as (select corridor, sensor_uid as link_id, quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) as vf, quantile_cont(flow_vph, 0.98) as cap from states group by all),
net as (select *, 0.7::double * vf as cutoff, row_number() over (partition by corridor order by link_id) as node from own)"""

_MODEL = """
w as (select p.*, cutoff, case when t_min < 600 then 'AM' when t_min < 840 then 'MD' else 'PM' end as part, avg(speed) over (partition by link_id order by t_min rows between 1 preceding and 1 following) as sm,
  count(*) over (partition by link_id) as bins from profiles p join net using (link_id) where t_min >= 300 and t_min < 1320),
f as (select link_id, quantile_cont(speed, 0.99) as ff, min(t_min) as t0, max(t_min) as t9, arg_min(sm, t_min) as v0, arg_max(sm, t_min) as v9 from w group by 1),
p as (select link_id, part, any_value(cutoff) as co, count(*) filter (sm < cutoff) * 0.25 as hours, min(sm) as low, arg_min(t_min, (sm, t_min)) as at_low, arg_max(sm, t_min) as last, max(t_min) as ends from w group by all),
a as (
  select link_id, at_low as t, least(greatest(co / (1 + 0.2 * pow(hours, 1.3)), 1), co) as v, 1 as o from p where low < co
  union all select p.link_id, least(t9, ends + 15), least(last, ff), 2 from p join f using (link_id)
  union all select link_id, t0, least(v0, ff), 0 from f union all select link_id, t9, least(v9, ff), 3 from f),
b as (select link_id, t, arg_min(v, (v, o)) as v from a group by all),
c as (select link_id, t, v, lead(t) over n as tn, lead(v) over n as vn from b window n as (partition by link_id order by t)),
x as (select w.*, c.v, coalesce(c.vn, c.v) as vn, case when tn is null then 0 else (w.t_min - c.t) / (tn - c.t) end as x from w join c on c.link_id = w.link_id and w.t_min >= c.t and (w.t_min < c.tn or c.tn is null)),
tab as (
  select n.corridor, x.link_id, node, t_min, case when t_min < 600 then 'AM' when t_min < 840 then 'MD' when t_min < 1200 then 'PM' else 'NT' end as period, speed, sm, least(greatest(x.v + (vn - x.v) * x * x * (3 - 2 * x), 1), ff) as model,
    flow_pl * 0.25 as each, lanes, flow_pl * 0.25 * lanes as total, length, vf, n.cutoff, cap, flow_pl * 0.25 * lanes * length as miles, flow_pl * 0.25 * lanes * length / greatest(speed, 1) as hours
  from x join f using (link_id) join net n using (link_id) where bins >= 8)"""

_SHAPE = "{v} * pow(greatest(pow(vf / {v}, 2) - 1, 0), 0.25)"

_CONSERVED = f"""
slow as (select corridor, link_id, period, t_min, lanes, round(total, 1) as total, round(cap, 0) as cap, least(greatest(round(model, 2), 1e-6), vf) as v, vf from tab where round(model, 2) < round(cutoff, 1)),
d as (select corridor, link_id, period, count(*) as n, min(lanes) as lanes, any_value(vf) as vf, case when sum(total) > 0 then sum(total) / min(lanes) else any_value(cap) * count(*) * 0.25 end as demand,
  list({_SHAPE.format(v="v")} order by t_min) as gs, list(t_min order by t_min) as ts from slow group by all having count(*) >= 2),
th as (select corridor, sum(demand) / (0.25 * sum(list_sum(gs))) as theta from d group by 1),
pk as (select distinct vf, (select max({_SHAPE.format(v="(1e-6 + i / 399.0::double * (vf - 1e-6))")}) from range(400) t(i)) as peak from d),
e as (select d.*, theta, theta * peak as top from d join th using (corridor) join pk using (vf)),
h as (
  select link_id, period, 0 as k, -top as lo, top as hi from e
  union all select h.link_id, h.period, k + 1, case when low then (lo + hi) / 2 else lo end, case when low then hi else (lo + hi) / 2 end from (
    select h.*, list_sum(list_transform(gs, lambda g: least(greatest(theta * g + (lo + hi) / 2, 0), top))) < demand / 0.25 as low from h join e using (link_id, period) where k < 60) h),
z as (select e.*, (lo + hi) / 2 as slack from e join h using (link_id, period) where k = 60),
cons as (
  select link_id, unnest(ts) as t_min, unnest(list_transform(gs, lambda g: least(greatest(theta * g + slack, 0), top))) as q, lanes, theta, slack, abs(slack) / greatest(theta * list_sum(gs) / n, 1e-6) as deviation from z)"""


def _co2(v: str) -> str:
    v = f"least(greatest({v}, 3), 80)"
    return f"least(greatest(0.080 - 0.0022 * {v} + 0.0000235 * {v} * {v}, 0.02), 0.20) * 8887"


def sql() -> dict[str, str]:
    return {
        "handoff_table": f"""{_OWN.replace("with ", "with recursive ", 1)}, {_MODEL}, {_CONSERVED}
select corridor, link_id, node as from_node_id, node + 1 as to_node_id, t_min, period, round(speed, 2) as speed_raw, round(sm, 2) as speed_smoothed, round(model, 2) as speed_model, round(each, 1) as count_per_lane, t.lanes, round(total, 1) as count_total,
  round(length, 3) as length_mi, round(vf, 4) as free_flow, round(cutoff, 1) as cutoff, round(cap, 0) as capacity_vphpl, round(miles, 2) as vmt, round(hours, 3) as vht, round(greatest(hours - miles / vf, 0), 3) as vdt, round(greatest(hours - miles / cutoff, 0), 3) as vcdt,
  round({_co2("speed")} * miles, 1) as co2_g_observed, round({_co2("model")} * miles, 1) as co2_g_model,
  round(q, 1) as q_per_lane, round(q * 0.25 * c.lanes, 1) as count_conserved, round(theta, 3) as theta, round(slack, 2) as slack, round(deviation, 3) as deviation from tab t left join cons c using (link_id, t_min)""",
        "handoff_parameters": f"""{_OWN}, {EPISODES},
top as (select link_id, arg_min(period, (-P, period)) as dominant_period from congestion where P > 0 group by 1)
select corridor, link_id, node as from_node_id, node + 1 as to_node_id, dominant_period, case when dominant_period is not null then 1.3 end as f_d, case when dominant_period is not null then 1.0 end as n, case when dominant_period is not null then 0.2 end as f_p,
  case when dominant_period is not null then 1.3 end as s, case when dominant_period is not null then round(8 / 15 * 0.2 * pow(1.3, 1.3), 4) end as alpha, case when dominant_period is not null then 1.3 end as beta,
  round(vf, 4) as free_flow, round(cutoff, 1) as speed_at_capacity, round(0.7::double * vf, 1) as cutoff, round(cap, 0) as capacity_vphpl from net left join top using (link_id)""",
        "link_errors": f"""{START}, {EPISODES},
m as (select link_id, period, count(*) as n_cong, greatest(avg(P), 1e-3) as hours, avg(v_t2) as seen from congestion where P > 0 group by all),
e as (select *, least(greatest(49 / (1 + 0.2 * pow(hours, 1.3)), 1), 49) as model from m)
select link_id, period, n_cong, round(seen, 3) as vt2_observed, round(model, 3) as vt2_modelled, round(model - seen, 3) as vt2_error, round((model - seen) / greatest(seen, 1) * 100, 2) as vt2_error_pct from e""",
        "weekday_gammas": f"""{START}, {EPISODES},
m as (select link_id, period, cast(isodow(cast(date as date)) - 1 as integer) as weekday, avg(DC) as dc, least(avg(demand) / greatest(avg(P), 0.01), 1900) as mu from congestion where P > 0 group by all),
l as (select sensor_uid as link_id, min(length_mi) as length from states group by 1)
select link_id, period, weekday, round(dc, 4) as DC, round(1.3 * dc, 4) as P_est, round(49 / (1 + 0.2 * pow(1.3 * dc, 1.3)), 4) as vt2, round(49 / (1 + 8 / 15 * 0.2 * pow(1.3, 1.3) * pow(dc, 1.3)), 4) as vbar,
  round(64 * mu * (length / 49.5::double) * 0.2 * pow(greatest(1.3 * dc, 1e-3), 1.3 - 4), 3) as gamma from m join l using (link_id)""",
    }
