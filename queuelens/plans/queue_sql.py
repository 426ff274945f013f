"""DuckDB SQL of queues along the road, diagrams by sensor and regressions of discharge, written apart from their plans."""

import math

from queuelens.plans.audit_sql import HUBER
from queuelens.plans.oracles import EPISODES, EPISODES_BY_SENSOR, MU, STATES

_ROAD = """
road0 as (select corridor, sensor_uid, min(road_order) as road_order, min(length_mi) as length_mi from states group by all),
road as (
  select corridor, sensor_uid, length_mi, row_number() over w as place, coalesce(sum(length_mi) over (partition by corridor order by road_order, sensor_uid rows between unbounded preceding and 1 preceding), 0) as begin_mi
  from road0 window w as (partition by corridor order by road_order, sensor_uid))"""

#: The walk upstream is a recursion over places.
_TAILS = f"""recursive {EPISODES},{_ROAD},
sl as (
  select sensor_uid, date, period, row_number() over (partition by sensor_uid, date, period order by datetime) - 1 as idx, datetime
  from (select * from labelled union all select * replace ('MDPM' as period) from labelled where hour(datetime) between 10 and 19)),
ep as (
  select e.corridor, e.sensor_uid, e.date, e.period, a.datetime as t0, b.datetime as t2, c.datetime as t3, place, begin_mi
  from episodes e join road using (corridor, sensor_uid) join sl a on (e.sensor_uid, e.date, e.period, e.t0_index) = (a.sensor_uid, a.date, a.period, a.idx)
  join sl b on (e.sensor_uid, e.date, e.period, e.t2_index) = (b.sensor_uid, b.date, b.period, b.idx) join sl c on (e.sensor_uid, e.date, e.period, e.t3_index) = (c.sensor_uid, c.date, c.period, c.idx)
  where dc_existence),
there as (select corridor, place, begin_mi, datetime, speed_mph as v from states join road using (corridor, sensor_uid)),
walk as (
  select corridor, sensor_uid, date, period, t2, place, begin_mi as far_mi, 0 as steps, begin_mi from ep
  union all
  select w.corridor, w.sensor_uid, w.date, w.period, w.t2, w.place - 1, a.begin_mi, steps + 1, w.begin_mi
  from walk w join there a on a.corridor = w.corridor and a.datetime = w.t2 and a.place = w.place - 1 where a.v < 50),
tails as (select corridor, sensor_uid, date, period, max(steps) as n, arg_max(abs(round_even(begin_mi, 2) - round_even(far_mi, 2)), steps) as mi from walk group by all),
meets as (
  select e.corridor, e.sensor_uid, e.date, e.period, arg_min(u.period, (u.t0, u.period)) as meets
  from ep e join ep u on u.corridor = e.corridor and u.date = e.date and u.place = e.place - 1 and not (e.t3 < u.t0 or u.t3 < e.t0) group by all)"""

_LENGTHS = f"""{STATES},{_ROAD},
daily as (select distinct corridor, sensor_uid, strftime(datetime, '%Y-%m-%d') as date, begin_mi from states join road using (corridor, sensor_uid)),
near as (select *, lag(begin_mi) over w as b, lead(begin_mi) over w as a from daily window w as (partition by corridor, date order by begin_mi, sensor_uid)),
spaced as (select *, case when a is not null and b is not null then (a - b) / 2 when a is not null then a - begin_mi when b is not null then begin_mi - b else 0 end as spacing from near),
lengths as (
  select s.corridor, date, datetime, sum(case when speed_mph < 40 then spacing else 0 end) as queue_mi
  from states s join spaced p on s.sensor_uid = p.sensor_uid and strftime(datetime, '%Y-%m-%d') = p.date group by all)"""

_SHAPES = {
    "quadratic": "t * (l - t)",
    "cubic": "t * (l - t) * (l / 2 + 0.35 * l - t)",
    "quartic": "0.25 * t * t * (t - l) * (t - l)",
    "trapezoid": "greatest(0, least(t / greatest(0.25 * l, 1), 1, (l - t) / greatest(0.25 * l, 1)))",
}
#: The span is what lies between the islands of short queues around the longest one.
_SPANS = f"""{_LENGTHS},
numbered as (select *, row_number() over (partition by corridor, date order by datetime) as i, sum((queue_mi <= 0.3)::int) over (partition by corridor, date order by datetime) as island from lengths),
peaks as (select corridor, date, max(queue_mi) as peak, arg_max(island, (queue_mi, -i)) as island from numbered group by all having max(queue_mi) >= 1),
inside as (
  select n.*, peak, cast(row_number() over (partition by n.corridor, n.date order by i) - 1 as double) as t, cast(count(*) over (partition by n.corridor, n.date) - 1 as double) as l
  from numbered n join peaks p on p.corridor = n.corridor and p.date = n.date and p.island = n.island where queue_mi > 0.3)"""


def sql() -> dict[str, str]:
    m = repr(2 * math.log(2) / -math.log(0.7)) + "::double"
    shapes = ", ".join(f"sum(queue_mi * ({f})) / nullif(sum(({f}) * ({f})), 0) as a_{k}" for k, f in _SHAPES.items())
    errors = ", ".join(f"round(any_value(a_{k}), 7) as scale_{k}, round(case when any_value(a_{k}) is not null and var_pop(queue_mi) > 0 then 1 - sum(pow(queue_mi - a_{k} * ({f}), 2)) / (var_pop(queue_mi) * count(*)) end, 5) as r2_{k}" for k, f in _SHAPES.items())
    return {
        "mileposts": f"with {STATES},{_ROAD} select corridor, sensor_uid, place, begin_mi, round_even(begin_mi, 2) as milepost, length_mi from road",
        "queue_tails": f"""with {_TAILS}
select e.corridor, e.sensor_uid, e.date, e.period, e.place, e.t2 as t2_time, case when meets is null then 'Isolated' when n >= 1 then 'Spillback' else 'Overlap' end as relation, n as tail_sensors, round_even(mi, 1) as tail_mi, meets
from ep e join tails using (corridor, sensor_uid, date, period) left join meets using (corridor, sensor_uid, date, period)""",
        "queue_lengths": f"with {_LENGTHS} select corridor, date, datetime, round(queue_mi, 4) as queue_mi from lengths",
        "queue_span_fits": f"""with {_SPANS}, scaled as (select corridor, date, {shapes} from inside group by all)
select corridor, date, any_value(peak) as peak_mi, min(datetime) as begin, max(datetime) as end, count(*) as n, {errors} from inside join scaled using (corridor, date) group by all""",
        "episodes_by_sensor": f"""with {EPISODES_BY_SENSOR} select sensor_uid, corridor, date, period, t0_index, t2_index, t3_index, dc_existence, is_valid_for_mu, regime, discharge_start_idx, discharge_end_idx,
round(vc, 3) as v_c_mph, round(P_min, 3) as P_min, round(min_speed_mph, 3) as min_speed_mph, round(demand_veh, 3) as demand_veh, round(cong_mean_speed, 3) as cong_mean_speed from episodes""",
        "observed_diagrams": f"""with {STATES},
caps as (select *, 0.7::double * vf as vc from (select sensor_uid, quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) as vf, quantile_cont(flow_vph, 0.98) as cap from states group by 1)),
diagram as (select states.*, vf / pow(1 + pow(density_vpm / (cap / vc), {m}), 2 / {m}) as hat from states join caps using (sensor_uid) where speed_mph > 0 and density_vpm > 0),
r2s as (select sensor_uid, 1 - sum((speed_mph - hat) * (speed_mph - hat)) / (var_pop(speed_mph) * count(*)) as r2 from diagram group by 1)
select sensor_uid, round(vf, 4) as v_f_mph, round(cap, 4) as capacity_vphpl, round(vc, 4) as v_c_mph, round(cap / vc, 4) as k_critical_vpm, round({m}, 4) as s3_m, round(r2, 4) as r2 from caps left join r2s using (sensor_uid)""",
        "predicted_discharge": f"with recursive {MU}, {HUBER} select mode, n, round(b1, 4) as by_ratio, round(b2, 4) as by_hours, round(b0, 4) as intercept, round(s, 4) as scale, round(r2, 4) as r2 from huber",
        "chain_marginals": f"""with {STATES},{_ROAD},
c as (select r.*, first_value(r.sensor_uid) over (partition by r.corridor order by place) as chain, q, lag(q) over (partition by r.corridor order by place) as before, sum(length_mi) over (partition by r.corridor order by place) * 0.02 as x_to
  from road r join (select sensor_uid, avg(flow_vph * lanes) as q from states group by 1) using (sensor_uid))
select chain, sensor_uid as link_id, place as node, round(case when before is null then q else greatest(q - before, 0) end, 4) as "on", round(case when before is null then 0 else greatest(before - q, 0) end, 4) as off, round(x_to - length_mi * 0.02, 4) as x_from, round(x_to, 4) as x_to from c
union all select chain, null, max(place) + 1, 0, round(arg_max(q, place), 4), round(max(x_to), 4), round(max(x_to), 4) from c group by chain""",
    }
