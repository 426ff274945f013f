"""DuckDB SQL with the same results as the registered queries, written apart from them."""

RAW = """
reports as (
  select user_id // 7 as number, ts - to_days(cast(d - d // 3 as integer)) + to_minutes(cast(5 * step as integer)) as ts, value, event_id, step, user_id
  from (select *, date_diff('day', date '2024-01-01', cast(ts as date)) as d from events), (select unnest(range(12)) as step)),
moments as (
  select *, number // 8 as corridor, number % 8 as place, hour(ts) + minute(ts) / 60.0::double as h, isodow(ts) > 5 as weekend, cast(30 + number % 4 * 3 as double) as kc,
    cast(0.06 as double) * least(value, 140.0) + (event_id * 7 + step * 5) % 11 * cast(0.3 as double) as noise from reports),
queues as (
  select *, case when weekend or place > 5 then 0.0::double else (corridor + day(ts)) % 6 * 0.4::double - (5 - place) * 0.2::double end as am, 8.0::double + (5 - place) * 0.1::double as am_at,
    case when place > 6 then 0.0::double else (corridor * 2 + day(ts) * 3) % 8 * case when weekend then 0.3::double else 0.5::double end - (6 - place) * 0.3::double end as pm, 17.0::double + (6 - place) * 0.1::double as pm_at from moments),
falls as (
  select *, case when am > 0 and abs(h - am_at) < am then 36.0::double * (1 - ((h - am_at) / am) * ((h - am_at) / am)) else 0.0::double end
    + case when pm > 0 and abs(h - pm_at) < pm then 42.0::double * (1 - ((h - pm_at) / pm) * ((h - pm_at) / pm)) else 0.0::double end as fall from queues),
speeds as (select *, 70.0::double - fall - noise as speed from falls),
raw as (
  select 'S' || lpad(cast(number as varchar), 4, '0') as sensor_uid, number, ts, speed, user_id,
    case when fall > 18 then kc * 70 / sqrt(2) * (1.0::double - 0.01::double * (h - case when h < 12 then 4.0::double else 12.0::double end))
      else least(least(speed, 0.99::double * 70) * kc * pow(greatest(pow(greatest(70.0::double / greatest(1, least(speed, 0.99::double * 70)), 1.00001::double), 2.0) - 1, 1e-8), 0.25), kc * 70 / sqrt(2)) end
      * (0.92::double + event_id % 11 / 100.0::double) as flow
  from speeds)"""
STATES = f"""{RAW},
bins as (
  select sensor_uid, number, time_bucket(interval 5 minutes, ts) as datetime, round(quantile_cont(speed, 0.5) * 1024) / 1024 + 0.000132170713::double as speed_mph,
    round(quantile_cont(flow, 0.5) * 8) / 8 + 0.03713217::double as flow_vph, count(*) as n_readings
  from raw group by all),
states as (
  select sensor_uid, datetime, speed_mph, flow_vph, flow_vph / speed_mph as density_vpm, cast(2 + number % 3 as double) as lanes,
    0.5 + 0.25 * (number % 5) as length_mi, cast(number % 8 as double) as road_order, 'C' || cast(number // 8 as varchar) as corridor
  from bins)"""
QC = f"""{STATES},
h1 as (
  select *, quantile_cont(speed_mph, 0.5) over (partition by sensor_uid order by datetime rows between 5 preceding and 5 following) as med,
    lag(speed_mph) over (partition by sensor_uid order by datetime) as prev, row_number() over (partition by sensor_uid order by datetime) as rn
  from states),
h2 as (select *, abs(speed_mph - med) as dev from h1),
h3 as (select *, 1.4826 * quantile_cont(dev, 0.5) over (partition by sensor_uid order by datetime rows between 5 preceding and 5 following) as mad from h2),
h4 as (select *, coalesce(nullif(mad, 0), quantile_cont(mad, 0.5) over (partition by sensor_uid), 1.0) as mad2 from h3),
caps as (
  select *, 0.7::double * vf as vc from (
    select sensor_uid, quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) as vf, quantile_cont(flow_vph, 0.98) as cap from states group by 1)),
places as (
  select corridor, sensor_uid, row_number() over (partition by corridor order by road_order, sensor_uid) as place, count(*) over (partition by corridor) as n_places
  from (select distinct corridor, sensor_uid, road_order from states)),
h5 as (
  select h4.*, place, n_places, quantile_cont(speed_mph, 0.5) over (partition by corridor, datetime order by place range between 1 preceding and 1 following) as near
  from h4 join places using (corridor, sensor_uid)),
qc as (
  select *, coalesce(speed_mph between 0 and 90, false) as qc_hard_range,
    case when rn = 1 then speed_mph is not null else coalesce(abs(speed_mph - prev) <= 30, false) end as qc_jump,
    coalesce(dev <= 3 * mad2, false) as qc_hampel,
    not coalesce(place > 1 and place < n_places and abs(speed_mph - near) > 20, false) as qc_spatial,
    case when coalesce(dev <= 3 * mad2, false) then speed_mph else med end as speed_mph_clean
  from h5),
passed as (select *, qc_hard_range and qc_jump and qc_hampel and qc_spatial as qc_pass from qc)"""


def _classified(name: str, source: str) -> str:
    """CTEs that classify the rows of ``source``: one row in ``name`` for each sensor, date and period."""
    return f"""
{name}_i as (select *, row_number() over (partition by sensor_uid, date, period order by datetime) - 1 as idx, count(*) over (partition by sensor_uid, date, period) as n_bins from {source}),
{name}_f as (
  select *, coalesce(v > 50, false) as hi, v is null as gap, coalesce(v <= 50, false) as low from {name}_i where n_bins >= 6),
{name}_b as (
  select *, hi and coalesce(lag(hi) over w, false) or gap and coalesce(lag(gap) over w, false) and coalesce(lag(gap, 2) over w, false) as ahead,
    hi and coalesce(lead(hi) over w, false) or gap and coalesce(lead(gap) over w, false) and coalesce(lead(gap, 2) over w, false) as behind,
    lag(flow_vph) over w as flow_before
  from {name}_f window w as (partition by sensor_uid, date, period order by idx)),
{name}_w as (
  select sensor_uid, date, period, min(v) as vmin, arg_min(idx, (v, idx)) filter (v is not null) as t2 from {name}_b group by all),
{name}_e as (
  select b.*, w.vmin, coalesce(w.t2, 0) as t2, w.t2 as best_at,
    min(b.idx) filter (b.ahead and b.idx > w.t2) over g as upto, max(b.idx) filter (b.behind and b.idx < w.t2) over g as since
  from {name}_b b join {name}_w w using (sensor_uid, date, period) window g as (partition by b.sensor_uid, b.date, b.period)),
{name}_t as (
  select *, coalesce(vmin <= 50, false) as sbm,
    case when coalesce(vmin <= 50, false) then min(idx) filter (low and idx > coalesce(since, -1) and idx <= best_at) over g else 0 end as t0,
    case when coalesce(vmin <= 50, false) then max(idx) filter (low and idx < coalesce(upto, n_bins) and idx >= best_at) over g else 0 end as t3
  from {name}_e window g as (partition by sensor_uid, date, period)),
{name}_k as (
  select *, idx > t2 and idx <= t3 and coalesce(v < 50, false)
    and (max(case when idx > t2 and idx <= t3 and flow_vph is not null then 1 else 0 end) over (partition by sensor_uid, date, period) = 0
      or coalesce(case when idx = t2 + 1 then flow_vph - flow_vph else flow_vph - flow_before end <= 0, false)) as keep
  from {name}_t),
{name} as (
  select sensor_uid, corridor, date, period, any_value(road_order) as road_order, any_value(n_bins) as n_bins, any_value(t0) as t0_index, any_value(t2) as t2_index,
    any_value(t3) as t3_index, any_value(vmin) as min_speed_mph, any_value(sbm) as dc_existence,
    case when any_value(vmin) is null then 0 else coalesce(sum(flow_vph * 5 / 60) filter (idx between t0 and t3), 0) end as demand_veh,
    avg(v) filter (idx between t0 and t3) as cong_mean_speed,
    case when any_value(sbm) then (any_value(t3) - any_value(t0) + 1) * 5.0::double else 0.0::double end as P_min,
    case when count(*) filter (keep) >= 6 then min(idx) filter (keep) end as discharge_start_idx,
    case when count(*) filter (keep) >= 6 then max(idx) filter (keep) end as discharge_end_idx
  from {name}_k group by sensor_uid, corridor, date, period)"""


_REGIME = """case when min_speed_mph is null or P_min < 30 or min_speed_mph >= 50 then 'uncongested' when P_min >= 120 and min_speed_mph < 25 then 'severe'
      when P_min >= 60 then 'recurring' else 'mild' end"""
EPISODES = f"""{QC},
labelled as (
  select *, strftime(datetime, '%Y-%m-%d') as date, case when hour(datetime) between 6 and 9 then 'AM' when hour(datetime) between 10 and 15 then 'MD'
      when hour(datetime) between 16 and 19 then 'PM' else 'NT' end as period, case when qc_pass then speed_mph_clean end as v
  from passed),
day_rows as (select * from labelled where period <> 'NT'),{_classified("parts", "day_rows")},
crossing as (
  select a.sensor_uid, a.date from parts a join parts b using (sensor_uid, date)
  where a.period = 'MD' and a.dc_existence and a.t3_index >= 71 and b.period = 'PM' and b.dc_existence and b.t0_index = 0),
whole_rows as (select * replace ('MDPM' as period) from labelled semi join crossing using (sensor_uid, date) where hour(datetime) between 10 and 19),{_classified("merged", "whole_rows")},
united as (
  select p.*, c.sensor_uid is not null and p.period in ('MD', 'PM') as superseded from parts p left join crossing c on p.sensor_uid = c.sensor_uid and p.date = c.date
  union all select *, false from merged),
valid as (select *, P_min >= 30 and coalesce(min_speed_mph < 50, false) and discharge_start_idx is not null and not superseded as is_valid_for_mu, {_REGIME} as base_regime from united),
z1 as (select *, count(*) over g as zn, abs(P_min - quantile_cont(P_min, 0.5) over g) as zdev from valid window g as (partition by sensor_uid, period)),
z2 as (select *, 1.4826 * quantile_cont(zdev, 0.5) over (partition by sensor_uid, period) as zmad from z1),
episodes as (select *, case when zn >= 5 and zmad > 0 and zdev / zmad > 2.5 and base_regime in ('severe', 'recurring') then 'event' else base_regime end as regime from z2)"""
#: Episodes by each sensor's own critical speed.
EPISODES_BY_SENSOR = EPISODES
for _old, _new in (
    ("v > 50", "v > vc"), ("v <= 50", "v <= vc"), ("vmin <= 50", "vmin <= vc"), ("v < 50", "v < vc"), ("min_speed_mph < 50", "min_speed_mph < vc"), ("min_speed_mph >= 50", "min_speed_mph >= vc"),
    ("min_speed_mph < 25", "min_speed_mph < 0.5 * vc"), ("any_value(vmin) as min_speed_mph", "any_value(vmin) as min_speed_mph, any_value(vc) as vc"), ("as v\n  from passed)", "as v\n  from passed join caps using (sensor_uid))"),
):
    EPISODES_BY_SENSOR = EPISODES_BY_SENSOR.replace(_old, _new)
RELIABILITY = f"""{EPISODES},
reliability as (
  select sensor_uid, count(*) as n_episodes_total, cast(sum(is_valid_for_mu::bigint) as bigint) as n_episodes_valid,
    case when sum(is_valid_for_mu::bigint) >= 20 then 'high' when sum(is_valid_for_mu::bigint) >= 10 then 'medium' when sum(is_valid_for_mu::bigint) >= 5 then 'low'
      else 'not_reliable' end as reliability_class
  from episodes group by 1)"""
MU = f"""{RELIABILITY},
slots as (
  select sensor_uid, date, period, row_number() over (partition by sensor_uid, date, period order by datetime) - 1 as idx, flow_vph
  from (select * from labelled union all select * replace ('MDPM' as period) from labelled where hour(datetime) between 10 and 19)),
mu as (
  select sensor_uid, date, period, quantile_cont(flow_vph, 0.5) as mu_obs
  from slots join episodes using (sensor_uid, date, period)
  where is_valid_for_mu and idx between discharge_start_idx and discharge_end_idx and slots.flow_vph is not null
  group by all having count(*) >= 6),
links as (
  select sensor_uid, min(corridor) as corridor, count(*) as n_episodes_total, cast(sum(is_valid_for_mu::bigint) as bigint) as n_episodes_valid,
    quantile_cont(mu_obs, 0.5) filter (is_valid_for_mu) as mid, quantile_cont(mu_obs, 0.75) filter (is_valid_for_mu) - quantile_cont(mu_obs, 0.25) filter (is_valid_for_mu) as iqr
  from episodes left join mu using (sensor_uid, date, period) group by 1),
classed as (select links.*, reliability_class as class from links join reliability using (sensor_uid)),
sound as (select * from classed where class in ('high', 'medium')),
overall as (select count(*) as n, greatest(quantile_cont(n_episodes_valid, 0.5), 1) as k0, quantile_cont(mid, 0.5) as med from sound),
by_group as (select corridor, quantile_cont(mid, 0.5) as med from sound group by 1)"""
RANKING = f"""{EPISODES},
ok as (select * from episodes where is_valid_for_mu),
timed as (
  select ok.*, places.place as pos, t0_index * 5 + s as t0_abs, t3_index * 5 + s as t3_abs
  from (select *, case period when 'AM' then 360 when 'MD' then 600 when 'PM' then 960 else 600 end as s from ok) ok join places using (corridor, sensor_uid)),
classes as (
  select t.*, case when regime = 'event' then 'incident_related'
      when not exists (select 1 from timed p where p.corridor = t.corridor and p.pos in (t.pos - 1, t.pos + 1)) then 'isolated_uncertain'
      when exists (select 1 from timed d where d.corridor = t.corridor and d.date = t.date and d.pos = t.pos + 1 and not (t.t3_abs < d.t0_abs or d.t3_abs < t.t0_abs)) then 'queued_passive'
      when exists (select 1 from timed d where d.corridor = t.corridor and d.date = t.date and d.pos = t.pos - 1 and not (t.t3_abs < d.t0_abs or d.t3_abs < t.t0_abs)) then 'spillback_source'
      else 'active_bottleneck' end as cls
  from timed t),
modes as (
  select corridor, sensor_uid, period, cls from (
    select *, row_number() over (partition by corridor, sensor_uid, period order by c desc, cls) as r from (select corridor, sensor_uid, period, cls, count(*) as c from classes group by all))
  where r = 1),
grouped as (
  select corridor, sensor_uid, period, count(*) as n, quantile_cont(greatest(1 - min_speed_mph / 50, 0), 0.5) as sev, quantile_cont(P_min, 0.5) / 60 as dur,
    quantile_cont(min_speed_mph, 0.5) as vt2, quantile_cont(demand_veh / greatest(P_min / 60, 1e-6), 0.5) as dem
  from classes group by all),
days as (select corridor, count(distinct date) as n_days from ok group by 1),
ranked0 as (
  select corridor, sensor_uid, period, n as n_valid_episodes, n_days as n_days_window, round_even(n / greatest(n_days, 1), 3) as freq_episodes_per_day,
    round_even(dur, 2) as median_P_hours, round_even(vt2, 1) as median_v_t2_mph, round_even(sev, 3) as severity, round_even(n / greatest(n_days, 1) * dur * sev, 4) as CBI_score,
    round_even(n / greatest(n_days, 1) * dur * sev * dem, 1) as delay_proxy_veh_h_per_lane_day, cls as bottleneck_class
  from grouped join days using (corridor) join modes using (corridor, sensor_uid, period)),
ranking as (
  select *, cast(row_number() over (partition by corridor order by CBI_score desc, sensor_uid, period) as integer) as rank_in_corridor,
    case when delay_proxy_veh_h_per_lane_day is not null then cast(rank() over (partition by corridor order by delay_proxy_veh_h_per_lane_day desc nulls last) as integer) end as rank_by_delay
  from ranked0)"""


def _ratios(periods: dict, high: float, name: str, more: str) -> str:
    parts = []
    for label, (weekday, a, b) in periods.items():
        hours = f"hour(epoch) >= {a} and hour(epoch) < {b}" if a < b else f"(hour(epoch) >= {a} or hour(epoch) < {b})"
        parts.append(f"select *, '{label}' as period from ep where {hours}" + ("" if weekday is None else f" and (isodow(epoch) < 6) = {str(weekday).lower()}"))
    return f"""with {STATES},
ep as (
  select sensor_uid, time_bucket(interval 15 minutes, datetime) as epoch, min(length_mi) / avg(speed_mph) * 3600 as tt_s from states
  group by all having avg(speed_mph) > 1),
rows as ({" union all ".join(parts)}),
p as (select sensor_uid, period, quantile_cont(tt_s, 0.5) as lo, quantile_cont(tt_s, {high}) as hi, count(*) as n_epochs from rows group by all having count(*) >= 8),
r as (select sensor_uid, period, round_even(lo, 1) as p50_tt_s, round_even(hi, 1) as p{round(100 * high)}_tt_s, round_even(hi / greatest(lo, 1e-9), 3) as {name}, n_epochs from p)
select *, {more} from r"""


_CUE_HITS = "len(list_filter([{}], lambda c: contains(lower(text), c)))"


def sql() -> dict[str, str]:
    from queuelens import schemas as S
    from queuelens.operators import text_issues as X

    order = list(X.CUES)
    hits = ", ".join(_CUE_HITS.format(", ".join(f"'{c}'" for c in X.CUES[t])) + f" as n{i}" for i, t in enumerate(order))
    most = "greatest(n0, n1, n2, n3)"
    kind = "case " + " ".join(f"when n{i} = {most} then '{t}'" for i, t in enumerate(order)) + " end"
    road = "(?i)\\b(I|US|SR|AZ|CA|Loop)[- ]?([0-9]{1,3})\\b"
    return {
        "resample_5min": f"with {STATES} select sensor_uid, datetime, speed_mph, flow_vph, n_readings from bins",
        "qc_flags": f"with {QC} select sensor_uid, datetime, qc_hard_range, qc_jump, qc_hampel, qc_spatial, qc_pass, round(speed_mph_clean, 6) as speed_mph_clean from passed",
        "qc_summary": f"""with {QC} select count(*) as n_rows, count(distinct sensor_uid) as n_sensors, round(avg(qc_hard_range::int), 6) as qc_hard_range_share,
round(avg(qc_jump::int), 6) as qc_jump_share, round(avg(qc_hampel::int), 6) as qc_hampel_share, round(avg(qc_spatial::int), 6) as qc_spatial_share, round(avg(qc_pass::int), 6) as qc_pass_share from passed""",
        "episodes": f"""with {EPISODES} select sensor_uid, corridor, date, period, t0_index, t2_index, t3_index, dc_existence, is_valid_for_mu, regime, discharge_start_idx, discharge_end_idx,
round(P_min, 3) as P_min, round(min_speed_mph, 3) as min_speed_mph, round(demand_veh, 3) as demand_veh, round(cong_mean_speed, 3) as cong_mean_speed from episodes""",
        "sensor_reliability": f"with {RELIABILITY} select * from reliability",
        "mu_links": f"""with {MU}
select sensor_uid, c.corridor, n_episodes_total, n_episodes_valid, class as reliability_class, round(mid, 3) as mu_obs_median_vphpl, round(iqr, 3) as mu_obs_iqr_vphpl,
round(case when o.n > 0 then case when g.corridor is not null then g.med else o.med end end, 3) as mu_group_median_vphpl,
round(case when o.n > 0 then n_episodes_valid / (n_episodes_valid + o.k0) end, 6) as alpha_shrinkage,
round(case when o.n > 0 and mid is null then case when g.corridor is not null then g.med else o.med end
  when o.n > 0 and class in ('low', 'not_reliable') then n_episodes_valid / (n_episodes_valid + o.k0) * mid + (1 - n_episodes_valid / (n_episodes_valid + o.k0)) * case when g.corridor is not null then g.med else o.med end
  else mid end, 3) as mu_shrunk_vphpl,
case when mid is null then 'group_only' when o.n > 0 and class in ('low', 'not_reliable') then 'shrunk' else 'self' end as mu_source
from classed c left join by_group g on c.corridor = g.corridor cross join overall o""",
        "ranking": f"with {RANKING} select * from ranking",
        "corridor_summary": f"""with {RANKING} select corridor, period, count(*) as n_ranked_sensor_periods, round_even(sum(CBI_score), 4) as total_CBI_score,
arg_min(sensor_uid, rank_in_corridor) as top_sensor, arg_min(CBI_score, rank_in_corridor) as top_score, count(*) filter (bottleneck_class = 'active_bottleneck') as n_active,
count(*) filter (bottleneck_class = 'spillback_source') as n_spillback, count(*) filter (bottleneck_class = 'queued_passive') as n_passive,
count(*) filter (bottleneck_class = 'incident_related') as n_incident from ranking group by all""",
        "lottr": _ratios(S.LOTTR_PERIODS, 0.8, "lottr", "lottr < 1.5 as reliable"),
        "reliability_issues": "with l as (" + _ratios(S.LOTTR_PERIODS, 0.8, "lottr", "lottr < 1.5 as reliable") + """)
select 'I-' || cast(499 + row_number() over (order by sensor_uid, period) as varchar) as issue_id, 'unreliable_segment_lottr' as type, 'CORRIDOR' as corridor, sensor_uid, period as time_window, 0.6::double as confidence,
case when lottr >= 2 then 'high' else 'medium' end as severity, lottr, n_epochs, 'open' as status from l where not reliable""",
        "tttr": _ratios(S.TTTR_PERIODS, 0.95, "tttr", "'all_vehicle_proxy' as basis"),
        "vehicle_hours_of_delay": f"""with {STATES}, r as (select *, quantile_cont(speed_mph, 0.95) over (partition by sensor_uid) as ref from states)
select sensor_uid, strftime(datetime, '%Y-%m-%d') as date, round_even(sum(flow_vph * lanes * 5 / 60 * greatest(length_mi / greatest(speed_mph, 3) - length_mi / greatest(ref, 1), 0)), 1) as vhd
from r group by all""",
        "accounting": f"""with {STATES}, r as (select *, flow_vph * lanes * 5 / 60 * length_mi as vmt from states),
s as (select *, vmt / greatest(speed_mph, 1) as vht, vmt / 65 as vfftt from r)
select corridor, cast(hour(datetime) as integer) as hour, round(sum(vmt), 5) as vmt, round(sum(vht), 5) as vht, round(sum(vfftt), 5) as vfftt, round(sum(greatest(vht - vfftt, 0)), 5) as vdt,
round(sum(case when speed_mph < 45 then greatest(vht - vfftt, 0) else 0 end), 5) as vcdt, round(sum(vmt) / sum(vht), 5) as avg_speed from s group by all""",
        "queue_calibration": f"""with {EPISODES},
e as (select sensor_uid, date, period, P_min / 60 as p, demand_veh / cap as d, min_speed_mph as v2 from episodes join caps using (sensor_uid) where P_min > 0 and demand_veh > 0),
f as (select *, ln(p) / case when abs(ln(d)) < 1e-6 then case when ln(d) >= 0 then 1e-5 else -1e-5 end else ln(d) end as n0 from e),
g as (select *, case when n0 < 1.001 then 1.124 else n0 end as nr, case when n0 < 1.001 then p / greatest(pow(d, 1.124), 1e-9) else 1.0 end as cdr,
  case when v2 > 0 then (50 / greatest(v2, 1e-4) - 1) / greatest(pow(p, 4), 1e-5) end as cpr from f),
h as (select *, case when nr between 1 and 1.5 then nr else 1.24 end as n, case when cdr between 0.5 and 2 then cdr else 1.0 end as cd, case when cpr between 0 and 2 then cpr else 0.2 end as cp from g),
k as (select *, case when cd * pow(d, n) between 0 and 10 then cd * pow(d, n) else 0 end as ph from h)
select sensor_uid, date, period, round(n, 6) as Q_n, round(cd, 6) as Q_cd, round(cp, 6) as Q_cp, case when n0 < 1.001 then 'Q_n_below_1' else 'ok' end as calibration_status,
round(case when 8.0 / 15 * cp * pow(cd, 4) between 0.01 and 1 then 8.0 / 15 * cp * pow(cd, 4) else 0.27 end, 6) as Q_alpha,
round(case when n * 4 between 0.5 and 5 then n * 4 else 1.14 end, 6) as Q_beta, round(ph, 6) as P_hat, round(50 / greatest(cp * pow(ph, 4) + 1, 1e-3), 6) as vt2_hat from k""",
        "queue_fits": f"""with {EPISODES},
e as (select sensor_uid, period, P_min, min_speed_mph, P_min / 60 as p, demand_veh / cap as d, vf from episodes join caps using (sensor_uid) where isodow(cast(date as date)) < 6),
q as (select *, quantile_cont(P_min, 0.25) over g as a1, quantile_cont(P_min, 0.75) over g as a3, count(P_min) over g as an, quantile_cont(min_speed_mph, 0.25) over g as b1,
  quantile_cont(min_speed_mph, 0.75) over g as b3, count(min_speed_mph) over g as bn, quantile_cont(d, 0.25) over g as c1, quantile_cont(d, 0.75) over g as c3, count(d) over g as cn
  from e window g as (partition by sensor_uid, period)),
k as (select * from q where (an < 4 or P_min is null or P_min between a1 - 3 * (a3 - a1) and a3 + 3 * (a3 - a1)) and (bn < 4 or min_speed_mph is null or min_speed_mph between b1 - 3 * (b3 - b1) and b3 + 3 * (b3 - b1))
  and (cn < 4 or d is null or d between c1 - 3 * (c3 - c1) and c3 + 3 * (c3 - c1))),
x as (select *, case when d > 1.05 and p > 0 then ln(greatest(d - 1, 1e-9)) end as x1, case when d > 1.05 and p > 0 then ln(greatest(p, 1e-9)) end as y1,
  case when d > 0 and min_speed_mph > 0 and min_speed_mph < vf * 1.05 then ln(d) end as x2,
  case when d > 0 and min_speed_mph > 0 and min_speed_mph < vf * 1.05 then ln(greatest(vf / greatest(min_speed_mph, 1) - 1, 1e-6)) end as y2 from k)
select sensor_uid, period, count(x1) as n_f_d, case when count(x1) >= 5 then round(exp(regr_intercept(y1, x1)), 5) end as f_d, case when count(x1) >= 5 then round(regr_slope(y1, x1), 5) end as n,
count(x2) as n_alpha, case when count(x2) >= 5 then round(exp(regr_intercept(y2, x2)), 5) end as alpha, case when count(x2) >= 5 then round(regr_slope(y2, x2), 5) end as beta from x group by all""",
        "text_issues": f"""with h as (select doc_id, text, source, {hits} from documents),
b as (select *, {most} as best from h where {most} > 0),
x as (select *, regexp_extract(text, '{road}', 1) as road, regexp_extract(text, '\\bthe\\s+([0-9]{{2,3}})\\b', 1) as the, regexp_extract(text, '(?i)\\b(?:mile(?:\\s?marker|post)?|MP)\\s?([0-9]{{1,3}}(?:\\.[0-9])?)\\b', 1) as mp from b)
select doc_id, 'I-' || case when 699 + row_number() over (order by doc_id) < 1000 then lpad(cast(699 + row_number() over (order by doc_id) as varchar), 3, '0') else cast(699 + row_number() over (order by doc_id) as varchar) end as issue_id, {kind} as type, cast(best as integer) as n_cues,
case when road <> '' then upper(road) || '-' || regexp_extract(text, '{road}', 2) when the <> '' then 'I-' || the end as corridor,
case when mp <> '' then cast(mp as double) end as milepost,
round_even(least(0.35 + 0.1 * least(best, 3) + case when road <> '' then 0.15 else 0 end + case when mp <> '' then 0.05 else 0 end, 0.85), 2) as confidence,
case when {kind} = 'recurring_congestion_report' then 'medium' else 'low' end as severity from x""",
        "fd_objectives": f"""with {STATES}, w as (select var_pop(speed_mph) / var_pop(flow_vph) as w from states),
p as (select speed_mph as v, flow_vph as q, density_vpm as k, w from states, w),
m as (
  select 'Greenshields' as model, 0 as candidate, v, q, k, w, 70 * (1 - k / 190) as hat from p union all
  select 'Underwood', 1, v, q, k, w, 70 * exp(-k / 60) from p union all
  select 'S3', 2, v, q, k, w, 70 / pow(1 + pow(k / 35, 4.0), 0.5) from p union all
  select 'GHR_M1', 3, v, q, k, w, 70 * exp(-0.5 * (k / 45) * (k / 45)) from p union all
  select 'Wang_3PL', 4, v, q, k, w, 70 / (1 + exp((k - 40) / 20)) from p union all
  select 'Greenberg', 5, v, q, k, w, 30 * ln(150 / k) from p union all
  select 'NF', 6, v, q, k, w, 70 * (1 - exp(-(2500.0 / 70) * (1 / k - 1.0 / 150))) from p union all
  select 'GHR_M2', 7, v, q, k, w, 70 * (1 - pow(k / 190, 0.8)) from p union all
  select 'GHR_M3', 8, v, q, k, w, 70 * sign(1 - k / 190) * pow(abs(1 - k / 190), 1.5) from p union all
  select 'KK', 9, v, q, k, w, 70 * (1 / (1 + exp((k / 35 - 1.2) / 0.6)) - 0.01) from p union all
  select 'Jayakrishnan', 10, v, q, k, w, 4 + 66 * sign(1 - k / 190) * pow(abs(1 - k / 190), 1.8) from p union all
  select 'MacNicholas', 11, v, q, k, w, 70 * (pow(150, 2.5) - pow(k, 2.5)) / (pow(150, 2.5) + 30 * pow(k, 2.5)) from p union all
  select 'Wang_4PL', 12, v, q, k, w, 5 + 65 / (1 + exp((k - 40) / 14)) from p union all
  select 'Wang_5PL', 13, v, q, k, w, 5 + 65 / pow(1 + exp((k - 30) / 8), 0.4) from p union all
  select 'Van_Aerde', 14, v, q, k, w, 1 / (100.0 / (150.0 * 2025) * -10 + 100.0 / (150.0 * 2025) * 3025 / (100 - v) + (1.0 / 1700 - 100.0 / (150.0 * 2025) * -10 / 45 - 100.0 / (150.0 * 2025) * 3025 / (45 * 55.0)) * v) from p union all
  select 'Ni', 15, v, q, k, w, 1 / ((-3.48e-6 * v * v + v / 3600 + 7.5e-3) * (1 - ln(1 - v / 100))) from p)
, e as (select *, case when model in ('Van_Aerde', 'Ni') then hat - k else hat - v end as err, case when model in ('Van_Aerde', 'Ni') then hat * v - q else hat * k - q end as dq from m)
select model, candidate, count(*) as n, round(sqrt(sum(err * err) / count(*)), 4) as speed_rmse, round(sqrt(sum(err * err + w * dq * dq) / count(*)), 4) as joint_rmse
from e group by all""",
        "speed_runs": f"""with {STATES},
s as (select *, strftime(datetime, '%Y-%m-%d') as date, hour(datetime) * 60 + minute(datetime) as t_min from states where hour(datetime) >= 5 and hour(datetime) < 22),
d as (select *, avg(speed_mph) over (partition by sensor_uid, date order by datetime rows between 1 preceding and 1 following) as sm from s),
l as (select *, row_number() over w as rn, count(*) over (partition by sensor_uid, date) as n, sm < 49.0 as low, coalesce(lead(sm) over w >= 49.0, true) as next_high, lag(sm) over w as p, lag(t_min) over w as pt, lead(sm) over w as nx, lead(t_min) over w as nt
  from d window w as (partition by sensor_uid, date order by datetime)),
k as (select *, sm >= 49.0 and (next_high) as breaks from l where n >= 8),
i as (select *, sum(breaks::int) over (partition by sensor_uid, date order by datetime rows between unbounded preceding and current row) as island from k),
r as (select sensor_uid, date, island, min(rn) filter (low) as i0, max(rn) filter (low) as i3, count(*) filter (low) as lows from i group by all having count(*) filter (low) > 0)
select sensor_uid, date, cast(i0 - 1 as integer) as i_start, cast(i3 - 1 as integer) as i_end, lows as n_low from r""",
        "observed_share": f"""with {STATES} select sensor_uid, count(*) as n_bins, count(distinct cast(datetime as date)) as n_days, round(count(*) / (count(distinct cast(datetime as date)) * 288.0), 6) as observed_frac,
cast(least(greatest(round_even(quantile_cont(flow_vph * lanes, 0.99) / 1900, 0), 1), 8) as integer) as est_lanes from states group by 1""",
        "free_flow": f"""with {STATES}, p as (select sensor_uid, count(*) filter (speed_mph > 0) as n, quantile_cont(speed_mph, 0.95) filter (speed_mph > 0) as v from states group by 1)
select sensor_uid, n, round(case when n >= 200 then v end, 4) as v_f_mph from p""",
        "s3_volume": f"""with {STATES}, r as (select sensor_uid, datetime, speed_mph, 70.0 as vf, 35.0 as kc, 4.0 as m from states),
q as (select *, greatest(vf / greatest(1, least(speed_mph, 0.99 * vf)), 1.00001) as r from r)
select sensor_uid, datetime, round(case when speed_mph >= 0 then least(least(speed_mph, 0.99 * vf) * kc * pow(greatest(pow(r, m / 2) - 1, 1e-8), 1 / m), kc * vf / pow(2, 2 / m)) end, 4) as flow_vph from q""",
        "corridor_panel": f"""with {STATES} select corridor, datetime, max(speed_mph) filter (road_order = 0) as s0, max(speed_mph) filter (road_order = 1) as s1, max(speed_mph) filter (road_order = 2) as s2,
max(speed_mph) filter (road_order = 3) as s3, max(speed_mph) filter (road_order = 4) as s4, max(speed_mph) filter (road_order = 5) as s5 from states group by all""",
        "grid_filled": f"""with {STATES},
hourly as (select sensor_uid, date_trunc('hour', datetime) as h, avg(speed_mph) as v from states group by all),
grid as (select sensor_uid, unnest(generate_series(min(h), max(h), interval 1 hour)) as h from hourly group by sensor_uid),
j as (select grid.sensor_uid, grid.h, v, case when v is not null then grid.h end as known from grid left join hourly on grid.sensor_uid = hourly.sensor_uid and grid.h = hourly.h),
f as (select *, last_value(v ignore nulls) over a as v0, last_value(known ignore nulls) over a as h0, first_value(v ignore nulls) over b as v1, first_value(known ignore nulls) over b as h1 from j
  window a as (partition by sensor_uid order by h rows between unbounded preceding and current row), b as (partition by sensor_uid order by h rows between current row and unbounded following))
select sensor_uid, h as datetime, v is null as filled, round(case when v is not null then v when v0 is null then v1 when v1 is null then v0 else v0 + (v1 - v0) * epoch(h - h0) / epoch(h1 - h0) end, 4) as speed_mph from f""",
        "flow_residual": f"""with {STATES}, a as (select corridor, sensor_uid, road_order, hour(datetime) as hour, avg(flow_vph) as q from states group by all),
d as (select *, q - lag(q) over (partition by corridor, hour order by road_order, sensor_uid) as diff from a)
select corridor, cast(hour as integer) as hour, count(diff) as n, round(avg(diff), 4) as mean_residual, round(quantile_cont(abs(diff), 0.95), 4) as p95_abs from d group by all""",
        "recurrent_deviation": f"""with {STATES}, a as (select sensor_uid, cast(datetime as date) as day, hour(datetime) as hour, avg(speed_mph) as v from states group by all),
m as (select *, v - avg(v) over (partition by sensor_uid, hour) as d from a)
select strftime(day, '%Y-%m-%d') as date, count(*) as n_cells, round(sqrt(sum(d * d)), 4) as frobenius from m group by 1""",
        "rank_agreement": f"""with {RANKING}, s as (select corridor, sensor_uid, sum(CBI_score) as score, sum(delay_proxy_veh_h_per_lane_day) as delay from ranking group by all),
r as (select *, rank() over (partition by corridor order by score) + (count(*) over (partition by corridor, score) - 1) / 2.0 as ra, rank() over (partition by corridor order by delay) + (count(*) over (partition by corridor, delay) - 1) / 2.0 as rb,
  row_number() over (partition by corridor order by score desc, sensor_uid) as pa, row_number() over (partition by corridor order by delay desc, sensor_uid) as pb from s)
select corridor, count(*) as n_common, round(corr(ra, rb), 6) as spearman, count(*) filter (pa <= 5 and pb <= 5) as top5_overlap,
case when count(*) < 5 then 'N/A' when round(corr(ra, rb), 6) >= 0.7 then 'PASS' when round(corr(ra, rb), 6) >= 0.5 then 'REVIEW' else 'FAIL' end as gate from r group by 1""",
    }
