"""Operators on small frames against plain loops and stated invariants."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions import diagrams, traffic
from queuelens.operators import audits, direction, discharge, episodes, evidence, fits, flows, gates, panels, priors, quality_control, queue_model, ranking, reliability, runs, text_issues, tokens, weekday
from queuelens.session import cut
from queuelens.sources import readers, sinks
from queuelens.streaming import online


def scan(v, v_c):
    """Boundaries by walking outwards from the lowest speed."""
    known = [i for i, x in enumerate(v) if x is not None]
    if not known:
        return 0, 0, 0
    worst = min(known, key=lambda i: (v[i], i))
    if v[worst] > v_c:
        return 0, worst, 0

    def walk(places):
        above = gap = 0
        last = worst
        for i in places:
            if v[i] is None:
                above, gap = 0, gap + 1
                if gap == 3:
                    break
            elif v[i] > v_c:
                above, gap = above + 1, 0
                if above == 2:
                    break
            else:
                above, gap, last = 0, 0, i
        return last

    return walk(range(worst, -1, -1)), worst, walk(range(worst, len(v)))


def window(v, q, t2, t3, v_c):
    places = list(range(t2 + 1, t3 + 1))
    counted = any(q[i] is not None for i in places)
    keep = []
    for i in places:
        d = 0 if i == t2 + 1 else None if q[i] is None or q[i - 1] is None else q[i] - q[i - 1]
        if i == t2 + 1 and q[i] is None:
            d = None
        if v[i] is not None and v[i] < v_c and (not counted or (d is not None and d <= 0)):
            keep.append(i)
    return (keep[0], keep[-1]) if len(keep) >= 6 else None


def test_episode_scan_matches_a_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for day in range(60):
        n = rng.choice((5, 6, 20, 48))
        v = [None if rng.random() < 0.15 else rng.choice((20.0, 35.0, 49.0, 50.0, 51.0, 70.0)) for _ in range(n)]
        if day == 7:
            v = [None] * n
        q = [None if rng.random() < 0.1 else float(rng.randrange(900, 1000) - 5 * i) for i in range(n)]
        date = f"2024-01-{day % 28 + 1:02d}" if day < 28 else f"2024-{2 + (day - 28) // 28:02d}-{(day - 28) % 28 + 1:02d}"
        rows += [("a", "c", date, "AM", i, v[i], q[i]) for i in range(n)]
        if n >= 6:
            t0, t2, t3 = scan(v, 50.0)
            want[date] = (t0, t2, t3, window(v, q, t2, t3, 50.0))
    df = spark.createDataFrame(rows, "sensor_uid string, corridor string, date string, period string, idx int, v double, flow_vph double")
    got = {r.date: (r.t0_index, r.t2_index, r.t3_index, None if r.discharge_start_idx is None else (r.discharge_start_idx, r.discharge_end_idx)) for r in episodes.classify(df).collect()}
    assert got == want


@pytest.fixture(scope="module")
def simulated(spark):
    return cut(readers.simulate_corridor(spark, seed=7))


@pytest.fixture(scope="module")
def found(spark, simulated):
    qc = cut(quality_control.run_qc(simulated))
    eps = episodes.find_episodes(qc, v_c=45.0)
    return qc, cut(eps)


def test_planted_bottleneck_ranks_first(found):
    ranked = cut(ranking.rank(found[1]))
    first = ranked.where("rank_in_corridor = 1").first()
    assert first.sensor_uid == "SIM03" and first.n_valid_episodes >= 3
    assert ranking.corridor_summary(ranked).where("top_sensor = 'SIM03'").count() >= 1


def test_discharge_rates_near_the_planted_drop(found):
    qc, eps = found
    links = discharge.mu_per_link(discharge.mu_per_episode(eps, qc), episodes.sensor_reliability(eps))
    mu = links.where("sensor_uid = 'SIM03'").first().mu_obs_median_vphpl
    assert abs(mu / 1900 - 0.92) < 0.03
    shrunk = discharge.shrink_to_group(links)
    assert shrunk.count() == links.count() and set(shrunk.select("mu_source").distinct().toPandas().mu_source) <= {"self", "shrunk", "group_only"}


def test_md_pm_queue_is_merged(spark):
    rows = [("x", "c", f"2024-01-02 {h:02d}:{m:02d}:00", 30.0 if 15 <= h < 17 else 60.0, 1000.0 - h * 12 - m / 5) for h in range(10, 20) for m in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "sensor_uid string, corridor string, t string, speed_mph double, flow_vph double").withColumn("datetime", F.col("t").cast("timestamp_ntz"))
    got = {r.period: r for r in episodes.find_episodes(df).collect()}
    assert got["MDPM"].is_valid_for_mu and not got["MD"].is_valid_for_mu and not got["PM"].is_valid_for_mu
    assert got["MDPM"].P_min == 120.0


def test_hampel_and_neighbours(spark):
    v = [60.0] * 20
    v[10] = 20.0
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "sensor_uid string, datetime int, speed_mph double")
    out = {r.datetime: (r.qc_hampel, r.speed_mph_clean) for r in quality_control.with_hampel(df).collect()}
    assert out[10] == (False, 60.0) and sum(not ok for ok, _ in out.values()) == 1
    road = spark.createDataFrame([("c", 0, float(i), f"s{i}", x) for i, x in enumerate([60.0, 20.0, 61.0, None])], "corridor string, datetime int, road_order double, sensor_uid string, v double")
    check = lambda df, sensors=None: [bool(r.ok) for r in quality_control.with_places(df, sensors).withColumn("ok", quality_control.spatial(F.col("v"))).orderBy("road_order").collect()]
    assert check(road) == [True, False, False, True]  # 61 is 20.5 from the median of 20 and itself
    # Without a row of s1 at this time, s0 and s2 are no neighbours; without the last sensor, s2 still isn't the end.
    far = spark.createDataFrame([("c", 0, 0.0, "s0", 60.0), ("c", 0, 2.0, "s2", 10.0), ("c", 0, 3.0, "s3", 70.0)], road.schema)
    assert check(far, road) == [True, False, True] and check(far.where("road_order < 3"), road) == [True, True]


def test_idle_sensor_keeps_queues_apart(spark):
    one = lambda s, o: (s, "c", "2024-01-02", "AM", o, 0, 10, 20.0, 100.0, 60.0, 50.0, "recurring", True)
    eps = spark.createDataFrame([one("a", 0.0), one("z", 2.0)], "sensor_uid string, corridor string, date string, period string, road_order double, t0_index int, t3_index int, min_speed_mph double, demand_veh double, P_min double, v_c_mph double, regime string, is_valid_for_mu boolean")
    sensors = spark.createDataFrame([("c", s, o) for s, o in (("a", 0.0), ("m", 1.0), ("z", 2.0))], "corridor string, sensor_uid string, road_order double")
    kinds = lambda df: {r.sensor_uid: r.bottleneck_class for r in df.collect()}
    assert kinds(ranking.rank(eps, sensors)) == {"a": "isolated_uncertain", "z": "isolated_uncertain"}
    assert kinds(ranking.rank(eps)) == {"a": "queued_passive", "z": "spillback_source"}


def test_panel_keeps_every_position(spark):
    df = spark.createDataFrame([("c", 0, 1.5, 10.0), ("c", 0, 7.0, 20.0)], "corridor string, datetime int, road_order double, speed_mph double")
    assert [tuple(r) for r in panels.corridor_panel(df).collect()] == [("c", 0, 10.0, 20.0)]


def test_runs_and_crossings(spark):
    v = [60, 60, 40, 40, 60, 40, 60, 60, 60, 60, 40, 60]
    df = spark.createDataFrame([("s", f"2024-01-02 08:{5 * i:02d}:00", float(x)) for i, x in enumerate(v)], "sensor_uid string, t string, speed_mph double").withColumn("datetime", F.col("t").cast("timestamp_ntz"))
    got = runs.find_runs(df, cutoff=50.0, smooth=1).orderBy("i_start").collect()
    assert [(r.i_start, r.i_end, r.n_low) for r in got] == [(2, 5, 3), (10, 10, 1)]
    assert got[0].t0_min == 8 * 60 + 7.5 and got[0].t3_min == 8 * 60 + 27.5


def test_power_fits_recover_parameters(spark):
    rows = [("s", "AM", 1.2 + 0.1 * i, 0.9 * (0.2 + 0.1 * i) ** 1.3, 70 / (1 + 0.2 * (1.2 + 0.1 * i) ** 2), 70 * 0.8 * (1.2 + 0.1 * i) ** -0.4, 70.0) for i in range(12)]
    df = spark.createDataFrame(rows, "sensor_uid string, period string, D_over_C double, P_hours double, min_speed_mph double, cong_mean_speed double, v_f_mph double")
    r = queue_model.fit_groups(df).first()
    for got, want in ((r.f_d, 0.9), (r.n, 1.3), (r.alpha, 0.2), (r.beta, 2), (r.f_p, 0.8), (r.s, 0.4), (r.r2_f_d, 1)):
        assert math.isclose(got, want, rel_tol=1e-9)


def test_calibration_and_profile_round_trip(spark):
    df = spark.createDataFrame([("e", 2.0, 1.8, 50.0, 25.0, 1800.0, 3240.0, 1.0, 8.0, 65.0), ("f", 0.0, 1.0, 50.0, 25.0, 1800.0, 0.0, 1.0, 8.0, 65.0)], "episode_id string, P_hours double, D_over_C double, v_c_mph double, min_speed_mph double, capacity_vphpl double, demand_veh double, length_mi double, t2_hour double, v_f_mph double")
    out = queue_model.forward(queue_model.calibrate(df)).cache()
    e, f = out.orderBy("episode_id").collect()
    assert math.isclose(e.P_hat, 2.0, rel_tol=1e-9) and math.isclose(e.vt2_hat, 25.0, rel_tol=1e-9) and f.calibration_status == "missing_inputs"
    p = queue_model.profile(out.where("episode_id = 'e'")).agg(F.min("td_speed_mph"), F.max("td_speed_mph")).first()
    assert abs(p[0] - 25.0) < 0.5 and p[1] <= 65.0


def test_shapes_find_the_quartic(spark):
    n = 25
    rows = [("e", i, n, 0.25 * i * i * (i - n + 1) ** 2 * 0.01) for i in range(n)]
    r = queue_model.shape_fits(spark.createDataFrame(rows, "episode_id string, idx int, n int, deficit double")).first()
    assert r.winner == "qvdf_quartic" and r.qvdf_quartic == 1.0


def test_scalars(spark):
    r = spark.range(1).select(
        traffic.s3_flow(35.0, 70.0, 35.0, 4.0).alias("q"), traffic.s3_flow(-1.0, 70.0, 35.0, 4.0).alias("none"), traffic.s3_capacity(70.0, 35.0, 4.0).alias("cap"), traffic.clip_to_default("Q_n", 3.0).alias("n"),
        traffic.regime(130.0, 20.0, 50.0).alias("severe"), traffic.regime(20.0, 20.0, 50.0).alias("un"), traffic.geh(110.0, 100.0).alias("geh"), traffic.density(100.0, 0.5).alias("k"), traffic.reliability(12).alias("rel"),
    ).first()
    assert r.none is None and r.q <= r.cap and r.n == S.FEASIBLE["Q_n"][0] and r.severe == "severe" and r.un == "uncongested" and r.k is None and r.rel == "medium"


def test_every_diagram_has_a_value(spark):
    params = {"vf": 70.0, "kc": 40.0, "m": 3.0, "kj": 200.0, "vc": 40.0, "lam": 3000.0, "c1": 1.0, "c2": 0.5, "c3": 0.01, "vj": 5.0, "c": 2.0, "theta": 20.0, "vb": 5.0, "theta1": 20.0, "theta2": 0.8, "qm": 2000.0, "gamma": 1e-5, "tau": 1e-4, "l": 0.005}
    names = [*diagrams.SPEED_MODELS, *diagrams.DENSITY_MODELS]
    row = spark.range(1).select(*[diagrams.predicted(n, F.lit(30.0), params).alias(n) for n in names]).first()
    assert len(names) == 16 and all(x is not None and math.isfinite(x) for x in row)


def test_robust_diagrams(spark):
    rng = np.random.default_rng(1)
    k = rng.uniform(5, 120, 300)
    v = 65 / (1 + (k / 30) ** 3) ** (2 / 3)
    q = k * v + rng.normal(0, 20, 300)
    q[:15] += 1500
    p, r2, rmse = fits.huber_fit(k, q, "S3")
    assert abs(p[0] - 65) < 3 and abs(p[1] - 30) < 3
    df = spark.createDataFrame([("s", float(a), float(b), float(c)) for a, b, c in zip(v, q, k)], "sensor_uid string, speed_mph double, flow_vph double, density_vpm double")
    full = {r.regime: r for r in fits.fit_diagrams(df).collect()}["full"]
    assert 1200 < full.capacity_vphpl < 2000


def test_bootstrap_shrinks(spark):
    df = spark.createDataFrame([("c", "Q_n", float(x)) for x in (1.1, 1.2, 1.3)] + [("c", "Q_s", 2.0)], "corridor string, param string, x double")
    got = {r.param: r for r in fits.bootstrap_medians(df, ("corridor", "param"), "x", {"Q_n": 1.24, "Q_s": 4.0}).collect()}
    assert got["Q_n"].p5 <= got["Q_n"].median == 1.2 <= got["Q_n"].p95 and math.isclose(got["Q_s"].shrunk, 2 / 6 + 4 * 5 / 6)


def test_conserved_volume(spark):
    df = spark.createDataFrame([("l", float(q), 1000.0, 2000.0) for q in (100, 800, 900)], "link_id string, flow0 double, capacity_vphpl double, total double")
    assert abs(fits.conserve_volume(df).agg(F.sum("flow_conserved")).first()[0] - 2000) < 1e-6


def test_reliability_and_delay(spark, simulated):
    assert reliability.lottr(simulated).where("lottr < 1").count() == 0
    day = reliability.vehicle_hours_of_delay(simulated)
    assert day.where("sensor_uid = 'SIM03' and vhd > 0").count() == 5
    assert reliability.corridor_delay(day, 20.0).count() == 5
    with pytest.raises(ValueError, match="synthetic"):
        reliability.vehicle_hours_of_delay(simulated.withColumn("flow_synthetic", F.lit(True)))
    with pytest.raises(ValueError, match="no measured volume"):
        reliability.vehicle_hours_of_delay(simulated.withColumn("has_volume", F.lit(False)))


def test_tokens(spark, found):
    qc, eps = found
    rows = qc.withColumn("date", F.date_format("datetime", "yyyy-MM-dd"))
    slots = episodes.sliced(qc).select("sensor_uid", "date", "period", "idx", "datetime")
    timed = eps
    for n in ("t0", "t2", "t3"):
        timed = timed.join(slots.select("sensor_uid", "date", "period", F.col("idx").alias(f"{n}_index"), F.col("datetime").alias(f"{n}_time")), ["sensor_uid", "date", "period", f"{n}_index"], "left")
    ranked = cut(ranking.rank(eps))
    toks = cut(tokens.compile_tokens(cut(timed), rows, ranked))
    assert toks.count() == eps.where("is_valid_for_mu").count()
    bad = toks.where("states.T0_PRE_BREAKDOWN > states.T1_ONSET or states.T1_ONSET > states.T2_WORST_STATE or states.T2_WORST_STATE > states.T3_RECOVERY or states.T3_RECOVERY > states.T4_RESIDUAL_CLEARANCE")
    assert bad.count() == 0
    late = toks.withColumn("states", F.struct(*[(F.col(f"states.{s}") + F.expr("interval 35 minutes")).alias(s) for s in ("T0_PRE_BREAKDOWN", "T1_ONSET", "T2_WORST_STATE", "T3_RECOVERY", "T4_RESIDUAL_CLEARANCE")]))
    got = tokens.compare_tokens(toks, late).select("tokens").first().tokens
    assert got == ["MODEL_MISSES_ONSET", "MODEL_MISSES_RECOVERY", "MODEL_RIGHT_AVERAGE_WRONG_SHAPE"]
    assert tokens.compare_tokens(toks, toks.limit(0)).where("tokens = array('MODEL_MISSES_ONSET')").count() == toks.count()
    assert tokens.benefit_tokens(toks, toks).first().tokens == []
    issues = cut(tokens.issue_graph(toks, qc=qc))
    assert issues.where("type = 'recurring_bottleneck'").count() >= 1
    name = issues.where("type = 'recurring_bottleneck'").orderBy("issue_id").first()
    said = spark.createDataFrame([("I-700", "recurring_congestion_report", name.corridor, 0.5), ("I-701", "incident_report", "elsewhere", 0.5)], "issue_id string, type string, corridor string, confidence double")
    backed = {r.issue_id: r for r in evidence.corroborate(said, issues).collect()}
    assert (backed["I-700"].corroborates, backed["I-700"].confidence) == (name.issue_id, 0.65) and backed["I-701"].needs_detector_check
    sources = evidence.register_sources(spark.createDataFrame([("paper", "publication", "peer_reviewed")], "name string, kind string, trust_level string"))
    claims = sources.select("source_id", F.lit("queues form here").alias("claim_text"), F.lit("bottleneck_location").alias("claim_type"), F.lit(name.corridor).alias("corridor"))
    cards = evidence.make_cards(claims, sources)
    if cards.count():
        compiled = evidence.compile_evidence(cards, issues).first()
        assert compiled.status == "needs_planner_review" and name.issue_id in compiled.evidence
    decided = tokens.review(issues, spark.createDataFrame([("I-001", "approved", "pat"), ("I-002", "approved", " ")], "issue_id string, decision string, reviewer string"))
    assert tokens.approved(decided).count() == 1


def test_issue_graph_of_few_tokens(spark):
    """Incident days don't count as recurring, and each has an issue of its own; ids follow sensor and period."""
    token = lambda s, d, p, cls, minutes, level, cause: (s, d, p, "C", cls, (float(minutes), 30.0), (level,), ([cause],))
    rows = [
        token("b", "2024-01-01", "AM", "active_bottleneck", 100, "high", "CAUSE_UNKNOWN"), token("b", "2024-01-02", "AM", "active_bottleneck", 160, "low", "CAUSE_UNKNOWN"), token("b", "2024-01-03", "AM", "active_bottleneck", 500, "high", "CAUSE_INCIDENT"),
        token("a", "2024-01-01", "PM", "spillback_source", 60, "high", "CAUSE_UNKNOWN"), token("a", "2024-01-02", "PM", "spillback_source", 60, "high", "CAUSE_INCIDENT"), token("c", "2024-01-01", "AM", "queued_passive", 60, "high", "CAUSE_UNKNOWN"),
        token("c", "2024-01-02", "AM", "queued_passive", 60, "high", "CAUSE_UNKNOWN"),
    ]
    schema = "sensor_uid string, date string, period string, facility string, bottleneck_class string, metrics struct<congestion_duration_min:double,min_speed_mph:double>, evidence struct<support_level:string>, diagnosis struct<likely_cause:array<string>>"
    fd = spark.createDataFrame([("z", "C", 3000.0, 0.2, False), ("y", "C", 1800.0, 0.9, True)], "sensor_uid string, corridor string, capacity_vphpl double, r2 double, fit_ok boolean")
    qc = spark.createDataFrame([("C", i < 7) for i in range(10)] + [("D", True)], "corridor string, qc_pass boolean")
    got = [(r.issue_id, r.type, r.sensor_uid, r.time_window, r.confidence, r.severity) for r in tokens.issue_graph(spark.createDataFrame(rows, schema), fd, qc).orderBy("issue_id").collect()]
    assert got == [
        ("I-001", "incident_pattern_day", "a", "2024-01-02 PM", 0.6, "low"),
        ("I-002", "recurring_bottleneck", "b", "AM", 0.65, "high"),
        ("I-003", "incident_pattern_day", "b", "2024-01-03 AM", 0.6, "low"),
        ("I-004", "fd_fit_implausible", "z", None, 0.85, "medium"),
        ("I-005", "data_quality", None, None, 0.9, "high"),
    ]


def test_gates(found):
    qc, eps = found
    capacity = eps.select("sensor_uid").distinct().withColumn("capacity_vphpl", F.lit(1900.0))
    g = gates.episode_gates(discharge.mu_per_episode(eps, qc), capacity)
    got = {r.gate: r.status for r in g.collect()}
    assert got["capacity_band"] == "PASS" and got["mu_over_capacity"] in ("PASS", "REVIEW") and gates.overall(g).first().n_gates == 5


def test_text_issues(spark):
    texts = [(1, "Crash and debris on the 405 northbound near milepost 12.5 at 7:30 am"), (2, "nothing here"), (3, "I-10 WB backed up for miles every day, queue at the merge, recurring"), (4, None)]
    out = {r.item_id: r for r in text_issues.extract_issues(spark.createDataFrame(texts, "item_id long, text string")).collect()}
    assert set(out) == {1, 3}
    assert (out[1].issue_id, out[1].type, out[1].corridor, out[1].direction, out[1].milepost, out[1].time_mention) == ("I-700", "incident_report", "I-405", "NB", 12.5, "7:30 am")
    assert (out[3].type, out[3].corridor, out[3].confidence) == ("capacity_event_report", "I-10", 0.8)


def test_evidence(spark):
    sources = evidence.register_sources(spark.createDataFrame([("a", "feed", "agency_report"), ("b", "posts", "social_context"), ("c", "loop", "measurement")], "name string, kind string, trust_level string"))
    ids = {r.kind: r.source_id for r in sources.collect()}
    claims = [(ids["feed"], "slow", "bottleneck_location", "I-405 N"), (ids["posts"], "jam", "bottleneck_location", "I-405 N"), (ids["posts"], "bug", "software_bug", None), (ids["posts"], "crash", "incident_report", "SR-99"), (ids["posts"], "?", "gossip", "x")]
    cards = evidence.make_cards(spark.createDataFrame(claims, "source_id string, claim_text string, claim_type string, corridor string"), sources)
    assert sorted((r.claim_type, r.confidence_prior) for r in cards.collect()) == [("bottleneck_location", 0.4), ("bottleneck_location", 0.68), ("incident_report", 0.4), ("software_bug", 0.4)]
    found = spark.createDataFrame([("D2", "recurring_bottleneck", "I-405", 0.83), ("D1", "incident", "I-405", 0.9), ("D3", "unreliable_segment_lottr", "I405-NORTH", 0.6)], "issue_id string, type string, corridor string, confidence double")
    got = {r.type: r for r in evidence.compile_evidence(cards, found).collect()}
    assert (got["bottleneck_location"].confidence, got["bottleneck_location"].status, got["bottleneck_location"].n_sources) == (0.9, "needs_planner_review", 2)
    assert got["bottleneck_location"].evidence[-1] == "D2" and not got["bottleneck_location"].needs_detector_check
    assert (got["incident_report"].confidence, got["incident_report"].needs_detector_check, got["incident_report"].severity) == (0.4, True, "low")
    assert got["software_bug"].corridor is None and not got["software_bug"].needs_detector_check and sorted(r.issue_id for r in got.values()) == ["RAG-800", "RAG-801", "RAG-802"]
    assert {r.type: r.confidence for r in evidence.compile_evidence(cards, found, benchmark_pass=True).collect()}["bottleneck_location"] == 0.93
    assert evidence.compile_evidence(cards).where("status = 'open'").count() == 3
    said = spark.createDataFrame([("T1", "capacity_event_report", "I-405", 0.8), ("T2", "work_zone_report", "I-405", 0.5), ("T3", "capacity_event_report", "I-5", 0.5), ("T4", "capacity_event_report", None, 0.5)], "issue_id string, type string, corridor string, confidence double")
    met = {r.issue_id: (r.confidence, r.corroborates, r.needs_detector_check) for r in evidence.corroborate(said, found).collect()}
    assert met == {"T1": (0.9, "D2", False), "T2": (0.5, "D2", False), "T3": (0.5, None, True), "T4": (0.5, None, True)}


def test_panels(spark, simulated):
    assert panels.well_observed(simulated, 0.9).count() == simulated.count()
    assert set(panels.corridor_panel(simulated).columns) == {"corridor", "datetime", *[f"s{i}" for i in range(6)]}


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"1": {"meta": {}, "t0": "2018-03-01 00:00:00", "dt": "5min", "n": 2, "f": [100, 200], "s": [80.45, None], "d": [1, 2]}, "2": {"t0": "2018-03-01", "dt": "5min", "n": 0, "f": [], "s": [], "d": []}}))
    (tmp_path / "i.csv").write_text("sensor_id,Fwy,Dir,Abs_PM,Length,Lanes\n1,10,E,3.5,0.5,4\n")
    rows = readers.read_compact_json(spark, str(tmp_path / "p.json"), str(tmp_path / "i.csv")).orderBy("datetime").collect()
    assert len(rows) == 2 and abs(rows[0].speed_mph - 50) < 1e-9 and rows[1].speed_mph is None and rows[0].corridor == "10-E" and str(rows[1].datetime) == "2018-03-01 00:05:00"
    (tmp_path / "r.csv").write_text("tmc_code,measurement_tstamp,speed,reference_speed,confidence_score\n" + "".join(f"A,2019-01-01 00:0{i}:00,{50 + i},60,{30 if i < 4 else 10}\n" for i in range(6)) + "A,bad,50,60,30\n")
    (tmp_path / "t.csv").write_text("tmc,road,direction,miles,road_order,active_start_date\nA,I-17,N,0.5,1,2018-01-01\nA,I-17,N,0.7,1,2019-01-01\n")
    probe = readers.read_probe(spark, str(tmp_path / "r.csv"), str(tmp_path / "t.csv"), synthesize=True).collect()
    assert len(probe) == 1 and probe[0].speed_mph == 51.5 and probe[0].length_mi == 0.7 and probe[0].flow_synthetic and probe[0].flow_vph > 0
    (tmp_path / "s.csv").write_text("station_id,timestamp,speed,flow,milepost,is_observed\n7.0,2024-01-01T00:00:00Z,80.45,3800,1.5,1\n7.0,2024-01-01T00:05:00Z,80,3800,1.5,0\n")
    (tmp_path / "dataset_meta.json").write_text(json.dumps({"meta_version": 1, "name": "x", "units": {"flow_scope": "all_lanes"}, "loader": "ieee_v4", "files": {"states": "s.csv"}}))
    v4 = readers.read_dataset(spark, str(tmp_path)).collect()
    assert len(v4) == 1 and v4[0].sensor_uid == "v4::7" and v4[0].lanes == 2.0 and v4[0].flow_vph == 1900.0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "dataset_meta.json").write_text("{}")
    with pytest.raises(ValueError, match="lacks"):
        readers.read_dataset(spark, str(tmp_path / "bad"))


def test_sinks(spark, simulated, tmp_path):
    sinks.write_states(simulated, str(tmp_path / "s"))
    assert readers.read_contract(spark, str(tmp_path / "s")).count() == simulated.count()
    point = spark.range(1).select(F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.lit("n").alias("name")).select(sinks.geojson_point("x", "y", "name").alias("j")).first().j
    assert json.loads(point)["geometry"]["coordinates"] == [1.5, 2.5]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"2024-01-01 08:{m:02d}:00", v) for m, v in ((0, 60.0), (1, 40.0), (6, 30.0), (30, 45.0), (59, 60.0))], "sensor_uid string, t string, speed double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, build, want in (("bins", online.resample_stream, 3), ("sessions", lambda x: online.congestion_sessions(x, late="0 minutes"), 1)):
        stream = build(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == want


def _walk_by_loops(drops):
    """The direction check of one day in loops: (bottleneck, in order, checked, reversed)."""
    n, heads = len(drops), []
    for i, d in enumerate(drops):
        near = [x for x in drops[max(0, i - 5) : i + 6] if x is not None]
        if d is not None and d <= min(near) and (not heads or i - heads[-1] > 5):
            heads.append(i)
    ok = checked = 0
    turned = set()
    for c, b in enumerate(heads):
        last = drops[b]
        for j in range(b - 1, (0 if c == 0 else (heads[c - 1] + b) // 2 + 1) - 1, -1):
            if drops[j] is not None:
                checked += 1
                if drops[j] >= last - 1:
                    ok, last = ok + 1, drops[j]
                else:
                    turned.add(j)
    return min(heads, key=lambda i: drops[i]), ok, checked, sorted(turned)


def test_direction_check(spark):
    rng = np.random.default_rng(3)
    days = {}
    for k in range(60):
        n = int(rng.integers(3, 25))
        days[f"d{k:02d}"] = [None if rng.random() < 0.3 else int(x) for x in rng.integers(60, 110, n)]
    days = {d: x for d, x in days.items() if sum(v is not None for v in x) >= 3}
    rows = [("c", d, len(x), sum(v is not None for v in x), x) for d, x in days.items()]
    got = {r.date: r for r in direction.day_checks(spark.createDataFrame(rows, "corridor string, date string, n_places int, n_drops int, drops array<int>")).collect()}
    assert set(got) == set(days)
    for d, x in days.items():
        assert (got[d].bottleneck, got[d].n_ok, got[d].n_checked, got[d].reversed) == _walk_by_loops(x)
    assert direction.day_checks(spark.createDataFrame([("c", "d", 4, 4, [60, 70, 80, 90])], "corridor string, date string, n_places int, n_drops int, drops array<int>")).first().confidence == 0.0


def test_huber_line_and_flags(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0.5, 3, 200)
    y = 2 * x + 1 + rng.normal(0, 0.05, 200)
    y[:4] += 3
    a, b, s = audits.huber_line(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y, strict=True)], "x double, y double"), "x", "y")
    assert abs(a - 2) < 0.05 and abs(b - 1) < 0.08 and s < 0.2
    rows = [(f"s{i}", "2024-01-02", "AM", "c", 60.0 * p, p, 30.0, 50.0, 600.0 * d, 600.0, d, 500.0) for i, (d, p) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    panel = spark.createDataFrame(rows, "sensor_uid string, date string, period string, corridor string, P_min double, P_hours double, V_t2_mph double, v_c_mph double, demand_veh double, capacity_vphpl double, D_over_C_hours double, mu_obs_vphpl double")
    found = {r.sensor_uid for r in audits.with_all_flags(panel).where("outlier_reasons like '%huber_resid_doc_P%'").collect()}
    assert {f"s{i}" for i in range(4)} <= found and len(found) < 20


def test_priors():
    assert priors.resolve("arterial")["vf_mph"] == 45.0 and priors.resolve({"vf_mph": 60.0})["k_critical_vpm"] == 45.0 and priors.resolve()["vf_mph"] == 70.0
    with pytest.raises(ValueError, match="no such preset"):
        priors.resolve("nowhere")


def test_weekday_fits(spark):
    k = np.linspace(20, 120, 12)
    points = spark.createDataFrame([("l", i, float(d), float(65 / (1 + (d / 30) ** 3.5) ** (2 / 3.5)), 120.0) for i, d in enumerate(k)] + [("m", 0, 50.0, 30.0, 60.0)], "link_id string, band int, density double, speed double, most double")
    links = spark.createDataFrame([("l", 65.0, 1900.0), ("m", 65.0, 1900.0), ("x", 65.0, 1900.0)], "link_id string, vf double, capacity_prior double")
    got = {r.link_id: r for r in weekday.fit_diagrams(points, links).collect()}
    assert abs(got["l"].kc - 30) < 0.1 and abs(got["l"].m - 3.5) < 0.05 and got["l"].source == "fit"
    assert got["m"].source == got["x"].source == "prior" and got["x"].cap == 1900
    dc = np.linspace(0.5, 3, 8)
    eps = [("l", "AM", f"d{i}", float(1.2 * d**1.1), float(d), float(0.25 * (1.2 * d**1.1) ** 1.4)) for i, d in enumerate(dc)]
    df = spark.createDataFrame(eps + [("m", "AM", "d0", 1.0, 1.0, 0.3)], "link_id string, period string, date string, P double, DC double, magnitude double")
    fit = weekday.calibrate(df).collect()
    assert len(fit) == 1 and [round(fit[0][p], 3) for p in ("f_d", "n", "f_p", "s")] == [1.2, 1.1, 0.25, 1.4] and fit[0].reliability in ("high", "medium")
    two = spark.createDataFrame([("a", "AM", 1.0, 1.0, 0.2, 1.0, 6, "high"), ("b", "AM", 3.0, 1.0, 0.2, 1.0, 2, "low")], "link_id string, period string, f_d double, n double, f_p double, s double, n_cong int, reliability string")
    assert {r.link_id: r.f_d for r in weekday.shrink(two).collect()} == {"a": 1.0, "b": 0.5 * 3 + 0.5 * 2}


def test_corridor_flow_conserves(spark):
    rng = np.random.default_rng(2)
    rows, speeds = [], {}
    for i, n in enumerate((6, 9, 12)):
        v = rng.uniform(15, 45, n)
        speeds[f"l{i}"] = v
        rows += [("c", f"l{i}", t, float(x), 70.0, 400.0 * n / 4 * (0.9 + 0.1 * i)) for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "corridor string, link_id string, t_min int, speed double, vf double, demand double")
    got = flows.corridor_flow(df, ("link_id",)).toPandas()
    g = {k: v * ((70 / v) ** 3 - 1) ** (1 / 6) for k, v in speeds.items()}
    demand = {r[1]: r[5] for r in rows}
    theta = sum(demand.values()) / (0.25 * sum(x.sum() for x in g.values()))
    assert np.allclose(got.theta, theta)
    for k, part in got.groupby("link_id"):
        assert abs(part.q.sum() * 0.25 - demand[k]) < 1e-3 * demand[k] and np.allclose(sorted(part.q), sorted(np.clip(theta * g[k] + part.slack.iloc[0], 0, None)), rtol=1e-6)
    one = flows.conserving_flow(df, ("link_id",)).groupBy("link_id").agg(F.sum(F.col("q") * 0.25).alias("d"), F.first("demand").alias("demand")).collect()
    assert all(abs(r.d - r.demand) < 1e-6 for r in one)
    assert abs(flows.queue_speeds(spark.createDataFrame([(7.0, 9.0, 2.0, 0.2, 1.3, 49.0, 70.0, 1.0, 1900.0)], "t0 double, t3 double, DC double, f_p double, s double, cutoff double, vf double, length double, cap double")).where("minute = 480").first().model_speed - 49 / (1 + 0.2 * 2**1.3)) < 1e-9


def test_whole_day_model(spark):
    t = np.arange(300, 1320, 15)
    v = 65 - 30 * np.exp(-(((t - 480) / 40) ** 2)) - 25 * np.exp(-(((t - 1020) / 50) ** 2))
    df = spark.createDataFrame([("l", "Weekday", int(a), float(b)) for a, b in zip(t, v, strict=True)], "link_id string, date string, t_min int, speed double")
    cut_ = spark.createDataFrame([("l", 49.0)], "link_id string, cutoff double")
    params = flows.calibrate_periods(df, cut_)
    assert {(r.period, r.f_p, r.s) for r in params.collect()} == {(p, 0.2, 1.3) for p in ("AM", "MD", "PM")}  # one link is too few
    out = {r.t_min: r for r in flows.whole_day(df, cut_, params).collect()}
    sm = np.array([out[int(a)].sm for a in t])
    for lo, hi in ((300, 600), (840, 1320)):
        inside = (t >= lo) & (t < hi)
        at = int(t[inside][sm[inside].argmin()])
        hours = (sm[inside] < 49).sum() / 4
        assert abs(out[at].model_speed - 49 / (1 + 0.2 * hours**1.3)) < 1e-9
    assert max(r.model_speed for r in out.values()) <= out[300].ff and abs(out[300].model_speed - min(sm[0], out[300].ff)) < 1e-9


def test_more_readers_and_sinks(spark, simulated, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "Readings.csv").write_text("tmc_code,measurement_tstamp,speed\n" + "".join(f"A,2019-01-01 00:0{i}:00,{50 + i}\n" for i in range(9)))
    (tmp_path / "x" / "TMC_Identification.csv").write_text("tmc,road,direction,miles,road_order\nA,I-17,N,0.5,1\n")
    (tmp_path / "ngsim_1.csv").write_text("Vehicle ID,Local_Y\n1,2\n")
    (tmp_path / "other_speed.csv").write_text("a,b\n1,2\n")
    assert readers.read_probe_folder(spark, str(tmp_path / "x"), synthesize=True, prior="rural_freeway").count() == 2
    assert readers.read_probe_folder(spark, str(tmp_path / "x"), t_start="2019-01-01 00:05:00").count() == 1
    assert readers.read_probe_folder(spark, str(tmp_path / "x"), tmc_ids=["B"]).count() == 0
    with pytest.raises(FileNotFoundError, match="Reading"):
        readers.read_probe_folder(spark, str(tmp_path))
    assert sorted((r.kind, r.readiness) for r in readers.discover(spark, str(tmp_path)).collect()) == [("inrix_folder", "ready"), ("trajectory", "ready")]
    days = readers.sample_weekdays(simulated).select(F.to_date("datetime").alias("d")).distinct().collect()
    assert len(days) in (2, 3)
    holes = simulated.where("sensor_uid = 'SIM01' and minute(datetime) <> 10")
    grid = readers.on_grid(holes)
    assert grid.count() == 288 * 5 and grid.where("speed_mph is null").count() == 24 * 5
    (tmp_path / "w.csv").write_text("link_id,t_min,avg_weekday_speed_mph,length_mi,lanes\n7,300,55.5,0.4,3\n")
    row = readers.read_weekday(spark, str(tmp_path / "w.csv")).first()
    assert (row.link_id, row.t_min, row.speed, row.flow_pl, row.weekday) == ("7", 300, 55.5, None, 0)
    (tmp_path / "m.csv").write_text("link_id,date,time_minutes,speed,volume_per_lane\n7,2018-03-01,300,55.5,100\n")
    assert tuple(readers.read_weekday(spark, str(tmp_path / "m.csv"), "measured").select("date", "weekday", "flow_pl").first()) == ("2018-03-01", 3, 400.0)
    simulated.limit(50).write.parquet(str(tmp_path / "s"))
    assert readers.read_weekday(spark, str(tmp_path / "s"), "states").count() == 50
    sinks.write_table(simulated.select("sensor_uid", "road_order").distinct(), str(tmp_path / "t"), "csv")
    assert sinks.read_table(spark, str(tmp_path / "t"), "csv").count() == 6
    line = spark.range(1).select(sinks.geojson_line(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), "id").alias("g")).first().g
    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}, "properties": {"id": 0}}


def test_held_out_engines(spark, simulated):
    held = fits.held_out(simulated)
    share = held.agg(F.avg(F.col("held").cast("double"))).first()[0]
    assert 0.2 < share < 0.4 and held.where("held and speed_mph is not null").count() == 0
    got = {r.engine: r for r in fits.engine_arena(simulated, methods=("matrix", "tensor")).collect()}
    assert set(got) == {"persistence", "tod_profile", "matrix", "tensor"} and len({r.n for r in got.values()}) <= 2
    assert got["tod_profile"].mae < got["persistence"].mae  # days are alike, blocks are long


def test_bootstrap_and_newell(spark):
    k = np.linspace(5, 120, 80)
    df = spark.createDataFrame([("s", float(x * 60 * np.exp(-x / 45)), float(x)) for x in k], "sensor_uid string, flow_vph double, density_vpm double")
    got = {r.parameter: r for r in fits.bootstrap_diagrams(df, "Underwood", 15).collect()}
    assert abs(got["p0"].p50 - 60) < 1 and got["capacity"].p5 <= got["capacity"].p95
    speed, lo, hi = fits.ROBUST_MODELS["Newell"]
    v = speed(k, 60.0, 150.0, 2.0)
    assert (np.diff(v) <= 0).all() and v.max() <= 60 and speed(np.array([150.0]), 60.0, 150.0, 2.0)[0] == 0
