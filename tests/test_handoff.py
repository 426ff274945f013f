"""What the average-weekday method hands on, against plain recomputation."""

import math

import pytest

from queuelens.operators import handoff

BINS = "link_id string, t_min int, speed double, sm double, model_speed double, flow_pl double, lanes double, length double, cutoff double, period string"
NET = "corridor string, link_id string, vf double, uc double, cap double"


def _link(name, speeds, flow, start=300):
    return [(name, start + 15 * i, float(v), float(v), float(v), flow, 2.0, 0.5, 49.0, "x") for i, v in enumerate(speeds)]


@pytest.fixture(scope="module")
def table(spark):
    dip = [65, 60, 45, 30, 35, 48, 60, 66]
    rows = _link("a", dip, 1000.0) + _link("b", dip, None) + _link("few", dip[:5], 900.0) + _link("late", [65, 66, 67, 66, 40, 66, 65, 64], 800.0, 1170)
    links = [("C", n, 70.0, 49.0, 1050.0) for n in ("late", "b", "a", "few")]
    got = handoff.time_table(spark.createDataFrame(rows, BINS), spark.createDataFrame(links, NET), m=4.0).collect()
    return {(r.link_id, r.t_min): r for r in got}


def test_conserved_flows_meet_their_demand_at_one_scale(table):
    slow = {n: [r for (link, _), r in sorted(table.items()) if link == n and r.q_per_lane is not None] for n in ("a", "b")}
    assert [len(x) for x in slow.values()] == [4, 4]
    assert sum(r.q_per_lane for r in slow["a"]) * 0.25 == pytest.approx(1000.0, abs=0.5)  # four counts of 250 a lane
    assert sum(r.q_per_lane for r in slow["b"]) * 0.25 == pytest.approx(1050.0, abs=0.5)  # nothing counted: the capacity
    assert {r.theta for x in slow.values() for r in x} == {slow["a"][0].theta}
    assert slow["a"][0].slack < 0 < slow["b"][0].slack
    assert all(r.count_conserved == pytest.approx(r.q_per_lane * 0.5, abs=0.06) for r in slow["a"])


def test_rows_counts_and_nodes(table):
    assert {n for n, _ in table} == {"a", "b", "late"}  # five bins are too few
    assert {n: (r.from_node_id, r.to_node_id) for (n, _), r in table.items()} == {"a": (1, 2), "b": (2, 3), "late": (4, 5)}
    r = table["a", 345]
    assert (r.count_per_lane, r.count_total, r.vmt) == (250.0, 500.0, 250.0)
    assert r.vht == pytest.approx(250 / 30, abs=1e-3) and r.vdt == pytest.approx(250 / 30 - 250 / 70, abs=1e-3) and r.vcdt == pytest.approx(250 / 30 - 250 / 49, abs=1e-3)
    assert table["a", 300].vcdt == 0.0
    none = table["b", 345]
    assert (none.count_total, none.vht, none.vdt, none.vcdt, none.co2_g_model) == (None,) * 5
    assert [table["late", t].period for t in (1185, 1200)] == ["PM", "NT"]
    assert table["late", 1230].q_per_lane is None  # a single slow bin


EPISODES = "link_id string, date string, period string, P double, demand double, DC double, v_t2 double, cutoff double"
PARAMS = "link_id string, period string, f_d double, n double, f_p double, s double"


def _inputs(spark):
    eps = [
        ("a", "2024-01-01", "AM", 2.0, 2400.0, 1.5, 30.0, 49.0),
        ("a", "2024-01-08", "AM", 3.0, 3600.0, 2.5, 20.0, 49.0),
        ("a", "2024-01-02", "PM", 3.0, 9000.0, 2.0, 40.0, 49.0),
        ("a", "2024-01-03", "PM", 0.0, 9000.0, 6.0, 60.0, 49.0),
        ("free", "2024-01-03", "AM", 0.0, 9000.0, 6.0, 60.0, 49.0),
    ]
    params = [(n, p, 1.3, 1.1, 0.2, 1.2) for n in ("a", "free") for p in ("AM", "PM")]
    return spark.createDataFrame(eps, EPISODES), spark.createDataFrame(params, PARAMS)


def test_errors_of_links_leave_free_days_out(spark):
    got = {(r.link_id, r.period): r for r in handoff.link_errors(*_inputs(spark)).collect()}
    assert set(got) == {("a", "AM"), ("a", "PM")}
    model = 49 / (1 + 0.2 * 2.5**1.2)
    assert got["a", "AM"][2:] == (2, 25.0, pytest.approx(model, abs=1e-3), pytest.approx(model - 25, abs=1e-3), pytest.approx((model - 25) / 25 * 100, abs=1e-2))


def test_gammas_by_day_of_the_week(spark):
    links = spark.createDataFrame([("a", 49.5, 1900.0, 0.5)], "link_id string, uc double, cap double, length double")
    got = {(r.period, r.weekday): r for r in handoff.weekday_gammas(*_inputs(spark), links).collect()}
    assert set(got) == {("AM", 0), ("PM", 1)}
    for (key, dc, mu) in ((("AM", 0), 2.0, 1200.0), (("PM", 1), 2.0, 1900.0)):  # the second is bounded by the capacity
        p = 1.3 * dc**1.1
        want = (dc, p, 49 / (1 + 0.2 * p**1.2), 49 / (1 + 8 / 15 * 0.2 * 1.3**1.2 * dc ** (1.1 * 1.2)), 64 * mu * (0.5 / 49.5) * 0.2 * math.pow(p, 1.2 - 4))
        assert got[key][3:] == pytest.approx(want, abs=1e-3)


def test_parameters_are_those_of_the_longest_episode(spark):
    links = spark.createDataFrame([("C", n, 70.0, 49.0, 1800.0) for n in ("a", "free")], NET)
    got = {r.link_id: r for r in handoff.link_parameters(*_inputs(spark), links).collect()}
    assert got["a"].dominant_period == "AM"  # AM and PM tie at three hours
    assert (got["free"].dominant_period, got["free"].f_d, got["free"].alpha) == (None, None, None)
    assert got["a"].alpha == pytest.approx(8 / 15 * 0.2 * 1.3**1.2, abs=1e-4)
