"""Steps that several operators read are written once: what is left of a query then reads no events."""

import datetime
import os

import pytest

from queuelens.operators import episodes
from queuelens.plans import registry, states

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", ["speed_errors", "shape_predictions", "queue_curves"])
def test_events_are_not_read_again(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_draws_of_probes_repeat_sums_not_readings(spark):
    plan = registry.queries()["probe_completion"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()


def test_places_of_the_periods_asked_for(spark):
    """Places are those among all rows of a period, and other periods have none."""
    rows = spark.sql("select 'A' sensor_uid, 'C' corridor, timestampadd(MINUTE, 5 * id, timestamp_ntz'2024-01-01 06:00:00') datetime, 40.0 + id % 7 speed_mph, 1000.0 flow_vph from range(160)")
    only = spark.createDataFrame([("A", "2024-01-01", "AM"), ("A", "2024-01-01", "MDPM")], "sensor_uid string, date string, period string")
    every = {(r.period, r.datetime): r.idx for r in episodes.sliced(rows, episodes.day_periods()).collect()}
    some = {(r.period, r.datetime): r.idx for r in episodes.sliced(rows, episodes.day_periods(), only).collect()}
    assert {p for p, _ in every} == {"AM", "MD", "PM", "MDPM"} and {p for p, _ in some} == {"AM", "MDPM"}
    assert some == {k: v for k, v in every.items() if k[0] in ("AM", "MDPM")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_whole_days_read_profiles_not_readings(spark):
    """Of the events only the sensors' numbers are read again; readings of bins outside the profiles are left out at once."""
    plan = registry.queries()["whole_day_models"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode(sequence" not in plan and "posexplode" not in plan


def test_an_event_has_twelve_readings(spark, tmp_path):
    """Five minutes apart from the event's time on, past midnight too; an event without a time has readings without one."""
    rows = spark.sql("select id event_id, case id when 0 then timestamp_ntz'2024-01-04 23:31:07.25' end ts, id user_id, 1.0D value from range(2)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = states.readings(spark, str(tmp_path)).select("user_id", "ts").collect()
    begin = datetime.datetime(2024, 1, 2, 23, 31, 7, 250000)
    assert sorted(r.ts for r in got if r.user_id == 0) == [begin + datetime.timedelta(minutes=5 * i) for i in range(12)]
    assert [r.ts for r in got if r.user_id == 1] == [None] * 12
