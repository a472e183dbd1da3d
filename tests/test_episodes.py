import random

import pytest

from telemetry_ops.grid import Grid
from telemetry_ops.operators import episodes
from tests.helpers import MINUTES, ORIGIN, TINY, incidents, predictions


def _one(df):
    (row,) = df.collect()
    return row.asDict()


@pytest.mark.parametrize("minute, lead", [(10, 10.0), (19, 1.0), (20, None), (9, None)])
def test_lead_boundaries(spark, minute, lead):
    rows = predictions(spark, [("r", "a", m, 1.0 if m == minute else 0.0) for m in range(2, 30)])
    (found,) = episodes.incident_results(rows, incidents(spark, [("r", "a", 20)]), MINUTES, [], 0.5).collect()
    assert (found["detected"], found["lead_minutes"]) == (lead is not None, lead)


@pytest.mark.parametrize("grid", [MINUTES, TINY])
def test_always_on_forecast_is_one_episode(spark, grid):
    rows = predictions(spark, [("r", "a", m, 1.0) for m in range(5, 22)])
    found = _one(episodes.operational_summary(rows, incidents(spark, [("r", "a", 20)]), grid, [], 0.5))
    assert found["episodes"] == 1 and found["false_episodes"] == 0
    assert found["alert_minutes"] == 17 and found["mean_lead_minutes"] == 10
    assert found["eligible_service_days"] == pytest.approx(17 / 1440)


@pytest.mark.parametrize("grid", [MINUTES, TINY])
def test_gaps_services_and_runs_break_episodes(spark, grid):
    minutes = (2, 3, 5, 7)
    rows = predictions(spark, [(r, s, m, 0.9) for r in "pq" for s in "ab" for m in minutes])
    found = episodes.alert_episodes(rows, incidents(spark, [("p", "a", 8)]), grid, [], 0.5)
    spans = sorted((r["run_id"], r["service_id"], r["alert_points"], r["matched"]) for r in found.collect())
    assert len(spans) == 12 and sum(n for _, _, n, _ in spans) == 16
    assert {(r, s) for r, s, _, hit in spans if hit} == {("p", "a")}


def test_onset_off_the_grid(spark):
    rows = predictions(spark, [("r", "a", m, 1.0 if m == 11 else 0.0) for m in range(30)])
    (found,) = episodes.incident_results(rows, incidents(spark, [("r", "a", 20.5)]), MINUTES, [], 0.5).collect()
    assert found["lead_minutes"] == 9.5


def test_incident_without_eligible_minutes_is_not_scorable(spark):
    rows = predictions(spark, [("r", "a", m, 1.0) for m in range(5)])
    assert episodes.incident_results(rows, incidents(spark, [("r", "a", 40)]), MINUTES, [], 0.5).count() == 0


def _brute(rows, truth, threshold):
    """Minute-by-minute scoring in plain Python."""
    lines = {}
    for r, s, m, p, y in rows:
        lines.setdefault((r, s), []).append((m, p, y))
    result = dict(tp=0, fp=0, fn=0, tn=0, episodes=0, matched=0, scorable=0, alerts=0)
    leads = []
    for place, line in lines.items():
        line.sort()
        onsets = [m for r, s, m in truth if (r, s) == place]
        runs = []
        for m, p, y in line:
            hit = p >= threshold
            result[("t" if hit == bool(y) else "f") + ("p" if hit else "n")] += 1
            if hit:
                if runs and runs[-1][-1] == m - 1:
                    runs[-1].append(m)
                else:
                    runs.append([m])
        result["episodes"] += len(runs)
        result["alerts"] += sum(map(len, runs))
        result["matched"] += sum(any(o - 10 <= m < o for m in run for o in onsets) for run in runs)
        for o in onsets:
            if any(o - 10 <= m < o for m, _, _ in line):
                result["scorable"] += 1
                hits = [m for run in runs for m in run if o - 10 <= m < o]
                leads += [o - min(hits)] if hits else []
    leads.sort()
    middle = len(leads) // 2
    median = None if not leads else (leads[middle] if len(leads) % 2 else (leads[middle - 1] + leads[middle]) / 2)
    return result, len(leads), median


@pytest.mark.parametrize("chunk", [4, 1440])
def test_sweep_equals_scoring_each_threshold(spark, chunk):
    draw = random.Random(11)
    rows = [
        (r, s, m, draw.choice([0, 0.2, 0.3, 0.35, 0.5, 0.7, 0.99, 1]), draw.randint(0, 1))
        for r in ("r1", "r2") for s in "ab" for m in range(70) if draw.random() > 0.1
    ]
    truth = [(r, s, draw.choice([12, 13.5, 18, 30, 30, 47.25, 66, 90])) for r in ("r1", "r2") for s in "ab" for _ in range(3)]
    truth = sorted(set(truth))
    levels = [0, 0.2, 0.31, 0.5, 0.71, 1.0]
    grid = Grid(ORIGIN, chunk_points=chunk)
    swept = episodes.threshold_sweep(predictions(spark, rows), incidents(spark, truth), grid, [], levels)
    found = {r["threshold"]: r for r in swept.collect()}
    assert sorted(found) == levels
    for level in levels:
        want, detected, median = _brute(rows, truth, level)
        row = found[level]
        assert [row[k] for k in ("tp", "fp", "fn", "tn")] == [want[k] for k in ("tp", "fp", "fn", "tn")]
        assert row["scorable_incidents"] == want["scorable"] and row["detected_incidents"] == detected
        assert row["episodes"] == want["episodes"]
        assert row["false_episodes"] == want["episodes"] - want["matched"]
        assert row["alert_minutes"] == want["alerts"] and row["median_lead_minutes"] == median


def test_default_thresholds():
    levels = episodes.default_thresholds()
    assert len(levels) == 52 and levels[0] == 0 and levels[-1] == 1 and levels[1] == 0.01

