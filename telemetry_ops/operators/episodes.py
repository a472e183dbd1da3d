"""Alert episodes, incident detection, operational summaries and the threshold sweep.

Predictions lie on the grid; onsets may lie anywhere. An onset at time o concerns the minutes of
``[o - H, o)``: each incident is expanded to those few grid steps and meets predictions on
(run, service, step), a key that no single service can overload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_ops.functions.ranks import percentiles_of_counts
from telemetry_ops.functions.timeline import CHUNK, OWN, chunk_window, contiguous_runs, running, with_halo
from telemetry_ops.grid import SECOND, Grid, floor_div

PLACE = ["run_id", "service_id"]


def _others(by: list[str]) -> list[str]:
    return [c for c in by if c not in PLACE]


def warned_steps(incidents: DataFrame, grid: Grid) -> DataFrame:
    """Each incident at every grid step of ``[onset - H, onset)``."""
    onset = grid.us("incident_start")
    first = -floor_div(-(onset - grid.horizon_us), grid.step_us)
    last = -floor_div(-onset, grid.step_us) - 1
    return (
        incidents.select(*PLACE, "incident_id", "incident_type", onset.alias("_onset"), first.alias("_a"), last.alias("_b"))
        .where("_a <= _b")
        .select(*PLACE, "incident_id", "incident_type", "_onset", F.explode(F.sequence("_a", "_b")).alias("_step"))
    )


def _stepped(predictions: DataFrame, grid: Grid) -> DataFrame:
    return predictions.withColumn("_step", grid.step("timestamp"))


def alert_episodes(
    predictions: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    by: list[str],
    threshold: Column | float,
) -> DataFrame:
    """Runs of consecutive alerted minutes within a run and service, with ``matched``.

    An episode is matched if any of its alerted minutes lies in some ``[onset - H, onset)``; such a
    minute also makes the incident scorable. ``by`` holds further keys, such as the candidate.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    keys = [*_others(by), *PLACE]
    warned = warned_steps(incidents, grid).select(*PLACE, "_step").distinct()
    alerts = (
        _stepped(predictions, grid)
        .where(F.col("probability") >= threshold)
        .select(*keys, "_step")
        .join(warned.withColumn("_warned", F.lit(True)), [*PLACE, "_step"], "left")
    )
    runs = contiguous_runs(
        alerts,
        keys,
        "_step",
        grid.chunk_points,
        {"matched": F.coalesce("_warned", F.lit(False))},
    )
    return runs.select(
        *keys,
        grid.time("start_step").alias("start"),
        grid.time("end_step").alias("end"),
        F.col("length").alias("alert_points"),
        "matched",
    )


def incident_results(
    predictions: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    by: list[str],
    threshold: Column | float,
) -> DataFrame:
    """Scorable incidents (some eligible minute in ``[onset - H, onset)``), detection and lead.

    The lead runs from the earliest alerted minute of that interval to the onset.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    keys = [*_others(by), *PLACE]
    pairs = _stepped(predictions, grid).join(warned_steps(incidents, grid), [*PLACE, "_step"])
    first = F.min(F.when(F.col("probability") >= threshold, F.col("_step")))
    found = pairs.groupBy(*keys, "incident_id", "incident_type", "_onset").agg(first.alias("_first"))
    lead = (F.col("_onset") - F.col("_first") * grid.step_us) / (60.0 * SECOND)
    return found.select(
        *keys,
        "incident_id",
        "incident_type",
        F.col("_first").isNotNull().alias("detected"),
        lead.alias("lead_minutes"),
    )


def _summarise(exposure: DataFrame, events: DataFrame, episodes: DataFrame, group: list[str], grid: Grid):
    joined = exposure.join(events, group, "left").join(episodes, group, "left")

    def zero(name):
        return F.coalesce(name, F.lit(0))

    scorable, detected = zero("_scorable"), zero("_detected")
    total, matched = zero("_episodes"), zero("_matched")
    days = F.col("_rows") * (grid.step_seconds / 86_400.0)
    return joined.select(
        *group,
        scorable.alias("scorable_incidents"),
        detected.alias("detected_incidents"),
        (scorable - detected).alias("missed_incidents"),
        F.try_divide(detected, scorable).alias("incident_detection_rate"),
        F.col("_mean_lead").alias("mean_lead_minutes"),
        F.col("_median_lead").alias("median_lead_minutes"),
        total.alias("episodes"),
        (total - matched).alias("false_episodes"),
        F.try_divide(matched, total).alias("alert_precision"),
        days.alias("eligible_service_days"),
        F.try_divide(total - matched, days).alias("false_alerts_per_service_day"),
        (zero("_alerts") * (grid.step_seconds / 60.0)).alias("alert_minutes"),
    )


def _lead_statistics(leads: DataFrame, group: list[str]) -> DataFrame:
    """Mean and median of ``lead`` weighted by ``n``.

    Leads are whole microseconds within one horizon, reduced to one row per distinct lead; the
    percentile's buffer therefore holds distinct leads, not incidents.
    """
    reduced = leads.groupBy(*group, "lead").agg(F.sum("n").alias("n"))
    return reduced.groupBy(*group).agg(
        (F.sum(F.col("lead") * F.col("n")) / F.sum("n")).alias("_mean_lead"),
        percentiles_of_counts("lead", [0.5], "n")[0].alias("_median_lead"),
    )


def operational_summary(
    predictions: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    by: list[str],
    threshold: Column | float,
) -> DataFrame:
    """Detection, lead, false-alert and exposure figures per group of ``by``."""
    group = by or ["_all_rows"]
    if not by:
        predictions = predictions.withColumn("_all_rows", F.lit(1))
    exposure = predictions.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    results = incident_results(predictions, incidents, grid, group, threshold)
    leads = results.where("detected").select(*group, F.col("lead_minutes").alias("lead"), F.lit(1).alias("n"))
    events = results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_scorable"), F.count_if("detected").alias("_detected")
    )
    events = events.join(_lead_statistics(leads, group), group, "left")
    episodes = (
        alert_episodes(predictions, incidents, grid, group, threshold)
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("_episodes"),
            F.count_if("matched").alias("_matched"),
            F.sum("alert_points").alias("_alerts"),
        )
    )
    return _summarise(exposure, events, episodes, group, grid).drop("_all_rows")


# -- threshold sweep ------------------------------------------------------------------------------


def default_thresholds() -> list[float]:
    """0, fifty even steps from 0.01 to 0.99, and 1."""
    return [0.0] + [0.01 + 0.02 * i for i in range(50)] + [1.0]


def _expand(spans: DataFrame, group: list[str], count: int) -> DataFrame:
    """Rows for every level ``j`` of ``(lo, hi]``, on spans already reduced to distinct pairs."""
    return spans.where("lo < hi").withColumn(
        "level", F.explode(F.sequence(F.col("lo") + 1, F.col("hi")))
    )


def threshold_sweep(
    predictions: DataFrame,
    incidents: DataFrame,
    grid: Grid,
    by: list[str],
    thresholds: list[float],
) -> DataFrame:
    """Confusion counts and operational figures at every threshold, in one pass over the rows.

    Rows are never copied per threshold. With ``b`` the number of thresholds at or below a score,
    the row alerts at levels 1..b, and every count is a sum over level ranges:

    * an episode starts at a row for the levels above its predecessor's ``b`` (0 after a gap);
    * an incident is detected up to the largest ``b`` in its interval, and a row gives its lead for
      the levels above all earlier rows of the interval;
    * a warned minute is the first of its episode for the levels above the smallest ``b`` since the
      previous warned minute (0 if a gap lies between).

    Each kind is reduced to counts per (group, lo, hi) before levels are expanded.
    """
    levels = sorted(thresholds)
    group = by or ["_all_rows"]
    if not by:
        predictions = predictions.withColumn("_all_rows", F.lit(1))
    keys = [*_others(group), *PLACE]
    reached = F.array(*[F.lit(float(t)) for t in levels])
    rows = _stepped(predictions, grid).withColumn(
        "_b", F.size(F.filter(reached, lambda t: t <= F.col("probability"))).cast("bigint")
    )

    warned = warned_steps(incidents, grid)
    flags = warned.select(*PLACE, "_step").distinct().withColumn("_warned", F.lit(1))
    line = rows.select(*dict.fromkeys([*keys, *group]), "_step", "_b").join(flags, [*PLACE, "_step"], "left")
    line = line.withColumn("_warned", F.coalesce("_warned", F.lit(0)))
    before = chunk_window(keys, "_step").rangeBetween(-1, -1)
    line = (
        with_halo(line, "_step", grid.chunk_points, before=1)
        .withColumn("_previous", F.max("_b").over(before))
        .where(OWN)
    )

    # Episodes and alerted rows.
    starts = (
        line.groupBy(*group, F.coalesce("_previous", F.lit(0)).alias("lo"), F.col("_b").alias("hi"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    episodes = _expand(starts, group, len(levels)).groupBy(*group, "level").agg(F.sum("n").alias("_episodes"))

    # Warned minutes that open a matched episode: number the warned minutes of each timeline, take
    # the lowest level reached between one and the next, and look it up by number.
    numbered = running(line, keys, ["_step"], CHUNK, {"_segment": ("sum", F.col("_warned").cast("bigint"))})
    gap = F.col("_previous").isNull()
    first = F.col("_warned") == 1
    segments = numbered.groupBy(*dict.fromkeys([*keys, *group]), "_segment").agg(
        F.max(F.when(first, F.col("_b"))).alias("hi"),
        F.max(F.when(first, gap.cast("int"))).alias("_gap_at_first"),
        F.least(F.min("_b"), F.min(F.when(~first & gap, F.lit(0)))).alias("_low"),
    )
    earlier = segments.select(*keys, (F.col("_segment") + 1).alias("_segment"), F.col("_low").alias("_bridge"))
    opens = segments.where(F.col("_segment") > 0).join(earlier, [*keys, "_segment"], "left")
    bridge = F.when(
        (F.col("_segment") == 1) | (F.col("_gap_at_first") == 1), F.lit(0)
    ).otherwise(F.coalesce("_bridge", F.lit(0)))
    matched = (
        opens.groupBy(*group, bridge.cast("bigint").alias("lo"), "hi").agg(F.count(F.lit(1)).alias("n"))
    )
    matched = _expand(matched, group, len(levels)).groupBy(*group, "level").agg(F.sum("n").alias("_matched"))

    # Incidents: highest level in the interval, and lead per level. An incident has few steps.
    pairs = rows.select(*dict.fromkeys([*keys, *group]), "_step", "_b").join(warned, [*PLACE, "_step"])
    event = [*dict.fromkeys([*keys, *group]), "incident_id", "_onset"]
    steps = pairs.groupBy(*event).agg(
        F.array_sort(F.collect_list(F.struct("_step", "_b"))).alias("_steps")
    )
    record = F.struct(F.lit(0).cast("bigint").alias("hi"), F.array().cast("array<struct<lo:bigint,hi:bigint,step:bigint>>").alias("out"))
    climbed = F.aggregate(
        "_steps",
        record,
        lambda acc, s: F.when(
            s["_b"] > acc["hi"],
            F.struct(
                s["_b"].alias("hi"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(acc["hi"].alias("lo"), s["_b"].alias("hi"), s["_step"].alias("step"))
                    ),
                ).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    scorable = steps.groupBy(*group).agg(F.count(F.lit(1)).alias("_scorable"))
    records = steps.select(*group, "_onset", F.inline(climbed))
    lead = (F.col("_onset") - F.col("step") * grid.step_us) / (60.0 * SECOND)
    spans = records.groupBy(*group, "lo", "hi", lead.alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    leads = _expand(spans, group, len(levels))
    detected = leads.groupBy(*group, "level").agg(F.sum("n").alias("_detected"))
    lead_figures = _lead_statistics(leads, [*group, "level"])

    # Confusion counts: totals per level bucket, then sums over at most len(levels) + 1 buckets.
    buckets = rows.groupBy(*group, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("target").cast("bigint").alias("_pos")
    )
    by_level = buckets.withColumn(
        "level", F.explode(F.sequence(F.lit(1), F.lit(len(levels))).cast("array<bigint>"))
    ).groupBy(*group, "level")
    alert = F.col("_b") >= F.col("level")
    counted = by_level.agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(alert, F.col("_n")).otherwise(0)).alias("_alerts"),
        F.sum(F.when(alert, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(alert, F.col("_n") - F.col("_pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(~alert, F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~alert, F.col("_n") - F.col("_pos")).otherwise(0)).alias("tn"),
    )
    at = [*group, "level"]
    events = (
        counted.select(*at)
        .join(scorable, group, "left")
        .join(detected, at, "left")
        .join(lead_figures, at, "left")
    )
    alerts = (
        counted.select(*at, "_alerts").join(episodes, at, "left").join(matched, at, "left")
    )
    summary = _summarise(counted.select(*at, "_rows"), events, alerts, at, grid)
    figures = counted.drop("_rows", "_alerts").join(summary, at)
    threshold = F.element_at(reached, F.col("level").cast("int"))
    return (
        figures.withColumn("threshold", threshold)
        .withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
        .withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
        .drop("level", "_all_rows")
    )


