"""Decay arithmetic: smoothing and transition guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of the decay guard and the percentage of the peak below which usage counts as gone.
THRESHOLD_SLACK, READY_PERCENT = 0.01, 0.99
#: Trigger, state it needs, state it leads to.
TRANSITIONS = (
    ("activate", "draft", "active"),
    ("start_decay", "active", "decaying"),
    ("mark_ready", "decaying", "ready_to_remove"),
    ("complete", "ready_to_remove", "completed"),
    ("abort", "draft", "aborted"),
    ("abort", "active", "aborted"),
    ("abort", "decaying", "aborted"),
    ("abort", "ready_to_remove", "aborted"),
)
FINAL_STATES = ("completed", "aborted")


def alpha(days: Column) -> Column:
    return F.lit(2.0) / (F.greatest(F.lit(1), days) + 1)


def ewma(values: Column, days: Column) -> Column:
    """The last smoothed value of an ordered array; each step rounds to 4 places and feeds the next."""
    a = alpha(days)
    first = F.round(F.get(values, F.lit(0)), 4)
    return F.when(
        F.size(values) > 0,
        F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), first, lambda e, x: F.round(a * x + (F.lit(1.0) - a) * e, 4)),
    )


def ratio_percent(usage: Column, peak: Column) -> Column:
    return F.try_divide(usage.cast("double"), peak.cast("double")) * 100.0


def may_start_decay(usage: Column, peak: Column, threshold: Column) -> Column:
    return F.when(peak <= 0, F.lit(True)).otherwise(ratio_percent(usage, peak) <= threshold - THRESHOLD_SLACK)


def may_mark_ready(usage: Column, peak: Column) -> Column:
    return F.when(peak <= 0, F.lit(True)).otherwise(ratio_percent(usage, peak) <= READY_PERCENT)


def next_state(state: Column, usage: Column, peak: Column, threshold: Column) -> Column:
    """At most one automatic transition."""
    return (
        F.when((state == "active") & may_start_decay(usage, peak, threshold), F.lit("decaying"))
        .when((state == "decaying") & may_mark_ready(usage, peak), F.lit("ready_to_remove"))
        .otherwise(state)
    )


def replay_states(start: Column, usages: Column, peak: Column, threshold: Column) -> Column:
    """The state after one evaluation per element of an ordered array of usages."""
    return F.aggregate(usages, start, lambda state, usage: next_state(state, usage, peak, threshold))
