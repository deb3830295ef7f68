"""The campaign state machine as a keyed stream: state, peak and smoothed usage in one stateful processor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pactlens.functions.decay import READY_PERCENT, THRESHOLD_SLACK

#: Fixed value: seconds after a transition in which no other follows.
DEBOUNCE_SECONDS = 5
OUT = "id string, sampled_at timestamp, usage_count bigint, ewma_value double, previous_state string, state string"


def next_state(state: str, usage: int, peak: int, threshold: float) -> str:
    """At most one automatic transition, as the column expression of the same name has it."""
    percent = usage / peak * 100.0 if peak > 0 else None
    if state == "active" and (percent is None or percent <= threshold - THRESHOLD_SLACK):
        return "decaying"
    if state == "decaying" and (percent is None or percent <= READY_PERCENT):
        return "ready_to_remove"
    return state


class CampaignMachine(StatefulProcessor):
    """Evaluates each campaign at its samples' event times, in their order whatever order they come in.

    A sample waits until an event-time timer says that the watermark has passed it, so
    samples of later batches can still come before it; of samples with equal times the largest usage
    counts.  A transition locks the state for DEBOUNCE_SECONDS of event time: samples in between are
    smoothed, but move nothing.  A call of the state store is dear: a batch's samples are stored in
    one, and one timer, for the earliest of them, stands for all that wait.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.campaign = handle.getValueState("campaign", "state string, peak bigint, threshold double, days int, smoothed double, moved_at bigint, timer bigint")
        self.waiting = handle.getListState("waiting", "at bigint, usage bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = lambda c: initialState[c].iat[0]
        self.campaign.update((str(first("state")), int(first("peak_usage")), float(first("usage_threshold_pct")), int(first("decay_window_days")), None, None, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.campaign.get()
        if known is None:
            return iter(())
        samples = []
        for batch in rows:
            samples += zip(batch["sampled_at"].astype("datetime64[us]").astype("int64").tolist(), batch["usage_count"].astype("int64").tolist())
        if samples:
            self.waiting.appendList(samples)
            self._wake(known, min(at for at, _ in samples))
        return iter(())

    def _wake(self, known: tuple, at: int) -> None:
        """A timer for a sample, unless one stands before it.  It fires once the watermark is past it, in whole milliseconds."""
        wanted, standing = at // 1000 + 1, known[6]
        if standing is None or wanted < standing:
            if standing is not None:
                self.handle.deleteTimer(standing)
            self.handle.registerTimer(wanted)
            self.campaign.update((*known[:6], wanted))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No sample up to the watermark can come any more, so all of them are due.
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due, later = {}, []
        for at, usage in self.waiting.get():
            if at // 1000 + 1 <= until:
                due[at] = max(usage, due.get(at, usage))
            else:
                later.append((at, usage))
        state, peak, threshold, days, smoothed, moved_at, _ = self.campaign.get()
        weight, out = 2.0 / (max(1, days) + 1), []
        for at, usage in sorted(due.items()):
            smoothed = round(float(usage) if smoothed is None else weight * usage + (1 - weight) * smoothed, 4)
            locked = moved_at is not None and at - moved_at < DEBOUNCE_SECONDS * 1_000_000
            after = state if locked else next_state(state, usage, peak, threshold)
            moved_at = at if after != state else moved_at
            out.append((key[0], at, usage, smoothed, state, after))
            state = after
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        known = (state, peak, threshold, days, smoothed, moved_at, None)
        if later:
            self._wake(known, min(at for at, _ in later))
        else:
            self.campaign.update(known)
        if out:
            found = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            found["sampled_at"] = found["sampled_at"].astype("datetime64[us]")
            yield found

    def close(self) -> None:
        pass


def evaluate_stream(samples: DataFrame, campaigns: DataFrame, late: str = "1 day") -> DataFrame:
    """id, sampled_at, usage_count, ewma_value, previous_state, state of every evaluation, once its time is final.

    samples(id, sampled_at, usage_count) is a stream; campaigns(id, state, peak_usage, usage_threshold_pct,
    decay_window_days) is what the machine starts from, one row per id.  Samples of unknown campaigns,
    and those that come later than `late`, count for nothing.  The session's state store must be
    RocksDB.  State is one row per campaign and its samples of the last `late`.
    """
    start = campaigns.select("id", "state", "peak_usage", "usage_threshold_pct", "decay_window_days").groupBy("id")
    keyed = samples.select("id", "sampled_at", "usage_count").withWatermark("sampled_at", late).groupBy("id")
    return keyed.transformWithStateInPandas(CampaignMachine(), outputStructType=OUT, outputMode="Append", timeMode="EventTime", initialState=start)
