"""Stateful processors: points of trailing windows, and predictions that wait for their outcomes.

Both are keyed by (service, time chunk), so that one busy service is spread over its chunks, and both
drop a chunk's state by an event-time timer. State is one packed row, or a few lists, per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telemetry_ops.grid import STATISTICS, floor_div

MILLI = 1000


def chunks(first: Column, last: Column, length: int) -> Column:
    """One row per chunk of ``length`` that the range touches."""
    return F.explode(F.sequence(floor_div(first, length), floor_div(last, length)))


class WindowPoints(StatefulProcessor):
    """Keeps the points of a chunk and of the window before it; emits windows that become complete.

    A row completes a window when it brings the last missing point, in whatever order points come. A
    point that came twice, or without all its metrics, is a gap to all windows over it.
    """

    def __init__(self, points: int, chunk_points: int, step_us: int, phase_us: int, metrics: tuple[str, ...], scales: dict[str, int]):
        self.points, self.chunk_points, self.step_us, self.phase_us = points, chunk_points, step_us, phase_us
        self.metrics, self.scales = metrics, scales

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("points", "copies binary, metrics binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        service, chunk = key
        size, m = self.chunk_points + self.points - 1, len(self.metrics)
        base = int(chunk) * self.chunk_points - (self.points - 1)
        kinds = [np.dtype("i8" if name in self.scales else "f8") for name in self.metrics]
        if self.state.exists():
            copies, packed = (np.frombuffer(x, dtype=np.int64).copy() for x in self.state.get())
        else:
            copies, packed = np.zeros(size, np.int64), np.zeros(size * m, np.int64)
            end = self.phase_us + (int(chunk) + 1) * self.chunk_points * self.step_us
            self.handle.registerTimer(-(-end // MILLI))
        packed = packed.reshape(m, size)
        values = [packed[i].view(kind) for i, kind in enumerate(kinds)]
        fresh = np.zeros(size, np.int64)
        for frame in rows:
            at = frame["step"].to_numpy(np.int64) - base
            # A point without all its metrics counts like one that came too often.
            np.add.at(copies, at, np.where(frame["whole"].to_numpy(bool), 1, 2))
            fresh[at] = 1
            for name, column in zip(self.metrics, values):
                column[at] = frame[name].to_numpy(column.dtype)
        np.minimum(copies, 2, out=copies)
        self.state.update((copies.tobytes(), packed.tobytes()))
        ends = self._ends(copies == 1, fresh)
        if len(ends):
            yield self._windows(service, base, ends, values)

    def _ends(self, whole: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Last places of the windows that are complete and hold a fresh point."""

        def inside(flags):
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[self.points :] - total[: -self.points]

        return np.flatnonzero((inside(whole.astype(np.int64)) == self.points) & (inside(fresh) > 0)) + self.points - 1

    def _windows(self, service, base: int, ends: np.ndarray, values: list[np.ndarray]) -> pd.DataFrame:
        n = self.points
        spread = n * (n * n - 1) / 6.0  # twice the sum of squared offsets
        offsets = 2 * np.arange(n) - (n - 1)
        at = (self.phase_us + (base + ends) * self.step_us).astype("datetime64[us]")
        found = []
        places = ends[:, None] + np.arange(1 - n, 1)
        for name, column in zip(self.metrics, values):
            w, k = column[places], float(self.scales.get(name, 1))
            total = w.sum(axis=1)
            if name in self.scales:
                std = np.sqrt((n * (w * w).sum(axis=1) - total * total).astype(np.float64)) / (n * k)
            else:
                std = w.std(axis=1)
            figures = {
                "current": w[:, -1] / k, "mean": total / (n * k), "std": std, "min": w.min(axis=1) / k, "max": w.max(axis=1) / k,
                "change": (w[:, -1] - w[:, 0]) / k, "slope": (w * offsets).sum(axis=1) / (spread * k),
            }
            found += [figures[s] for s in STATISTICS]
        rows = list(np.stack(found, axis=1).astype(np.float64))
        return pd.DataFrame({"service_id": np.full(len(ends), service, dtype=object), "timestamp": pd.to_datetime(at), "figures": rows})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


PREDICTION, ONSET, CERTIFICATE = 0, 1, 2


def merged_intervals(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals of the union; touching ones join."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    opens = np.append(True, begins[1:] > reach[:-1])[: len(begins)]
    return begins[opens], reach[np.append(np.flatnonzero(opens)[1:] - 1, len(begins) - 1)] if len(begins) else reach


class DelayedOutcomes(StatefulProcessor):
    """Holds predictions until certificates cover their horizon, then labels them by the onsets in it.

    Certificates count from the time they were recorded, once the watermark has passed it. At the deadline
    what is still waiting leaves as ``uncertified`` and the chunk is forgotten. With a cutoff, records made
    behind it are unknown, and predictions whose horizon ends behind it leave at once as ``immature``.
    """

    def __init__(self, horizon_us: int, chunk_us: int, patience_us: int, cutoff_us: int | None):
        self.horizon, self.chunk, self.patience, self.cutoff = horizon_us, chunk_us, patience_us, cutoff_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, at long, probability double")
        self.onsets = handle.getListState("onsets", "at long")
        self.certificates = handle.getListState("certificates", "begin long, until long, known long")

    def _deadline(self, chunk: int) -> int:
        end = (chunk + 1) * self.chunk + self.horizon + self.patience
        return -(-(end if self.cutoff is None else min(end, self.cutoff)) // MILLI)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        service, chunk = key
        self.handle.registerTimer(self._deadline(int(chunk)))
        frame = pd.concat(list(rows))
        if self.cutoff is not None:
            behind = frame["known"] > self.cutoff
            early = (frame["at"] + self.horizon > self.cutoff) & ~behind
            told = frame[(frame["kind"] == PREDICTION) & (behind | early)]
            if len(told):
                reason = np.where(told["known"] > self.cutoff, "unavailable_prediction", "immature")
                yield self._out(service, told["id"], told["at"].to_numpy(), told["probability"], reason, None)
            frame = frame[~behind & ~((frame["kind"] == PREDICTION) & early)]
        held = frame[frame["kind"] == PREDICTION]
        if len(held):
            self.waiting.appendList(list(zip(held["id"].tolist(), held["at"].tolist(), held["probability"].tolist())))
        found = frame[frame["kind"] == ONSET]
        if len(found):
            self.onsets.appendList([(x,) for x in found["at"].tolist()])
        found = frame[frame["kind"] == CERTIFICATE]
        if len(found):
            self.certificates.appendList(list(zip(found["at"].tolist(), found["until"].tolist(), found["known"].tolist())))
            for known in sorted(set(found["known"].tolist())):
                self.handle.registerTimer(-(-known // MILLI))

    def _out(self, service, ids, at: np.ndarray, probability, reason, target) -> pd.DataFrame:
        n = len(at)
        return pd.DataFrame(
            {
                "id": list(ids), "service_id": [service] * n, "timestamp": pd.to_datetime(at.astype("datetime64[us]")), "probability": list(probability),
                "reason": [None] * n if reason is None else list(reason), "target": pd.array([None] * n if target is None else list(target), dtype="Int64"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        service, chunk = key
        # All that the watermark has passed is done at the first timer; what waits is not read again for each certificate.
        deadline = self._deadline(int(chunk))
        now = max(expiredTimerInfo.getExpiryTimeInMs(), min(timerValues.getCurrentWatermarkInMs(), deadline))
        last = now >= deadline
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        if waiting:
            known = [c for c in (self.certificates.get() if self.certificates.exists() else []) if c[2] <= now * MILLI]
            begins, ends = merged_intervals(np.array([c[0] for c in known], dtype=np.int64), np.array([c[1] for c in known], dtype=np.int64))
            at = np.array([w[1] for w in waiting], dtype=np.int64)
            place = np.searchsorted(begins, at, "right") - 1
            covered = (place >= 0) & (ends[place] >= at + self.horizon) if len(ends) else np.zeros(len(at), dtype=bool)
            onsets = np.sort(np.array([o[0] for o in (self.onsets.get() if self.onsets.exists() else [])], dtype=np.int64))
            ahead = np.searchsorted(onsets, at + self.horizon, "right") > np.searchsorted(onsets, at, "right")
            leaves = covered | last
            if leaves.any():
                chosen = np.flatnonzero(leaves)
                yield self._out(
                    service, [waiting[i][0] for i in chosen], at[chosen], [waiting[i][2] for i in chosen],
                    [None if covered[i] else "uncertified" for i in chosen], [int(ahead[i]) if covered[i] else None for i in chosen],
                )
                self.waiting.clear()
                rest = [tuple(waiting[i]) for i in np.flatnonzero(~leaves)]
                if rest:
                    self.waiting.put(rest)
        if last:
            for state in (self.waiting, self.onsets, self.certificates):
                state.clear()

    def close(self) -> None:
        pass
