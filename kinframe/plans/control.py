"""A scan that can be watched, paused between its steps, and cancelled."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinframe.operators import catalog as C
from kinframe.plans.engine import MediaEngine

IDLE, SCANNING, COMPARING, DONE, ABORTED, ERROR = "idle", "scanning", "comparing", "done", "aborted", "error"


class Throttle:
    """Lets a value through if it is the first, 100 ms after the last one let through, or 1 % away from it."""

    def __init__(self, seconds: float = 0.1, percent: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.percent, self.clock = seconds, percent, clock
        self._at: float | None = None
        self._value = 0.0

    def passes(self, percent: float) -> bool:
        now = self.clock()
        if self._at is not None and now - self._at < self.seconds and abs(percent - self._value) < self.percent:
            return False
        self._at, self._value = now, percent
        return True


class Scan:
    """catalog -> saved features -> groups -> saved groups, in states idle, scanning, comparing, done, aborted or error.

    ``gather`` makes the table of features, which is saved under ``path``/features as soon as it is whole, so a scan that
    is cancelled while it compares keeps it, and compare() goes on from there. Groups are saved under ``path``/groups.
    Jobs carry a tag of the scan's own, by which cancel() ends them on the cluster; what other threads run isn't touched.
    """

    def __init__(self, engine: MediaEngine, path: str, progress: Callable[[str, float], None] | None = None, states: Callable[[str], None] | None = None):
        self.engine, self.path, self.progress, self.states = engine, path, progress, states
        self.spark: SparkSession = engine.spark
        self.state, self.error = IDLE, None
        self.tag = f"scan-{uuid.uuid4().hex}"
        self._cancelled, self._running = threading.Event(), threading.Event()
        self._running.set()
        self._lock = threading.Lock()

    def _set(self, state: str) -> None:
        if state != self.state:
            self.state = state
            if self.states:
                self.states(state)

    @property
    def busy(self) -> bool:
        return self.state in (SCANNING, COMPARING)

    @property
    def paused(self) -> bool:
        return not self._running.is_set()

    def start(self, gather: Callable[[], DataFrame]) -> str:
        """The whole scan in this thread; the state that it ends in."""
        return self._run(SCANNING, gather)

    def compare(self) -> str:
        """Only the comparison, over the features that an earlier scan has saved."""
        return self._run(COMPARING, None)

    def cancel(self) -> None:
        """Ends the running scan, from another thread; does nothing if none runs."""
        if self.busy:
            self._cancelled.set()
            self._running.set()
            self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def pause(self) -> None:
        """Holds the scan before its next step; tasks that run go on, as Spark has no way to hold them."""
        if self.busy:
            self._running.clear()

    def resume(self) -> None:
        self._running.set()

    def reset(self) -> None:
        """Back to idle, without the error; does nothing while a scan runs."""
        if not self.busy:
            self.error = None
            self._set(IDLE)

    def _step(self, state: str, work: Callable[[], DataFrame], name: str) -> None:
        self._running.wait()
        self._set(state)
        if self._cancelled.is_set():
            raise InterruptedError
        C.save(work(), f"{self.path}/{name}")

    def _run(self, first: str, gather: Callable[[], DataFrame] | None) -> str:
        with self._lock:
            if self.busy:
                raise RuntimeError("a scan is running already")
            self._cancelled.clear()
            self._running.set()
            self.error = None
            self._set(first)
        context = self.spark.sparkContext
        own = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        context.setJobGroup(self.tag, "scan")
        context.addJobTag(self.tag)
        ended = threading.Event()
        watcher = threading.Thread(target=self._watch, args=(ended,), daemon=True)
        watcher.start()
        try:
            if gather is not None:
                self._step(SCANNING, gather, "features")
            self._step(COMPARING, lambda: self.engine.run(C.load(self.spark, f"{self.path}/features")), "groups")
            last = ABORTED if self._cancelled.is_set() else DONE
        except Exception as e:  # whatever a job that was cancelled throws means aborted
            last = ABORTED if self._cancelled.is_set() else ERROR
            self.error = None if last == ABORTED else str(e)
        finally:
            ended.set()
            watcher.join()
            context.removeJobTag(self.tag)
            for k, v in own.items():
                context.setLocalProperty(k, v)
        self._set(last)
        return last

    def _watch(self, ended: threading.Event) -> None:
        """Tells progress: which share of the tasks is done, of the jobs that the scan has started so far."""
        if self.progress is None:
            return
        tracker, throttle = self.spark.sparkContext.statusTracker(), Throttle()
        while not ended.wait(0.05):
            total = done = 0
            for job in tracker.getJobIdsForGroup(self.tag):
                info = tracker.getJobInfo(job)
                for stage in info.stageIds if info else ():
                    s = tracker.getStageInfo(stage)
                    total, done = total + (s.numTasks if s else 0), done + (s.numCompletedTasks if s else 0)
            percent = 100.0 * done / total if total else 0.0
            if throttle.passes(percent):
                self.progress(self.state, percent)


def due(now: dt.datetime, at: dt.time, last: dt.date | None, busy: bool) -> bool:
    """Whether a daily scan must start: it is past its time of day, it hasn't run today, and no scan runs."""
    return not busy and now.time() >= at and (last is None or last < now.date())
