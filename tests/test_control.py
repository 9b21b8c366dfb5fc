"""States, cancelling, pausing and progress of scans."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.operators import catalog as C
from kinframe.plans import control
from kinframe.plans.engine import MediaEngine
from kinframe.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def scan_of(spark, path, **more):
    return control.Scan(MediaEngine(spark, ScanConfig(whole_catalog=True, percent=96)), str(path), **more)


def slow(items):
    @F.udf("double")
    def wait(x):
        time.sleep(0.5)
        return x

    return items.withColumn("duration_s", wait("duration_s"))


def wait_for(scan, state):
    end = time.monotonic() + 60
    while scan.state != state and time.monotonic() < end:
        time.sleep(0.02)
    assert scan.state == state


def test_a_scan_ends_and_tells_its_states_and_progress(spark, tmp_path):
    seen, told = [], []
    scan = scan_of(spark, tmp_path, states=seen.append, progress=lambda s, p: told.append(p))
    assert scan.start(lambda: D.items(spark, SF)) == control.DONE
    assert seen == ["scanning", "comparing", "done"] and scan.error is None
    assert C.load(spark, f"{tmp_path}/features").count() == D.items(spark, SF).count()
    assert C.load(spark, f"{tmp_path}/groups").count() > 0
    assert told and all(0 <= p <= 100 for p in told)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None and scan.tag not in spark.sparkContext.getJobTags()


def test_a_scan_cancelled_while_it_scans_is_aborted(spark, tmp_path):
    scan = scan_of(spark, tmp_path)
    t = threading.Thread(target=scan.start, args=(lambda: slow(D.items(spark, SF)),))
    t.start()
    wait_for(scan, control.SCANNING)
    with pytest.raises(RuntimeError):
        scan.start(lambda: D.items(spark, SF))
    time.sleep(1)
    scan.cancel()
    t.join(30)
    assert not t.is_alive() and scan.state == control.ABORTED
    assert C.versions(spark, f"{tmp_path}/features") == []
    scan.reset()
    assert scan.state == control.IDLE
    assert scan.start(lambda: D.items(spark, SF)) == control.DONE


def test_a_scan_cancelled_while_it_compares_keeps_its_features(spark, tmp_path):
    scan = scan_of(spark, tmp_path)
    scan.states = lambda s: scan.cancel() if s == control.COMPARING else None
    assert scan.start(lambda: D.items(spark, SF)) == control.ABORTED
    assert C.load(spark, f"{tmp_path}/features").count() == D.items(spark, SF).count()
    assert C.versions(spark, f"{tmp_path}/groups") == []
    scan.states = None
    assert scan.compare() == control.DONE


def test_a_paused_scan_waits(spark, tmp_path):
    scan = scan_of(spark, tmp_path)
    scan.states = lambda s: scan.pause() if s == control.SCANNING else None
    t = threading.Thread(target=scan.start, args=(lambda: D.items(spark, SF),))
    t.start()
    wait_for(scan, control.SCANNING)
    time.sleep(1)
    assert scan.paused and t.is_alive() and C.versions(spark, f"{tmp_path}/features") == []
    scan.resume()
    t.join(60)
    assert scan.state == control.DONE


def test_an_error_is_told(spark, tmp_path):
    scan = scan_of(spark, tmp_path)
    assert scan.compare() == control.ERROR
    assert "no committed version" in scan.error


def test_throttle():
    now = [0.0]
    t = control.Throttle(clock=lambda: now[0])
    assert t.passes(0)
    now[0] = 0.05
    assert not t.passes(0.5) and t.passes(1.0)
    now[0] = 0.10
    assert not t.passes(1.5)
    now[0] = 0.16
    assert t.passes(1.5)


def test_daily_scan():
    at, day = dt.time(3, 30), dt.date(2024, 5, 2)
    assert control.due(dt.datetime(2024, 5, 2, 3, 30), at, None, False)
    assert control.due(dt.datetime(2024, 5, 2, 9, 0), at, day - dt.timedelta(1), False)
    assert not control.due(dt.datetime(2024, 5, 2, 9, 0), at, day, False)
    assert not control.due(dt.datetime(2024, 5, 2, 3, 29), at, None, False)
    assert not control.due(dt.datetime(2024, 5, 2, 9, 0), at, None, True)
