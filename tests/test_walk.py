"""Folders listed level by level, and dates from headers that the tests make."""

import datetime as dt
import io
import os
import struct

import pytest

from kinframe.config import ScanConfig
from kinframe.sources import walk as W


def tree(top, names):
    for n in names:
        p = top / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(n))


def test_walk(spark, tmp_path):
    tree(tmp_path, ["a/1.mp4", "a/2.txt", "a/deep/er/3.MKV", "a/Skip/4.mp4", "a/tmp_1/5.mp4", "a/b/tmp_2/6.mp4", "a/.hidden/7.mp4", "a/8.jpg", "c/9.mp4", "closed/10.mp4"])
    os.symlink(tmp_path / "a", tmp_path / "a/deep/loop")
    os.symlink(tmp_path / "c", tmp_path / "a/link")
    (tmp_path / "file").write_bytes(b"")
    a, c = f"{tmp_path}/a", f"{tmp_path}/c"
    roots = (a, c + "/", f"{a}/deep", f"{tmp_path}/gone", f"{tmp_path}/file")
    files, missed = W.walk(spark, ScanConfig(include=roots, exclude=(f"{a.upper()}/SKIP", "TMP_?", f"{a}/.hid*")))
    got = {r.path: r for r in files.collect()}
    assert sorted(got) == sorted([f"{a}/1.mp4", f"{a}/8.jpg", f"{a}/deep/er/3.MKV", f"{a}/link/9.mp4", f"{c}/9.mp4"])
    one = got[f"{a}/1.mp4"]
    assert (one.folder, one.file_size) == (a, 7) and abs((one.modified - dt.datetime.fromtimestamp(os.stat(one.path).st_mtime, dt.UTC).replace(tzinfo=None)).total_seconds()) < 1
    assert sorted((r.path, r.is_root, r.reason) for r in missed.collect()) == [(f"{tmp_path}/file", True, "missing"), (f"{tmp_path}/gone", True, "missing")]
    files, _ = W.walk(spark, ScanConfig(include=(a,), recursive=False, images=False))
    assert [r.path for r in files.collect()] == [f"{a}/1.mp4"]
    files, _ = W.walk(spark, ScanConfig(include=(a,), skip_reparse_points=True))
    assert not [r for r in files.collect() if "link" in r.path or "loop" in r.path]
    files, missed = W.walk(spark, ScanConfig())
    assert files.count() == missed.count() == 0
    by_uri, _ = W.walk(spark, ScanConfig(include=(f"file://{c}",)))
    assert [r.path for r in by_uri.collect()] == [f"file://{c}/9.mp4"]


def test_failed_listings_are_told_and_the_rest_goes_on(monkeypatch):
    calls = []

    def entries(folder, config, read_only):
        calls.append(folder)
        if folder == "/closed":
            raise PermissionError
        if folder == "/slow" and calls.count("/slow") < 3 or folder == "/dead":
            raise OSError(5, "no answer")
        yield "file", folder + "/x.mp4", 1, 0.0

    import pandas as pd

    monkeypatch.setattr(W, "_entries", entries)
    monkeypatch.setattr(W, "WAIT_S", 0)
    out = pd.concat(W._level(ScanConfig(), True)(iter([pd.DataFrame({"path": ["/closed", "/slow", "/dead", "/ok"]})])))
    assert list(zip(out["kind"], out["path"], out["reason"])) == [("error", "/closed", "inaccessible"), ("file", "/slow/x.mp4", None), ("error", "/dead", "failed: no answer"), ("file", "/ok/x.mp4", None)]
    assert calls.count("/slow") == calls.count("/dead") == 3


TAKEN, CHANGED = b"2021:03:04 05:06:07\0", b"2022:01:01 00:00:00\0"


def block(order, taken=TAKEN, changed=CHANGED, kind=2):
    """Tags: the date of change, a pointer to a second directory, there the date it was taken."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    tags = ([(0x0132, kind, len(changed), changed)] if changed else []) + ([(0x8769, 4, 1, None)] if taken else [])
    data_at = 8 + 2 + 12 * len(tags) + 4
    sub_at = data_at + len(changed or b"")
    out = head + struct.pack(order + "H", len(tags))
    for tag, k, n, v in tags:
        out += struct.pack(order + "HHII", tag, k, n, sub_at if v is None else data_at)
    out += bytes(4) + (changed or b"")
    if taken:
        out += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, len(taken), sub_at + 2 + 12 + 4) + bytes(4) + taken
    return out


def jpeg(b):
    part = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>") + part(0xE1, b"Exif\0\0" + b) + part(0xDA, b"") + b"\0" * 50


def png(b, before=True):
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + b"crc!"
    parts = [part(b"IHDR", b"\0" * 13), part(b"eXIf", b), part(b"IDAT", b"pixels")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts if before else [parts[0], parts[2], parts[1]]) + part(b"IEND", b"")


def webp(b):
    part = lambda n, d: n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    body = b"WEBP" + part(b"VP8 ", b"odd") + part(b"EXIF", b)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("order", ["<", ">"])
def test_dates(order):
    taken, changed = dt.datetime(2021, 3, 4, 5, 6, 7), dt.datetime(2022, 1, 1)
    of = lambda data: W.date_taken(io.BytesIO(data))
    for wrap in (lambda b: b, jpeg, png, webp, lambda b: webp(b"Exif\0\0" + b)):
        assert of(wrap(block(order))) == taken
        assert of(wrap(block(order, taken=None))) == changed
        assert of(wrap(block(order, taken=None, changed=None))) is None
        assert of(wrap(block(order, taken=b"not a date at all!!\0"))) is None
        assert of(wrap(block(order, taken=None, kind=7))) is None
    assert of(png(block(order), before=False)) is None
    whole = jpeg(block(order))
    for n in range(len(whole)):  # cut anywhere
        assert of(whole[:n]) in (None, taken, changed)
    assert of(b"") is of(b"GIF89a" + bytes(40)) is None


def test_header_dates(spark, tmp_path):
    for name, data in (("a.jpg", jpeg(block("<"))), ("b.png", png(block(">"))), ("c.jpg", b"junk")):
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"{tmp_path}/a.jpg", 1), (f"{tmp_path}/b.png", 2), (f"{tmp_path}/c.jpg", 3), (f"{tmp_path}/none.jpg", 4), (None, 5), (f"file://{tmp_path}/a.jpg", 6)], "path string, n int")
    got = {r.n: r.date_taken for r in W.header_dates(files).collect()}
    at = dt.datetime(2021, 3, 4, 5, 6, 7)
    assert got == {1: at, 2: at, 3: None, 4: None, 5: None, 6: at}
