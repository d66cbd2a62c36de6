"""Pictures made here, best-copy groups, greedy groups and names against small references."""

import datetime as dt
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltsieve.functions import images as X
from siltsieve.functions import names as M
from siltsieve.operators import photos as P
from siltsieve.operators import videos as V


def png(p, color=0):
    h, w = p.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines, before = b"", np.zeros(w * (3 if color else 1), np.uint8)
    for y, row in enumerate(p.reshape(h, -1).astype(np.uint8)):
        lines += bytes([2]) + (row - before).tobytes() if y % 2 else bytes([0]) + row.tobytes()
        before = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def picture(seed, n=48):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n] / n
    return np.clip(128 + 100 * sum(np.sin(2 * np.pi * (a * x + b * y + c)) / 3 for a, b, c in r.uniform(0, 3, (3, 3))), 0, 255)


def test_decoders():
    p = picture(1).astype(np.uint8)
    assert np.array_equal(X.decode(png(p)), p.astype(float))
    rgb = np.stack([p, p // 2, p // 3], -1)
    assert np.allclose(X.decode(png(rgb, 2)), X.luma(rgb.astype(float)))
    assert np.array_equal(X.decode(b"P5 48 48 255 " + p.tobytes()), p.astype(float))
    assert X.decode(b"\x89PNG broken") is None and X.decode(b"") is None and X.decode(None) is None


def test_resize_keeps_the_mean():
    p = picture(2, 50)
    for n in (8, 32, 33):
        assert np.isclose(X.resize(p, n).mean(), p.mean()) and np.allclose(X.resize(p, n), X.resize_to(p, n, n))


def test_hashes_of_turns_and_pairs():
    a = X.resize(picture(3), 32)
    own = X.perceptual_hashes(a)
    for view, h in zip(X.turns(a), own, strict=True):
        assert (X.perceptual_hashes(view)[0] ^ h).bit_count() <= 1
    near = a + np.random.default_rng(1).normal(0, 1, a.shape)
    assert X.classify_pair(a, near, own, X.perceptual_hashes(near))[0] == "D02"
    assert X.classify_pair(a, a.T[::-1], own, X.perceptual_hashes(a.T[::-1]))[0] == "D03"
    assert X.classify_pair(a, a * 0.8, own, X.perceptual_hashes(a * 0.8))[0] == "D05"
    other = X.resize(picture(4), 32)
    assert X.classify_pair(a, other, own, X.perceptual_hashes(other))[0] is None


def test_border_and_measures():
    p = picture(5)
    framed = np.pad(p, 10, constant_values=255)
    assert np.array_equal(X.trimmed(framed), p) and X.trimmed(p) is None
    m = X.measures(png(p.astype(np.uint8)))
    assert m[5:7] == (48, 48) and len(m[7]) == 8 and len(X.strict_difference_hash(p)) == 64
    assert X.clarity_and_centering(np.full((8, 8), 9.0)) == (0.0, 0.0) and X.screen_measure(np.full((8, 8), 9.0)) == (1.0, 0.0)


def test_best_copy_groups(spark):
    t0, r = dt.datetime(2026, 1, 1), random.Random(4)
    base = [r.getrandbits(63) for _ in range(4)]
    rows = []
    for k in range(60):
        h = base[k % 4] ^ (1 << r.randrange(60) if k % 3 else 0)
        rows.append((k, h, 400 + (k % 5) * 10, 300, None if k % 11 == 0 else t0 + dt.timedelta(seconds=40 * k), k % 13 == 0, 7, r.random(), r.random()))
    df = spark.createDataFrame(rows, "id long, hash long, width int, height int, taken timestamp, is_video boolean, seconds int, clarity double, centering double").repartition(3)
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                same = x[5] == y[5] and x[1] == y[1]
                shot = not x[5] and not y[5] and x[4] and y[4] and abs(x[4] - y[4]) <= dt.timedelta(minutes=3) and (x[1] ^ y[1]).bit_count() <= 6
                a, b = x[2] / x[3], y[2] / y[3]
                if same or (shot and abs(a - b) <= 0.03 * max(a, b)):
                    want.add((x[0], y[0]))
    edges = P.duplicate_edges(df)
    assert {tuple(e) for e in edges.collect()} == want
    members = P.groups(df, edges)
    got = members.collect()
    by = {}
    for m in got:
        by.setdefault(m.group, []).append(m.id)
    assert all(min(v) == g and len(v) > 1 and all((min(a, b), max(a, b)) in want for a in v for b in v if a != b) for g, v in by.items())
    best = {b.group: b.best_id for b in P.best_copies(members).collect()}
    for g, v in by.items():
        own = [rows[i] for i in v]
        score = {m[0]: 0.6 * m[7] / max(x[7] for x in own) + 0.25 * m[8] + 0.15 * m[2] * m[3] / max(x[2] * x[3] for x in own) for m in own}
        tied = [m for m in own if score[m[0]] >= max(score.values()) - 0.02]
        assert best[g] == min(tied, key=lambda m: (-m[2] * m[3], m[4] or dt.datetime(9999, 1, 1), m[0]))[0]
    gone = spark.createDataFrame([(i,) for v in by.values() for i in v[1:]], "id long")
    assert P.without(members, gone).count() == 0


def test_greedy_groups_depend_on_anchors(spark):
    # b is near a and c, a and c are not near: c starts a group of its own
    rows = [(1, 1, 0, 0, 0, 0, 0), (2, 2, 0b11111, 0, 0, 0, 0), (3, 3, 0b1111111111, 0, 0, 0, 0), (4, 4, 0b1111111111, 0, 0, 0, 0), (9, 0, -1, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id long, place long, coarse long, f0 long, f1 long, f2 long, f3 long")
    assert {tuple(r) for r in P.greedy_groups(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_photo_rules(spark):
    rows = [(1, 1, True, 0, True, None, None, None, None), (2, 2, True, 0, False, 5.0, 3.0, 10.0, "x"), (3, 3, True, 0, False, 99.0, 50.0, 900.0, "x"), (4, 4, False, 9, False, 99.0, 50.0, 1.0, "y"), (5, 5, False, 8, False, 99.0, 50.0, 1.0, "y")]
    df = spark.createDataFrame(rows, "id long, place long, is_image boolean, seconds int, unreadable boolean, mean double, std double, sharpness double, hash string")
    got = P.library_verdicts(df).withColumn("reason", P.reason_of(F.col("rules"))).orderBy("id").collect()
    assert [(r.rules, r.reason, r.duplicate_of) for r in got] == [(["R1"], "unreadable", None), (["R2", "R3"], "blank", None), (["R4"], "duplicate", 2), ([], None, None), ([], None, None)]
    soft = spark.createDataFrame([(1, 4.0, 1.0), (2, 2.3, 3.0), (3, 2.5, 1.0), (4, 2.0, 9.0), (5, 1.0, 1.0)], "id long, width_px double, ratio double")
    retake = spark.createDataFrame([(5, 9)], "id long, best_id long")
    assert [(r.id, r.rule) for r in P.blur_verdicts(soft, retake).collect()] == [(1, "B01"), (3, "B02"), (2, "B03"), (5, "B04")]
    assert {r.id: r.shows for r in P.blank_photos(df).collect()} == {2: "black"}
    bits = "1" + "0" * 62 + "1"
    assert spark.range(1).select(P.hash_from_bits(F.lit(bits)).alias("x")).first().x == int(bits, 2) - (1 << 64)


NAMES = [
    ("Screenshot_20260913-201500_Chrome.jpg", "/dcim/x.jpg", "Android", "Chrome", "2026-09-13 20:15:00"), ("Screenshot 2026-09-29 at 10.02.11 PM (2).png", "/a/x", "macOS", None, "2026-09-29 22:02:11"), ("Screenshot (12).png", "/a/x", "Windows", None, None),
    ("Screenshot 2026-10-06 154500.png", "/a/x", "Windows Snipping Tool", None, "2026-10-06 15:45:00"), ("Starfall 2026-10-08 21-14-03.png", "/Captures/x", "Xbox Game Bar", "Starfall", "2026-10-08 21:14:03"), ("Starfall 2026-10-08 21-14-03.png", "/other/x", None, None, None),
    ("Bildschirmfoto 2026-10-08 um 21.14.03.png", "/a/x", "localised", None, "2026-10-08 21:14:03"), ("holiday.png", "/a/x", None, None, None),
]
VIDEO_NAMES = [
    ("VID_20240706_181203~2.mp4", "/a/x", "Android camera", "camera", "2024-07-06 18:12:03"), ("20260910_101500.mp4", "/Camera/x", "Samsung camera", "camera", "2026-09-10 10:15:00"), ("20260910_101500.mp4", "/x/x", None, None, None), ("IMG_0219.MOV", "/a/x", "iPhone camera", "camera", None),
    ("RPReplay_Final1712345678.mp4", "/a/x", "iPhone screen recording", "screenRecording", "2024-04-05 19:34:38"), ("Starfall Odyssey 2025.06.01 - 19.22.40.02.DVR.mp4", "/a/x", "NVIDIA ShadowPlay", "gameplay", "2025-06-01 19:22:40"),
    ("Screen Recording 2025-04-12 at 12.10.11 AM.mov", "/a/x", "macOS screen recording", "screenRecording", "2025-04-12 00:10:11"), ("VID-20240203-WA0007.mp4", "/a/x", "WhatsApp", "messaging", "2024-02-03 00:00:00"), ("DJI_20260512143011_0001_D.MP4", "/a/x", "DJI", "camera", "2026-05-12 14:30:11"),
]


@pytest.mark.parametrize(("rows", "patterns"), [(NAMES, M.SCREENSHOTS), (VIDEO_NAMES, M.VIDEOS)])
def test_names(spark, rows, patterns):
    df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "k int, name string, path string").repartition(2)
    got = {r.k: r for r in df.select("k", M.match_name(F.col("name"), F.col("path"), patterns).alias("m")).select("k", "m.*", F.date_format(M.taken_at(F.col("m")), "yyyy-MM-dd HH:mm:ss").alias("taken")).collect()}
    for k, (name, _, tool, third, taken) in enumerate(rows):
        assert (got[k].tool, got[k].taken) == (tool, taken), name
        assert (got[k].source if patterns is M.VIDEOS else got[k].app) == third


def test_name_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(M.source_from_folders(F.lit("/DCIM/Telegram/a.mp4"))) == "messaging" and one(M.source_from_folders(F.lit("/x/a.mp4"))) == "other"
    assert one(M.folder_run(F.lit("/sd/Android/data/x/a"), ("android", "data"))) and not one(M.folder_run(F.lit("/androidx/data/a"), ("android", "data")))
    assert [one(M.bin_category(F.lit(n))) for n in ("a.JPG", "b.apk", "c", "d.epub")] == ["photo", "app", "other", "document"]
    assert [one(M.worth_compressing(F.lit(n))) for n in ("a.txt", "a.docx", "a.mp3")] == [True, False, False]
    assert [one(M.excluded_reason(F.lit(n), F.lit(p))) for n, p in (("Thumbs.db", "/a/Thumbs.db"), (".x", "/a/.x"), ("a", "/android/obb/a"), ("a", "/a/a"))] == ["system file", "hidden file", "app folder", None]
    assert one(M.photo_copy_name(F.lit("IMG-WA0007.jpg"))) and one(M.loose_screenshot(F.lit("my screen cap.png")))


def test_video_scan(spark):
    now = dt.datetime(2026, 10, 1)
    MB, GB = V.MB, V.GB
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2026, 9, 30)
    mid = dt.datetime(2026, 6, 1)
    rows = [
        (1, "a.mp4", 600 * MB, old, None, None, None), (2, "b.mp4", 3 * GB, mid, None, None, None), (3, "c.mp4", 300 * MB, mid, None, None, 10.0), (4, "d.mp4", 600 * MB, mid, None, None, None), (5, "e.mp4", 150 * MB, old, None, None, None),
        (6, "f.mp4", 600 * MB, new, None, None, None), (7, "IMG_0001.mov", 600 * MB, old, None, None, None), (8, "h.mp4", 5, mid, None, "V02", None), (9, "VID_20240101_000000.mp4", 600 * MB, mid, None, None, None), (10, "j.mp4", 600 * MB, mid, dt.datetime(1970, 1, 1), None, None), (11, "k.mp4", 700 * MB, old, None, None, None),
    ]
    df = spark.createDataFrame([(i, n, f"/m/{n}", s, m, c, 640, 480, 30.0, sec, None, h) for i, n, s, m, c, h, sec in rows], "id long, name string, path string, size_bytes long, modified timestamp, created timestamp, width int, height int, fps double, seconds double, codec string, health string")
    live = V.live_photos(df, spark.createDataFrame([(1, "IMG_0001.HEIC", "/m/IMG_0001.HEIC")], "id long, name string, path string"))
    projects = spark.createDataFrame([("/p", new, ["k.mp4"]), ("/m/sub", new, None), ("/m", old, None)], "folder string, modified timestamp, words array<string>")
    active = V.in_active_projects(df, projects, F.lit(now))
    got = {r.id: (r.rule, r.confidence, r.held) for r in V.judge(df, F.lit(now), live=live, active=active).collect()}
    assert got == {
        1: ("V10", "likely", None), 2: ("V11", "certain", None), 3: ("V12", "certain", None), 4: ("V13", "certain", None), 5: ("V14", "likely", None), 6: (None, None, "recent"), 7: (None, None, "livePhoto"), 8: ("V02", "certain", None),
        9: ("V10", "certain", None), 10: ("V13", "certain", None), 11: (None, None, "activeProject"),
    }
    sure = {r.id: r.rule for r in V.judge(df, F.lit(now), V.VideoRules(certain_only=True, disabled=frozenset({"V11"}))).collect()}
    assert sure[1] == "V13" and sure[2] == "V13" and sure[5] is None
    b = V.batches(V.judge(df, F.lit(now), live=live, active=active)).collect()
    assert [(r.batch, r["items"], r.preselect) for r in b] == [("unplayable", 1, True), ("oldLarge", 2, False), ("huge", 1, False), ("oversized", 1, False), ("large", 2, False), ("old", 1, False)]
    assert next(r.saving_bytes for r in b if r.batch == "oversized") == 300 * MB - round(640 * 480 * 30 * 10 * 0.1 / 8)
