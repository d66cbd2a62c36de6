"""Formats and the empty & unreadable scan on files made here."""

import datetime as dt
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from siltsieve.functions import formats as X
from siltsieve.operators import health as H


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")
BOX = lambda kind, data=b"": struct.pack(">I", 8 + len(data)) + kind + data


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr({"types": "[Content_Types].xml"}.get(k, k), v)
    return out.getvalue()


CASES = [
    ("a.zip", b"", "E01"), (".nomedia", b"", None), ("x.lock", b"", None), ("a.txt", b" \n\0", "E02"), ("a.docx.crdownload", b"abc", "U03"), ("a.jpg", b"\0" * 9000, "U04"), ("a.pdf", b"\0" * 5000 + b"x" * 5000, "U05"),
    ("a.pdf", b"<!DOCTYPE html><p>no</p>", "U05"), ("a.pdf", b"%PDF-1.4 /Type /Page /Count 1 %%EOF", None), ("a.pdf", b"%PDF-1.4 /Type /Pages /Count 0 %%EOF", "E05"), ("a.pdf", b"%PDF-1.4 /Type /Page", "U06"),
    ("a.png", PNG, None), ("a.png", PNG[:-14], "U06"), ("a.png", PNG.replace(b"IDAT", b"IDAX"), "U07"), ("a.jpg", PNG, None), ("a.jpg", b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xx\xff\xd9", None),
    ("a.jpg", b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xx", "U06"), ("a.gif", b"GIF89a" + b"x" * 20 + b";", None), ("a.gif", b"GIF89a" + b"x" * 40, "U06"), ("a.zip", zipped(a="text"), None), ("a.zip", zipped(), "E04"), ("a.zip", zipped(a=""), "E04"),
    ("a.docx", zipped(types="x"), None), ("a.docx", zipped(a="x"), "U07"), ("a.docx", zipped(), "U07"), ("a.zip", zipped(a="text" * 50)[:-30], "U06"), ("b.zip", b"MZ stub" + zipped(a="text"), "U05"),
    ("a.mp4", BOX(b"ftyp", b"isom") + BOX(b"moov") + BOX(b"mdat", b"xyz"), None), ("a.mp4", BOX(b"ftyp", b"isom") + BOX(b"mdat", b"xyz"), "U06"), ("a.mp4", BOX(b"ftyp", b"isom") + BOX(b"moov"), "E05"),
    ("a.mp4", BOX(b"ftyp", b"isom") + struct.pack(">I", 999) + b"mdat", "U06"), ("a.heic", BOX(b"ftyp", b"heic"), None), ("a.mp3", b"ID3\4\0\0\0\0\0\x05hello", "E05"), ("a.mp3", b"ID3\4\0\0\0\0\0\x05hello" + b"\xff\xfbsound", None),
    ("a.ogg", b"OggS\0\4rest", None), ("a.ogg", b"OggS\0\0rest", "U06"), ("a.rtf", b"{\\rtf1 {a\\}} b}", None), ("a.rtf", b"{\\rtf1 {a} b", "U06"), ("a.gz", b"\x1f\x8b\x08" + b"x" * 20 + b"\0\0\0\0", "E04"), ("a.7z", b"7z\xbc\xaf'\x1c" + b"\0" * 40, "E04"),
    ("a.json", b'{"a": 1}', None), ("a.json", b"{}", "E03"), ("a.json", b"0", None), ("a.json", b'{"a": [1, "]"', "U06"), ("a.json", b'{"a" 1}', "U07"), ("a.json", b'{"a": 1}\n{"a": 2}', None),
    ("a.csv", b",,\n\"\",", "E03"), ("a.csv", b"name,age\n", "E03"), ("a.csv", b"1,2\n", None), ("a.html", b"<html><head><title>t</title></head><body>&nbsp;</body></html>", "E03"), ("a.html", b"<body><img src=x></body>", None),
    ("a.xml", b"<?xml version='1.0'?><a></a>", "E03"), ("a.xml", b"<a><b/></a>", None), ("a.svg", b"<svg></svg>", "E03"), ("a.svg", b"<svg><path/></svg>", None), ("a.svg", b"<b>no</b>", "U05"), ("a.vcf", b"BEGIN:VCARD\nFN:\nEND:VCARD", "E03"),
    ("a.vcf", b"BEGIN:VCARD\nitem1.TEL;TYPE=cell:123\nEND:VCARD", None), ("a.ics", b"BEGIN:VCALENDAR\nEND:VCALENDAR", "E03"), ("a.ics", b"BEGIN:VCALENDAR\nBEGIN:VEVENT\n", None), ("a.srt", b"words", "E03"),
    ("a.txt", bytes(range(1, 9)) * 20, "U09"), ("a.txt", b"text with a \0 byte", "U09"), ("a.txt", b"\xff\xfeh\0i\0", None), ("a.txt", b"\xff\xff" * 30 + b"abc", "U09"), ("a.unknown", b"anything", None), ("a.bmp", b"BM" + struct.pack("<IIII", 999, 0, 54, 40) + b"x" * 60, "U06"),
]


@pytest.mark.parametrize(("name", "data", "rule"), CASES)
def test_verdict(name, data, rule):
    hit = X.verdict(name, len(data), data[:4096], data[-65_557:], data)
    assert (hit[0] if hit else None) == rule, hit


def test_scan_policy_and_partners(spark):
    now = dt.datetime(2026, 1, 1, 12)
    files = [(k, n, len(d), bytearray(d[:4096]), bytearray(d), bytearray(d), None, now - dt.timedelta(minutes=5 if k % 2 else 60)) for k, (n, d, _) in enumerate(CASES)]
    files += [(900, "gone.pdf", None, None, None, None, "no permission", now), (901, "short.bin", 10, bytearray(), bytearray(), bytearray(), None, None)]
    df = spark.createDataFrame(files, "id long, name string, size_bytes long, head binary, tail binary, whole binary, issue string, modified timestamp").repartition(3)
    found = H.health(df)
    got = {r.id: r for r in found.collect()}
    assert [got[k].rule for k in range(len(CASES))] == [c[2] for c in CASES] and got[900].rule == "U01" and got[901].rule == "U02"
    assert got[next(k for k, c in enumerate(CASES) if c[0] == "a.jpg" and c[1] == PNG)].misnamed == "PNG"
    held = {r.id: r for r in H.with_policy(found.join(df.select("id", "modified"), "id"), F.col("modified"), F.lit(now), disabled=("U09",), certain_only=True).collect()}
    for k, (_, _, rule) in enumerate(CASES):
        why = None if rule is None else "grace" if rule in X.GRACED and k % 2 else "disabled" if rule == "U09" else "unsure" if got[k].confidence != "certain" else None
        assert (held[k].held_back, held[k].rule) == (why, None if why else rule)
    assert H.healthy(df, found).count() == sum(c[2] is None for c in CASES)
    assert {r.rule: r["items"] for r in H.counts_by_rule(found).collect()}["U06"] == sum(c[2] == "U06" for c in CASES)
    part = spark.createDataFrame([(1, "pdf", 3, bytearray(b"abc")), (2, "pdf", 3, bytearray(b"abx")), (3, "png", 2, bytearray(b"ab"))], "id long, ext string, size_bytes long, head binary")
    whole = spark.createDataFrame([(10, "pdf", 6, bytearray(b"abcdef")), (11, "pdf", 5, bytearray(b"abcde")), (12, "pdf", 3, bytearray(b"abc"))], "id long, ext string, size_bytes long, head binary")
    assert [tuple(r) for r in H.partial_copies(part, whole).collect()] == [(1, 11)]
