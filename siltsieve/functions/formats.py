"""Whether a file's bytes are what its name says: signatures, structure of binary formats, structured text.

`verdict` takes one file; `health_of` runs it over Arrow batches of head, tail and (up to 32 MiB) whole content. Each check
reads through a `View`, which knows the file's size and gives bytes at any place that was kept; a check that needs bytes that
were not kept makes no judgement.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa

WHOLE_MAX, TEXT_MAX, BLANK_MAX, SAMPLE = 32 << 20, 1 << 20, 4096, 4096
# Names and extensions that are empty on purpose, extensions of unfinished downloads, rules that wait while a file is fresh.
EMPTY_ON_PURPOSE, EMPTY_EXTENSIONS = (".nomedia", ".gitkeep", ".keep"), ("lock",)
PARTIAL = ("crdownload", "part", "partial", "download", "opdownload", "!ut", "!qb", "bc!")
GRACED = ("E01", "E02", "E05", "U02", "U03", "U04", "U06", "U08")
TEXT = ("txt", "csv", "tsv", "json", "xml", "html", "htm", "md", "log", "srt", "vcf", "ics", "svg")
# Parts that packages need.
PARTS = {"docx": "[Content_Types].xml", "xlsx": "[Content_Types].xml", "pptx": "[Content_Types].xml", "odt": "mimetype", "ods": "mimetype", "odp": "mimetype", "epub": "mimetype", "apk": "AndroidManifest.xml"}


class NotKept(Exception):
    """Bytes that a check wants were not kept."""


@dataclass(frozen=True)
class View:
    ext: str
    size: int
    head: bytes
    tail: bytes
    whole: bytes | None

    def at(self, pos: int, n: int) -> bytes:
        n = max(0, min(n, self.size - pos))
        if self.whole is not None:
            return self.whole[pos : pos + n]
        if pos + n <= len(self.head):
            return self.head[pos : pos + n]
        if pos >= (start := self.size - len(self.tail)):
            return self.tail[pos - start : pos - start + n]
        raise NotKept

    def last(self, n: int = 65_557) -> bytes:
        return self.at(max(0, self.size - n), n)

    def all(self) -> bytes:
        if self.whole is None:
            raise NotKept
        return self.whole

    def middle(self) -> bytes:
        return self.at(max(0, (self.size - SAMPLE) // 2), SAMPLE)


Hit = tuple[str, str, str]


def _u(data: bytes, at: int, kind: str) -> int:
    return struct.unpack_from(kind, data, at)[0]


def _cut(v: View, why: str, level: str = "certain") -> Hit:
    """Cut off; for certain if the end was reserved and never filled."""
    end = v.last()
    zeros = len(end) - len(end.rstrip(b"\0"))
    return ("U06", "certain", f"{why}; {zeros} trailing zero bytes") if zeros >= 1024 else ("U06", level, why)


def _corrupt(why: str, level: str = "certain") -> Hit:
    return "U07", level, why


def pdf(v: View) -> Hit | None:
    if b"%%EOF" not in v.last(1024):
        return _cut(v, "no end marker in the last 1 KB")
    if v.size <= TEXT_MAX:
        s = v.all()
        if b"/ObjStm" not in s and not re.search(rb"/Type\s*/Page(?![a-zA-Z])", s) and re.search(rb"/Count\s+0(?![0-9])", s):
            return "E05", "likely", "no pages"
    return None


def jpeg(v: View) -> Hit | None:
    if b"\xff\xd9" in v.last(65_536):
        return None
    s, at = v.all(), 2
    while at + 4 <= len(s):
        if s[at] != 0xFF:
            return _corrupt(f"no marker at {at}")
        mark = s[at + 1]
        if mark == 0xDA:
            return None if s.find(b"\xff\xd9", at) >= 0 else _cut(v, "no end of image after the scan", "likely")
        at += 1 if mark == 0xFF else 2 if mark == 1 or 0xD0 <= mark <= 0xD9 else 2 + _u(s, at + 2, ">H")
    return _cut(v, "no start of scan")


def png(v: View) -> Hit | None:
    if v.whole is None:
        return None if b"IEND" in v.last(64) else _cut(v, "no IEND")
    s, at, data, first = v.whole, 8, False, True
    while True:
        if at + 8 > len(s):
            return _cut(v, f"chunks end at {at}")
        n, kind = _u(s, at, ">I"), s[at + 4 : at + 8]
        if first and (kind != b"IHDR" or n != 13):
            return _corrupt("no IHDR")
        if n > 0x7FFFFFFF:
            return _corrupt(f"chunk of {n} bytes")
        if at + 12 + n > len(s):
            return _cut(v, f"{kind!r} at {at} is not whole")
        if zlib.crc32(s[at + 4 : at + 8 + n]) != _u(s, at + 8 + n, ">I"):
            return _corrupt(f"{kind!r} at {at} fails its checksum")
        if first and 0 in struct.unpack_from(">II", s, at + 8):
            return _corrupt("0 pixels")
        data, first = data or kind == b"IDAT", False
        if kind == b"IEND":
            return None if data else _corrupt("no picture data")
        at += 12 + n


def gif(v: View) -> Hit | None:
    return None if b";" in v.last(16) else _cut(v, "no trailer", "likely")


def bmp(v: View) -> Hit | None:
    if len(v.head) < 14:
        return _cut(v, "header is not whole")
    says, start = _u(v.head, 2, "<I"), _u(v.head, 10, "<I")
    return _cut(v, f"says {says} bytes, pixels from {start}, has {v.size}") if says > v.size or start >= v.size else None


def tiff(v: View) -> Hit | None:
    if len(v.head) < 8:
        return _cut(v, "header is not whole")
    return _cut(v, "first directory lies beyond the end") if _u(v.head, 4, "<I" if v.head[0] == 0x49 else ">I") >= v.size else None


def riff(v: View) -> Hit | None:
    if len(v.head) < 8:
        return _cut(v, "header is not whole")
    says = _u(v.head, 4, "<I") + 8
    return _cut(v, f"says {says} bytes, has {v.size}") if 8 < says != 0x100000007 and says > v.size else None


def wav(v: View) -> Hit | None:
    if hit := riff(v):
        return hit
    at = 12
    while at + 8 <= min(len(v.head), v.size):
        kind, n = v.head[at : at + 4], _u(v.head, at + 4, "<I")
        if kind == b"data":
            return ("E05", "certain", "no sound") if n == 0 else None
        at += 8 + n + n % 2
    return ("E05", "certain", "no sound") if at >= v.size else None


def boxes(movie: bool) -> Callable[[View], Hit | None]:
    def check(v: View) -> Hit | None:
        at, media, seen = 0, 0, set()
        for _ in range(10_000):
            if at + 8 > v.size:
                break
            h = v.at(at, 16)
            n, kind, own = _u(h, 0, ">I"), h[4:8], 8
            if n == 1:
                if len(h) < 16:
                    return _cut(v, "box header is not whole")
                n, own = _u(h, 8, ">Q"), 16
            n = n or v.size - at
            if n < own:
                return _corrupt(f"box {kind!r} of {n} bytes")
            if at + n > v.size:
                return _cut(v, f"box {kind!r} at {at} is not whole")
            seen.add(kind)
            media += n - own if kind == b"mdat" else 0
            at += n
        else:
            return None
        if not movie:
            return None
        if not media and b"moof" not in seen:
            return "E05", "certain", "no picture or sound"
        return None if b"moov" in seen else _cut(v, "no index")

    return check


def mp3(v: View) -> Hit | None:
    h = v.head
    if h[:3] != b"ID3" or len(h) < 10:
        return None
    end = 10 + sum((h[6 + k] & 0x7F) << (21 - 7 * k) for k in range(4)) + (10 if h[5] & 0x10 else 0)
    if end >= v.size:
        return "E05", "certain", "tags and no sound"
    return ("U04", "certain", "sound is zero bytes") if not (v.at(end, SAMPLE) + v.middle() + v.last(SAMPLE)).strip(b"\0") else None


def ogg(v: View) -> Hit | None:
    end = v.last()
    at = end.rfind(b"OggS")
    if at < 0 or at + 5 >= len(end):
        return _cut(v, "no page near the end", "likely")
    return None if end[at + 5] & 4 else _cut(v, "no end of stream", "likely")


def zip_entries(directory: bytes, limit: int) -> list[tuple[str, int, int, int]] | None:
    """(name, crc, size, place) of central directory entries as far as they are whole; None for a broken one."""
    out, at = [], 0
    while len(out) < limit and at + 46 <= len(directory):
        if directory[at : at + 4] != b"PK\1\2":
            return None
        crc, _, size, n, extra, comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        if at + 46 + n > len(directory):
            break
        out.append((directory[at + 46 : at + 46 + n].decode("utf-8", "replace"), crc, size, _u(directory, at + 42, "<I")))
        at += 46 + n + extra + comment
    return out


def archive(v: View) -> Hit | None:
    package, end = v.ext in PARTS or v.ext == "jar", v.last()
    at = end.rfind(b"PK\5\6")
    if at < 0 or at + 22 > len(end):
        return _cut(v, "no end of directory")
    stop = v.size - len(end) + at
    count, size, start = struct.unpack_from("<HII", end, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (size, start):
        return None
    if count == 0:
        return _corrupt("package without parts") if package else ("E04", "certain", "no entries")
    if start + size > stop:
        return _corrupt("directory overlaps its end")
    shift = 0
    if v.at(start, 4) != b"PK\1\2":  # something stands before the archive
        shift = stop - size - start
        if shift <= 0 or v.at(start + shift, 4) != b"PK\1\2":
            return _corrupt("no directory where it should be")
    found = zip_entries(v.at(start + shift, min(size, 1 << 20)), count)
    if found is None:
        return _corrupt("entry without a signature")
    if found and v.at(found[0][3] + shift, 4) != b"PK\3\4":
        return _corrupt("first entry is not where the directory says")
    if len(found) == count:
        if (need := PARTS.get(v.ext)) and need not in {e[0] for e in found}:
            return _corrupt(f"no {need}", "likely")
        if not package and not sum(e[2] for e in found):
            return "E04", "likely", "entries are empty"
    return None


def ole(v: View) -> Hit | None:
    if len(v.head) < 512:
        return _cut(v, "header is not whole")
    shift = _u(v.head, 30, "<H")
    if v.head[28:30] != b"\xfe\xff" or shift not in (9, 12):
        return _corrupt("header is damaged")
    if v.size < 2 << shift:
        return _cut(v, "less than two sectors")
    return _cut(v, "no whole number of sectors", "likely") if v.size % (1 << shift) else None


def rtf(v: View) -> Hit | None:
    if v.size > TEXT_MAX:
        return None
    plain = re.sub(rb"\\.", b"", v.all(), flags=re.S)
    return _cut(v, "groups are not closed", "likely") if plain.count(b"{") > plain.count(b"}") else None


def seven_zip(v: View) -> Hit | None:
    if len(v.head) < 32:
        return _cut(v, "header is not whole")
    start, size = struct.unpack_from("<QQ", v.head, 12)
    if not start and not size:
        return "E04", "certain", "no entries"
    return _cut(v, "index lies beyond the end") if 32 + start + size > v.size else None


def gzip(v: View) -> Hit | None:
    if v.size < 18:
        return _cut(v, "less than the least size")
    return ("E04", "certain", "holds nothing") if v.size < 1024 and v.last(4) == b"\0" * 4 else None


@dataclass(frozen=True)
class Format:
    name: str
    matches: Callable[[bytes], bool]
    check: Callable[[View], Hit | None] | None = None
    sniffed: bool = True


def _starts(*marks: bytes) -> Callable[[bytes], bool]:
    return lambda h: h.startswith(marks)


def _riff_of(form: bytes) -> Callable[[bytes], bool]:
    return lambda h: h[:4] == b"RIFF" and h[8:12] == form


_FTYP = lambda h: h[4:8] == b"ftyp"
# Signatures, in the order in which they are tried, and the extensions that mean a format.
FORMATS = {
    "jpeg": Format("JPEG", _starts(b"\xff\xd8\xff"), jpeg), "png": Format("PNG", _starts(b"\x89PNG\r\n\x1a\n"), png), "gif": Format("GIF", _starts(b"GIF8"), gif),
    "bmp": Format("BMP", lambda h: h[:2] == b"BM" and len(h) >= 18 and _u(h, 14, "<I") in (12, 40, 52, 56, 64, 108, 124), bmp), "webp": Format("WebP", _riff_of(b"WEBP"), riff),
    "tiff": Format("TIFF", _starts(b"II*\0", b"MM\0*"), tiff), "mp4": Format("MP4", _FTYP, boxes(True)), "ebml": Format("Matroska/WebM", _starts(b"\x1aE\xdf\xa3")), "avi": Format("AVI", _riff_of(b"AVI "), riff),
    "wav": Format("WAV", _riff_of(b"WAVE"), wav), "ogg": Format("Ogg", _starts(b"OggS"), ogg), "flac": Format("FLAC", _starts(b"fLaC")), "pdf": Format("PDF", lambda h: b"%PDF-" in h[:1024], pdf),
    "zip": Format("ZIP-based", _starts(b"PK\3\4", b"PK\5\6", b"PK\7\b"), archive), "ole": Format("Office", _starts(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ole), "rtf": Format("RTF", _starts(b"{\\rtf"), rtf),
    "7z": Format("7-Zip", _starts(b"7z\xbc\xaf'\x1c"), seven_zip), "rar": Format("RAR", _starts(b"Rar!\x1a\x07")), "gzip": Format("gzip", _starts(b"\x1f\x8b\x08"), gzip),
    "heif": Format("HEIF image", _FTYP, boxes(False), False), "mov": Format("QuickTime video", lambda h: h[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"), boxes(True), False),
    "mp3": Format("MP3", lambda h: h[:3] == b"ID3" or (len(h) > 1 and h[0] == 0xFF and h[1] & 0xE0 == 0xE0), mp3, False),
}
BY_EXTENSION = {
    "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "bmp": "bmp", "webp": "webp", "tif": "tiff", "tiff": "tiff", "heic": "heif", "heif": "heif", "avif": "heif", "mp4": "mp4", "m4v": "mp4",
    "m4a": "mp4", "3gp": "mp4", "mov": "mov", "mkv": "ebml", "webm": "ebml", "avi": "avi", "mp3": "mp3", "wav": "wav", "ogg": "ogg", "opus": "ogg", "flac": "flac", "pdf": "pdf", "doc": "ole", "xls": "ole",
    "ppt": "ole", "rtf": "rtf", "7z": "7z", "rar": "rar", "gz": "gzip", **dict.fromkeys(("zip", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "apk", "jar"), "zip"),
}


def sniff(head: bytes) -> str | None:
    """The format that distinctive first bytes show."""
    return next((k for k, f in FORMATS.items() if f.sniffed and f.matches(head)), None)


def sniff_text(head: bytes) -> str | None:
    """What the first bytes hold if they are text: web page, markup, JSON, plain."""
    some = head[:512]
    if b"\0" in some:
        return None
    start = some.removeprefix(b"\xef\xbb\xbf").lstrip().lower()
    if start.startswith((b"<!doctype html", b"<html", b"<head", b"<body")):
        return "web page"
    if start.startswith(b"<"):
        return "markup"
    if start.startswith((b"{", b"[")):
        return "JSON"
    return "plain" if sum(b in (9, 10, 13) or 32 <= b < 127 for b in some) >= 0.95 * len(some) else None


def decode(data: bytes) -> str:
    """UTF-16 with a mark, else UTF-8; what is malformed becomes U+FFFD."""
    for mark, kind in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(kind, "replace")
    return data.decode("utf-8", "replace")


def garbled(head: bytes, whole: bytes | None) -> Hit | None:
    """Bytes that are no text: zero bytes, control characters above a tenth, many replacement characters."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return None
    if b"\0" in head:
        return "U09", "likely", "zero bytes in text"
    if len(head) >= 64 and sum(b < 32 and b not in (9, 10, 12, 13, 27) or b == 127 for b in head) > 0.1 * len(head):
        return "U09", "likely", "control characters"
    text = decode(whole if whole is not None else head)
    if (odd := text.count("�")) >= 8 and odd >= 0.02 * len(text):
        return "U09", "likely", "undecodable characters"
    return None


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _json(text: str) -> Hit | None:
    if _parses(text):
        return ("E03", "likely", "no data") if json.loads(text) in (None, {}, [], "") and json.loads(text) is not False and json.loads(text) != 0 else None
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) > 1 and all(map(_parses, lines)):
        return None
    bare = re.sub(r'"(?:\\.|[^"\\])*(?:"|$)', "", text, flags=re.S)
    return ("U06", "likely", "brackets are not closed") if sum(map(bare.count, "{[")) > sum(map(bare.count, "}]")) else ("U07", "likely", "malformed")


def _table(mark: str) -> Callable[[str], Hit | None]:
    def check(text: str) -> Hit | None:
        rows = [x for x in text.splitlines() if re.sub(rf'[{re.escape(mark)}"\s]', "", x)]
        if not rows:
            return "E03", "certain", "only empty cells"
        return ("E03", "likely", "headings and no rows") if len(rows) == 1 and not re.search("[0-9]", rows[0]) else None

    return check


def _seen(markup: str) -> str:
    return re.sub(r"(?i)&(nbsp|#160|#xa0);", " ", re.sub(r"<[^>]*>", " ", markup)).strip()


_COMMENT = re.compile(r"<!--.*?-->", re.S)


def _html(text: str) -> Hit | None:
    body = re.sub(r"(?is)<(head|script|style|template)\b.*?</\1\s*>", "", _COMMENT.sub("", text))
    media = re.search(r"(?i)<(img|video|audio|iframe|svg|canvas|object|embed|picture|input|textarea|select|button|frame)\b", body)
    return None if media or _seen(body) else ("E03", "likely", "no text or pictures")


def _xml(text: str) -> Hit | None:
    body = re.sub(r"(?i)<!DOCTYPE[^>]*>", "", re.sub(r"(?s)<\?.*?\?>", "", _COMMENT.sub("", text)))
    return ("E03", "likely", "an empty outer tag") if len(re.findall(r"<[A-Za-z_]", body)) <= 1 and not _seen(body) else None


def _svg(text: str) -> Hit | None:
    if not re.search(r"(?i)<svg\b", text):
        return "U05", "certain", "no svg element"
    return None if re.search(r"(?i)<(path|rect|circle|ellipse|line|polyline|polygon|text|image|use)\b", text) else ("E03", "likely", "draws nothing")


def _card(text: str) -> Hit | None:
    # Fields that say something of a person.
    known = re.compile(r"(?im)^(?:[^:;\r\n]*\.)?(?:FN|N|TEL|EMAIL|ADR|ORG|NOTE|URL|PHOTO)(?:;[^:\r\n]*)?:(?=[^\r\n]*[^;\s])")
    return None if known.search(text) else ("E03", "likely", "no details")


def _calendar(text: str) -> Hit | None:
    return None if re.search(r"(?im)^BEGIN:(VEVENT|VTODO|VJOURNAL|VFREEBUSY)", text) else ("E03", "likely", "no events")


STRUCTURED: dict[str, Callable[[str], Hit | None]] = {
    "json": _json, "csv": _table(","), "tsv": _table("\t"), "html": _html, "htm": _html, "xml": _xml, "svg": _svg, "vcf": _card, "ics": _calendar,
    "srt": lambda t: None if "-->" in t else ("E03", "likely", "no subtitles"),
}


def _text(v: View) -> Hit | None:
    whole = v.whole if v.size <= TEXT_MAX else None
    if (hit := garbled(v.head, whole)) or whole is None:
        return hit
    text = decode(whole)
    if not text.strip():
        return "E02", "certain", "only white space"
    return STRUCTURED[v.ext](text) if v.ext in STRUCTURED else None


def verdict(name: str, size: int | None, head: bytes | None, tail: bytes | None, whole: bytes | None, issue: str | None = None) -> Hit | None:
    """(rule, confidence, evidence) of the first rule that holds, or None for a healthy file or one of a kind that is not known.

    A size of null or an issue means that the file could not be opened; less kept than its size promises, a short read.
    """
    ext = name.rsplit(".", 1)[1].lower() if name.rfind(".") > 0 else ""
    if size == 0:
        return None if name in EMPTY_ON_PURPOSE or ext in EMPTY_EXTENSIONS else ("E01", "certain", "0 bytes")
    if ext in PARTIAL or re.search(r"^\.pending-\d+-", name):
        return "U03", "certain", "an unfinished download"
    if size is None or issue is not None or head is None:
        return "U01", "certain", issue or "not opened"
    if len(head) < min(size, 1) or (whole is not None and len(whole) < size) or (whole is None and size <= len(head)):
        return "U02", "certain", "a short read"
    v = View(ext, size, head[:SAMPLE], tail or b"", whole)
    if size <= BLANK_MAX and whole is not None and not whole.removeprefix(b"\xef\xbb\xbf").strip(b"\0 \t\n\r"):
        return "E02", "certain", "only white space or zero bytes"
    kind, text = BY_EXTENSION.get(ext), ext in TEXT
    try:
        if not v.head.strip(b"\0"):
            if not (v.middle() + v.last(SAMPLE)).strip(b"\0"):
                return "U04", "certain" if kind or text else "likely", "zero bytes"
            if kind or text:
                return "U05", "certain", "begins with zero bytes"
        if text:
            return _text(v)
        if not kind:
            return None
        if not FORMATS[kind].matches(v.head) and (kind := sniff(v.head)) is None:
            return "U05", "certain", sniff_text(v.head) or "another signature"
        check = FORMATS[kind].check
        return check(v) if check else None
    except NotKept:
        return None
    except (struct.error, IndexError):
        return _cut(v, "ends inside a field")


def health_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: id, name, size_bytes, head, tail, whole, issue -> id, rule, confidence, evidence, misnamed (the true format)."""
    for batch in batches:
        c = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        out = []
        for name, size, head, tail, whole, issue in zip(*(c[n] for n in ("name", "size_bytes", "head", "tail", "whole", "issue")), strict=True):
            hit = verdict(name, size, head, tail, whole, issue) or (None, None, None)
            kind = BY_EXTENSION.get(name.rsplit(".", 1)[-1].lower())
            real = sniff(head) if kind and head and not FORMATS[kind].matches(head) else None
            out.append((*hit, FORMATS[real].name if real else None))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *(pa.array(x, pa.string()) for x in columns)], names=["id", "rule", "confidence", "evidence", "misnamed"])
