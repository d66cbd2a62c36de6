"""What file names and folders say: screenshot and recording tools, their dates, sources of videos, bin categories."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Date and time pieces of names, and the patterns of tools, tried in this order. A pattern has to match the whole
# name without its extension, in any case; `in_folder` limits it to names directly inside that folder.
_DATE = r"(?<y>\d{4})-?(?<mo>\d{2})-?(?<d>\d{2})"
_TIME = r"(?<h>\d{2})[-.:]?(?<mi>\d{2})[-.:]?(?<s>\d{2})"
_DASH_DATE, _DASH_TIME = r"(?<y>\d{4})-(?<mo>\d{2})-(?<d>\d{2})", r"(?<h>\d{2})-(?<mi>\d{2})-(?<s>\d{2})"
_DOT_DATE = r"(?<y>\d{4})\.(?<mo>\d{2})\.(?<d>\d{2})"
_CLOCK = r"(?<h>\d{1,2})\.(?<mi>\d{2})\.(?<s>\d{2})"
_GAP = "[\\s  ]"


@dataclass(frozen=True)
class Pattern:
    tool: str
    pattern: str
    source: str | None = None
    in_folder: str | None = None


SCREENSHOTS = (
    Pattern("Android", rf"screenshot_{_DATE}[-_]{_TIME}(?:[-.]\d{{1,4}})?(?:_(?<app>.+))?"),
    Pattern("macOS", rf"screen ?shot {_DATE} at {_CLOCK}(?:{_GAP}?[ap]m)?(?: \(\d+\))?(?: \d+)?"),
    Pattern("Windows Snipping Tool", rf"screenshot {_DATE} {_TIME}(?: \(\d+\))?"),
    Pattern("Windows", r"screenshot \(\d+\)"),
    Pattern("GNOME", rf"screenshot from {_DATE} {_TIME}(?: \(\d+\))?"),
    Pattern("Xbox Game Bar", rf"(?<app>.+) {_DATE} {_TIME}", in_folder="captures"),
    Pattern(
        "localised",
        rf"(?:captura de pantalla|captura de tela|capture d.écran|bildschirmfoto|schermafbeelding|schermata|zrzut ekranu|snímek obrazovky|スクリーンショット|屏幕截图|스크린샷)[ _-]?(?:from )?{_DATE}(?:(?: at | um | a las | à |[ _-]){_TIME})?.*",
    ),
)
VIDEOS = (
    Pattern("Android camera", rf"vid_{_DATE}_{_TIME}(?:_\d+)?(?:~\d+)?", "camera"),
    Pattern("Pixel camera", rf"pxl_{_DATE}_{_TIME}\d{{0,3}}(?:\..+)?", "camera"),
    Pattern("Samsung camera", rf"{_DATE}_{_TIME}(?:\(\d+\))?", "camera", "camera"),
    Pattern("iPhone camera", r"img_e?\d{4}(?: \(\d+\))?", "camera"),
    Pattern("GoPro", r"g[hx]\d{6}|gopr\d{4}", "camera"),
    Pattern("DJI", rf"dji_(?:{_DATE}{_TIME}_)?\d{{4}}(?:_[a-z])?", "camera"),
    Pattern("camera", r"c\d{4}|mvi_\d{4}|mah\d{5}|dsc_\d{4}|p\d{7}", "camera"),
    Pattern("Samsung screen recorder", rf"screen_recording_{_DATE}[-_]{_TIME}(?:_(?<app>.+))?", "screenRecording"),
    Pattern("Pixel screen recorder", rf"screen-{_DATE}-{_TIME}(?:-\d+)?", "screenRecording"),
    Pattern("Xiaomi screen recorder", rf"screenrecorder-{_DASH_DATE}-{_DASH_TIME}(?:-\d+)?", "screenRecording"),
    Pattern("iPhone screen recording", r"rpreplay_final(?<unix>\d{10})(?: \(\d+\))?", "screenRecording"),
    Pattern("macOS screen recording", rf"screen recording {_DATE} at {_CLOCK}(?:{_GAP}?[ap]m)?(?: \(\d+\))?", "screenRecording"),
    Pattern("Windows screen recording", rf"screen recording {_DATE} {_TIME}(?: \(\d+\))?", "screenRecording"),
    Pattern("NVIDIA ShadowPlay", rf"(?<app>.+?) {_DOT_DATE} - (?<h>\d{{2}})\.(?<mi>\d{{2}})\.(?<s>\d{{2}})\.\d{{2}}(?:\.dvr)?", "gameplay"),
    Pattern("Fraps", rf"(?<app>.+?) {_DASH_DATE} {_DASH_TIME}-\d{{2}}", "gameplay"),
    Pattern("AMD ReLive", rf"(?<app>.+?)_(?:replay_)?{_DOT_DATE}-(?<h>\d{{2}})\.(?<mi>\d{{2}})(?:\.(?<s>\d{{2}}))?", "gameplay"),
    Pattern("Bandicam", rf"bandicam {_DASH_DATE} {_DASH_TIME}-\d{{3}}", "gameplay"),
    Pattern("OBS", rf"(?:replay )?{_DASH_DATE} {_DASH_TIME}", "gameplay"),
    Pattern("Xbox Game Bar", rf"(?<app>.+) {_DATE} {_TIME}", "gameplay", "captures"),
    Pattern("WhatsApp", rf"vid-{_DATE}-wa\d{{4}}(?: \(\d+\))?", "messaging"),
    Pattern("Telegram", rf"video_{_DASH_DATE}_{_DASH_TIME}", "messaging"),
)
# Folders that tell where a video came from; the nearest one counts.
SOURCE_FOLDERS = {
    "dcim": "camera", "camera": "camera", "screen recordings": "screenRecording", "screenrecorder": "screenRecording", "screenrecords": "screenRecording",
    "captures": "gameplay", "obs": "gameplay", "nvidia": "gameplay", "shadowplay": "gameplay", "fraps": "gameplay", "bandicam": "gameplay",
    "whatsapp video": "messaging", "telegram": "messaging", "telegram video": "messaging", "download": "download", "downloads": "download",
}
# Categories of the bin by extension, and extensions that are packed already.
BIN_CATEGORIES = {
    "photo": ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif", "bmp", "dng"),
    "video": ("mp4", "m4v", "mov", "3gp", "mkv", "webm", "avi"),
    "audio": ("mp3", "m4a", "wav", "ogg", "opus", "flac", "aac"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "rtf", "txt", "csv", "epub"),
    "app": ("apk",),
}
PACKED = ("zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "jar", "aab", "obb", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "dmgz")
# Fixed value: names that loosely say "screenshot".
LOOSE_SCREENSHOT = r"(?i)screen[\s_-]?shot|screen[\s_-]?cap|scrnshot|^capture[\s_(-]*\d"


def stem(name: Column) -> Column:
    """The name before its last dot, unless that is its first character."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def folders(path: Column) -> Column:
    """Lower-case names of the folders above a file, the nearest last."""
    parts = F.split(F.lower(path), r"[/\\]")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _taken(found: dict[str, str | None], own: str) -> str | None:
    """Local time that a name's pieces say; 12-hour clocks count am and pm, a day or hour too large rolls over."""
    y, mo, d, h, mi, sec = (int(found.get(k) or 0) for k in ("y", "mo", "d", "h", "mi", "s"))
    if not found.get("y") or not 1 <= mo <= 12 or y < 1:
        return None
    half = re.search(r"(?i)([ap])m(?: \(\d+\))?(?: \d+)?$", own)
    if half:
        h = h + 12 if half[1] in "pP" and h < 12 else 0 if half[1] in "aA" and h == 12 else h
    try:
        return (dt.datetime(y, mo, 1) + dt.timedelta(days=d - 1, hours=h, minutes=mi, seconds=sec)).isoformat(" ")
    except OverflowError:
        return None


def _matcher(patterns: tuple[Pattern, ...]):
    @F.pandas_udf("tool string, source string, app string, local string, unix long")
    def match(name: pd.Series, path: pd.Series) -> pd.DataFrame:
        known = [(p, re.compile(p.pattern.replace("(?<", "(?P<"), re.I)) for p in patterns]
        out = []
        for own, at in zip(name, path, strict=True):
            row = (None,) * 5
            if own is not None:
                own = own[: own.rfind(".")] if own.rfind(".") > 0 else own
                nearest = ([""] + re.split(r"[/\\\\]", (at or "").lower())[:-1])[-1]
                for p, pattern in known:
                    if (p.in_folder is None or p.in_folder == nearest) and (m := pattern.fullmatch(own)):
                        found = m.groupdict()
                        row = (p.tool, p.source, found.get("app"), _taken(found, own), int(found["unix"]) if found.get("unix") else None)
                        break
            out.append(row)
        return pd.DataFrame(out, columns=["tool", "source", "app", "local", "unix"]).astype({"unix": "Int64"})

    return match


def match_name(name: Column, path: Column, patterns: tuple[Pattern, ...]) -> Column:
    """struct(tool, source, app, local, unix) of the first pattern that the name matches, nulls for none.

    An Arrow-batched function: as one SQL expression the patterns and their groups make a plan too large to optimise.
    """
    return _matcher(patterns)(name, path)


def taken_at(match: Column) -> Column:
    """The time of a match: a Unix time as it is, else local time in the session's zone."""
    return F.coalesce(F.timestamp_seconds(match.getField("unix")), F.try_to_timestamp(match.getField("local")))


def loose_screenshot(name: Column) -> Column:
    return name.rlike(LOOSE_SCREENSHOT)


def source_from_folders(path: Column) -> Column:
    """Source that the nearest telling folder says, else "other"."""
    known = F.create_map(*[F.lit(x) for kv in SOURCE_FOLDERS.items() for x in kv])
    hits = F.filter(F.transform(F.reverse(folders(path)), lambda f: F.element_at(known, f)), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("other"))


def folder_run(path: Column, names: tuple[str, ...]) -> Column:
    """Whether these folders lie above the file, one directly in the other."""
    return F.contains(F.concat(F.lit("/"), F.array_join(folders(path), "/"), F.lit("/")), F.lit("/" + "/".join(names) + "/"))


def last_extension(name: Column) -> Column:
    """Lower-case letters after the last dot, wherever it stands."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def bin_category(name: Column) -> Column:
    out, ext = F.lit("other"), last_extension(name)
    for kind, known in BIN_CATEGORIES.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def worth_compressing(name: Column) -> Column:
    """Whether gzip may shrink the file: no photo, video, audio or app, and nothing packed already."""
    return ~bin_category(name).isin("photo", "video", "audio", "app") & ~last_extension(name).isin(*PACKED)


def photo_copy_name(name: Column) -> Column:
    # Fixed value: names of copied and edited photos.
    return name.rlike(r"(?i)\(\d+\)|\bcopy\b|-WA\d+|[_-]edited")


# Names of system files, and folders of app data.
SYSTEM_FILES = ("desktop.ini", "thumbs.db", ".ds_store", ".nomedia", ".gitkeep")


def excluded_reason(name: Column, path: Column) -> Column:
    """Why a file is left alone, in this order: system file, hidden file, app folder; null if it is not."""
    app = folder_run(path, ("android", "data")) | folder_run(path, ("android", "obb"))
    return F.when(F.lower(name).isin(*SYSTEM_FILES), "system file").when(name.startswith("."), "hidden file").when(app, "app folder")
