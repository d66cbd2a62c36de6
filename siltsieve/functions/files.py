"""Functions of names, sizes, dates and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind, photo extensions.
KINDS = {
    "image": ("jpg", "jpeg", "png", "heic", "heif", "webp", "gif", "bmp", "tif", "tiff", "dng", "avif"),
    "video": ("mp4", "m4v", "mov", "3gp", "mkv", "webm", "avi"),
    "audio": ("mp3", "m4a", "wav", "ogg", "opus", "flac", "aac"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "epub"),
    "archive": ("zip", "apk", "jar", "7z", "rar", "gz"),
    "text": ("txt", "csv", "json", "xml", "html", "htm", "md", "log", "srt", "vcf", "ics", "svg"),
}
PHOTOS = ("jpg", "jpeg", "png", "heic", "heif", "webp", "bmp")


def extension(name: Column) -> Column:
    """Lower-case letters after the last dot; none for names that begin with their only dot or end in one."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def media_kind(ext: Column) -> Column:
    out = F.lit("other")
    for kind, known in KINDS.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def is_photo(ext: Column) -> Column:
    return ext.isin(*PHOTOS)


def folder(path: Column) -> Column:
    """Up to and with the last separator; null for none."""
    return F.nullif(F.regexp_extract(path, r"^(.*[/\\])", 1), F.lit(""))


def inner_extension(name: Column) -> Column:
    """Extension of the file that a partial download will be."""
    return extension(F.regexp_replace(F.lower(name), r"\.(crdownload|part|partial|download|opdownload|tmp)$", ""))


def in_folder(path: Column, names: list[str]) -> Column:
    """Whether any folder of the path has one of these names."""
    parts = F.split(F.lower(path), r"[/\\]")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n) for n in names]))


def has_copy_name(name: Column) -> Column:
    # Fixed value: names of copies.
    return name.rlike(r"(?i)\(\d+\)|\bcopy\b|\bduplicate\b")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def format_bytes(n: Column) -> Column:
    """Steps of 1024 with one decimal, whole bytes below."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


def days_between(later: Column, earlier: Column) -> Column:
    """Whole blocks of 24 hours, not calendar days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("long")


def storage_level(free: Column, total: Column) -> Column:
    """critical below 5 % and 1 GiB, low below 10 % and 5 GiB, both strictly; what can't be a reading is ok."""
    gib = 1024.0**3
    valid = (total > 0) & (free >= 0) & (free <= total)
    return F.when(valid & (free < F.least(total * 0.05, F.lit(gib))), "critical").when(valid & (free < F.least(total * 0.10, F.lit(5 * gib))), "low").otherwise("ok")


def free_gib(free: Column) -> Column:
    return free / float(1024**3)


def used_fraction(free: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - free) / total))).otherwise(0.0)
