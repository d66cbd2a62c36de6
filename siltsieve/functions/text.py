"""Text functions: words, keys, shingles, visible markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NOT_A_WORD), "")


def text_key(words_: Column) -> Column:
    """SHA-256 of the words joined by single spaces."""
    return F.sha2(F.array_join(words_, " "), 256)


def normalized(text: Column) -> Column:
    """One kind of line end, no white space at the ends of lines, none at the end."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?m)[^\S\n]+$", ""), r"\s+$", "")


def shingles(words_: Column, k: int = 5) -> Column:
    """Distinct runs of k words; up to k words make one run; no words make none."""
    n = F.size(words_)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words_, i, k), " "))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


# Fixed value: characters of readable text.
READABLE = r"""[\p{L}\p{N}\s.,;:!?\-–—()/$€£%&@#"']"""


def letter_share(text: Column) -> Column:
    """Share of letters, digits, white space and common punctuation; an empty text counts as 1."""
    odd = F.length(F.regexp_replace(text, READABLE, ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(1 - odd / F.length(text))


# The named entities that visible text decodes.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def numeric_entities(text: Column) -> Column:
    """&#65; and &#x41; as their characters; what names no character stays. Texts are parted at entities, so each is looked at once."""
    parts = F.split(text, r"(?i)(?=&#)|(?<=&#x?[0-9a-f]{1,7};)")

    def one(p: Column) -> Column:
        code = F.coalesce(F.nullif(F.regexp_extract(p, r"(?i)^&#x([0-9a-f]{1,6});$", 1), F.lit("")), F.lit(None))
        value = F.coalesce(F.conv(code, 16, 10).cast("int"), F.nullif(F.regexp_extract(p, r"^&#([0-9]{1,7});$", 1), F.lit("")).cast("int"))
        good = value.between(1, 0xD7FF) | value.between(0xE000, 0x10FFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0")), "UTF-32")
        return F.when(good, wide).otherwise(p)

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def fnv32(text: Column) -> Column:
    """FNV-1a of the UTF-16 code units, 32 bits."""
    units = F.encode(text, "UTF-16BE")
    at = lambda i: F.conv(F.hex(F.substring(units, i * 2 - 1, 2)), 16, 10).cast("long")
    n = (F.octet_length(units) / 2).cast("int")
    step = lambda h, i: ((h.bitwiseXOR(at(i))) * F.lit(16_777_619).cast("long")).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(2_166_136_261).cast("long"), step)


def min_hashes(shingles_: Column, bands: int = 16, rows: int = 4, seed: int = 7) -> Column:
    """Minimum of (a x + b) mod 2**31 - 1 over hashed shingles (longs) for bands * rows pairs a, b; null for an empty set."""
    import random

    r, p = random.Random(seed), (1 << 31) - 1
    pairs = [(r.randrange(1, p), r.randrange(p)) for _ in range(bands * rows)]
    small = F.transform(shingles_, lambda x: F.pmod(x, F.lit(p)))
    return F.when(F.size(shingles_) > 0, F.array(*[_least(small, a, b, p) for a, b in pairs]))


def _least(small: Column, a: int, b: int, p: int) -> Column:
    return F.array_min(F.transform(small, lambda x: F.pmod(x * F.lit(a) + F.lit(b), F.lit(p))))


def band_keys(signature: Column, bands: int = 16, rows: int = 4) -> Column:
    """One key for each band: sets that share one are candidates."""
    return F.array(*[F.xxhash64(F.lit(k), F.slice(signature, k * rows + 1, rows)) for k in range(bands)])


def rtf_text(raw: Column) -> Column:
    """Visible text of RTF: font, style, picture and hidden groups dropped, escapes decoded, control words removed."""
    out = F.regexp_replace(raw, r"(?s)\{\\(?:fonttbl|colortbl|stylesheet|info|pict|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\\(?:par|line|tab|row|cell)\b ?", " "), r"\\u(-?\d+) ?\??", "&#$1;")
    out = F.regexp_replace(out, r"\\'([0-9a-fA-F]{2})", "&#x$1;")
    out = numeric_entities(F.regexp_replace(out, r"\\[a-zA-Z]+-?\d* ?|[{}]|\\[^a-zA-Z]", ""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def visible_text(markup: Column) -> Column:
    """Text outside scripts, styles, comments and tags, entities decoded, white space collapsed."""
    out = F.regexp_replace(markup, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    out = numeric_entities(out)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def identifiers(words_: Column) -> Column:
    """Words with four digits and more."""
    return F.filter(words_, lambda w: w.rlike(r"(?:[0-9][^0-9]*){4}"))


# Words of a name that mark a copy or version.
VERSION_WORDS = ("copy", "of", "final", "draft", "new", "old", "updated", "update", "revised", "rev", "edited", "edit", "latest", "version", "ver", "fixed", "duplicate", "backup")


def name_stem(name: Column) -> Column:
    """Distinct words of a file name without its extension, version words and short version numbers."""
    base = F.regexp_replace(F.lower(name), r"\.[^.]+$", "")
    parts = F.filter(F.split(base, NOT_A_WORD), lambda w: (w != "") & ~w.isin(*VERSION_WORDS) & ~w.rlike(r"^(v|rev)?\d{1,2}$"))
    return F.array_distinct(parts)


def names_related(a: Column, b: Column) -> Column:
    """One stem holds the other; an empty stem is related to nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
