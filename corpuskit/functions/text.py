"""Text column expressions. All native: none runs Python by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

# First words that make a query a question.
QUESTION_WORDS = "what which where when who whose whom how why show find list tell did do does is are was were can could should would have has".split()


def tokenize(s: Column) -> Column:
    """Lower-cased runs of letters and digits of any script; null gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def truncate(s: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where text was cut."""
    if n <= 0:
        return F.lit("")
    cut = F.lit("…") if n == 1 else F.concat(F.regexp_replace(F.substring(s, 1, n - 1), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(s) <= n, s).otherwise(cut)


def squash(s: Column, n: int) -> Column:
    """White space collapsed and trimmed, then cut to ``n``."""
    return truncate(F.trim(F.regexp_replace(s, r"\s+", " ")), n)


def normalize_name(s: Column) -> Column:
    """Comparison key of a name: lower case, punctuation and symbols as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def estimate_tokens(s: Column) -> Column:
    return F.ceil(F.length(s) / 4)


def is_natural_language(s: Column) -> Column:
    """Ends with a question mark, has four words or more, or begins with a question word."""
    words, t = tokenize(s), F.trim(F.coalesce(s, F.lit("")))
    return (F.length(t) > 0) & (t.endswith("?") | (F.size(words) >= 4) | F.coalesce(F.get(words, F.lit(0)).isin(QUESTION_WORDS), F.lit(False)))


def looks_like_markdown(s: Column) -> Column:
    """A heading, a list, a link or a fence."""
    return s.rlike(r"(?m)^#{1,6}\s+\S|^\s*[-*+]\s+\S|\[[^\]]+\]\([^)]+\)|^```")


def title_from_filename(name: Column) -> Column:
    """The stem with separators as blanks."""
    stem = F.regexp_replace(name, r"(.)\.[A-Za-z0-9]{1,8}$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(stem, r"[_\-]+", " "), r"\s+", " "))


def title_from_url(url: Column) -> Column:
    """The last part of the path with separators as blanks and without its ending, else the host."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://[^/]+.*/([^/]+)/*$", 1)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\-]+", " "))
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^https?://([^/?#:]+)", 1), r"^www\.", "")
    return F.when(words != "", words).otherwise(host)


def is_screenshot_name(name: Column) -> Column:
    """Names that systems give to pictures of the screen."""
    return F.coalesce(name.rlike(r"(?i)^(screen[ _-]?shot|screen[ _-]?capture|bildschirmfoto|simulator screen|cleanshot)\b|^(snip|capture)[ _-]?\d"), F.lit(False))


def relative_time(then_s: Column, now_s: Column) -> Column:
    """Age in words from epoch seconds; the future and nulls are "just now"."""
    minute, hour, day = 60.0, 3600.0, 86400.0
    d = (now_s - then_s).cast("double")
    times = lambda unit, name: F.concat(F.floor(d / unit + 0.5).cast("string"), F.lit(f" {name} ago"))
    return (
        F.when(d.isNull() | (d < 45), "just now")
        .when(d < 90, "1 minute ago")
        .when(d < 45 * minute, times(minute, "minutes"))
        .when(d < 90 * minute, "1 hour ago")
        .when(d < 22 * hour, times(hour, "hours"))
        .when(d < 36 * hour, "yesterday")
        .when(d < 7 * day, times(day, "days"))
        .when(d < 11 * day, "1 week ago")
        .when(d < 30 * day, times(7 * day, "weeks"))
        .when(d < 45 * day, "1 month ago")
        .when(d < 320 * day, times(30 * day, "months"))
        .when(d < 548 * day, "1 year ago")
        .otherwise(times(365 * day, "years"))
    )


def fnv1a32(s: Column, seed: int = 0x811C9DC5) -> Column:
    """32-bit FNV-1a of ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))
