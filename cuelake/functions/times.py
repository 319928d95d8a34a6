"""Time expressions: clock texts to seconds and back, overlap and pair score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("double")


def srt_seconds(text: Column, lenient: bool = False) -> Column:
    """Seconds of hh:mm:ss,mmm; null if it is none. Lenient takes any digits and '.', and pads the fraction."""
    if lenient:
        pattern = r"(\d+):(\d+):(\d+)[,.](\d+)"
        milli = F.substring(F.rpad(F.regexp_extract(text, pattern, 4), 3, "0"), 1, 3).try_cast("double")
    else:
        pattern = r"^\s*(\d\d):(\d\d):(\d\d),(\d\d\d)"
        milli = _part(text, pattern, 4)
    return _part(text, pattern, 1) * 3600 + _part(text, pattern, 2) * 60 + _part(text, pattern, 3) + milli / 1000


def ass_seconds(text: Column) -> Column:
    pattern = r"^\s*(\d+):(\d\d):(\d\d)[.](\d\d)"
    return _part(text, pattern, 1) * 3600 + _part(text, pattern, 2) * 60 + _part(text, pattern, 3) + _part(text, pattern, 4) / 100


def vtt_seconds(text: Column) -> Column:
    """[h:]mm:ss[.mmm]; the fraction is padded to three digits."""
    pattern = r"^\s*(?:(\d+):)?(\d+):(\d+)(?:\.(\d*))?\s*$"
    milli = F.substring(F.rpad(F.regexp_extract(text, pattern, 4), 3, "0"), 1, 3).try_cast("double")
    hours = F.coalesce(_part(text, pattern, 1), F.lit(0.0))
    return hours * 3600 + _part(text, pattern, 2) * 60 + _part(text, pattern, 3) + milli / 1000


def _clock(total: Column, unit: int, hours: str, separator: str, digits: int) -> Column:
    two = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    h, m, s = F.floor(total / (3600 * unit)), F.floor(total / (60 * unit)) % 60, F.floor(total / unit) % 60
    head = F.lpad(h.cast("string"), 2, "0") if hours == "2" else h.cast("string")
    head = F.when(h >= 100, h.cast("string")).otherwise(head)
    return F.concat(head, F.lit(":"), two(m), F.lit(":"), two(s), F.lit(separator), two(total % unit, digits))


def srt_time(seconds: Column) -> Column:
    return _clock(F.greatest(F.lit(0), F.rint(seconds * 1000).cast("long")), 1000, "2", ",", 3)


def ass_time(seconds: Column) -> Column:
    return _clock(F.greatest(F.lit(0), F.rint(seconds * 100).cast("long")), 100, "1", ".", 2)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def pair_score(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    distance = F.abs((a_start + a_end) / 2 - (b_start + b_end) / 2)
    return overlap(a_start, a_end, b_start, b_end) * 10 - distance
