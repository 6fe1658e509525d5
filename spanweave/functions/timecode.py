"""Time codes to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timecode(tc: Column, fps: Column | float | None = None) -> Column:
    """Seconds of a time code, null where it is none.

    Bare seconds; ``H:MM:SS.mmm`` with a comma or point and a fraction padded on the right; four
    fields, the last a frame, which need ``fps``; three fields; two fields. Fields part at ``:`` or ``;``.
    """
    t = F.trim(tc)
    g = lambda k: F.regexp_extract(t, r"^(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})$", k)
    field = lambda k: F.element_at(F.split(t, "[:;]"), k).try_cast("long")
    count = F.when(t.rlike(r"^\s*[+-]?\d+\s*([:;]\s*[+-]?\d+\s*){1,3}$"), F.size(F.split(t, "[:;]")))
    rate = F.lit(fps).cast("double") if fps is None or isinstance(fps, (int, float)) else fps
    return (
        F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
        .when(g(4) != "", g(1).try_cast("long") * 3600 + g(2).try_cast("long") * 60 + g(3).try_cast("long") + F.rpad(g(4), 3, "0").try_cast("long") / 1000)
        .when((count == 4) & (rate > 0), field(1) * 3600 + field(2) * 60 + field(3) + field(4) / rate)
        .when(count == 3, (field(1) * 3600 + field(2) * 60 + field(3)).cast("double"))
        .when(count == 2, (field(1) * 60 + field(2)).cast("double"))
    )


def infer_fps(max_frame: Column) -> Column:
    """The first usual rate above the largest frame number seen, 30 beyond all."""
    out = F.lit(30.0)
    # fixed values: the usual rates
    for rate in (60, 50, 48, 30, 25, 24):
        out = F.when(max_frame < rate, float(rate)).otherwise(out)
    return out


def hms(seconds: Column) -> Column:
    """``HH:MM:SS.s``"""
    tenths = F.floor(seconds * 10 + 0.5)
    return F.format_string("%02d:%02d:%02d.%d", F.floor(tenths / 36000), F.floor(tenths / 600) % 60, F.floor(tenths / 10) % 60, tenths % 10)


def minutes(seconds: Column) -> Column:
    """``m:ss.s``"""
    tenths = F.floor(seconds * 10 + 0.5)
    return F.format_string("%d:%02d.%d", F.floor(tenths / 600), F.floor(tenths / 10) % 60, tenths % 10)


def smpte(seconds: Column, fps: int = 25) -> Column:
    """``HH:MM:SS:FF``; a fraction that rounds up to a whole second carries."""
    frames = F.floor(seconds * fps + 0.5)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(frames / (3600 * fps)), F.floor(frames / (60 * fps)) % 60, F.floor(frames / fps) % 60, frames % fps)


def samples(tc: Column, fps: int = 25, rate: int = 48_000) -> Column:
    """Samples of ``HH:MM:SS:FF``; other texts, and fields out of range, raise."""
    field = lambda k: F.regexp_extract(tc, r"^(\d{2}):(\d{2}):(\d{2}):(\d{2})$", k).try_cast("long")
    valid = F.coalesce((field(2) < 60) & (field(3) < 60) & (field(4) < fps), F.lit(False))
    return F.when(valid, ((field(1) * 60 + field(2)) * 60 + field(3)) * rate + field(4) * (rate // fps)).otherwise(F.raise_error(F.concat(F.lit("not a time code: "), F.coalesce(tc, F.lit("null")))).cast("long"))
