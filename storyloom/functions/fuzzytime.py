"""Fuzzy calendar labels of a chronology: centuries, decades, years, seasons, times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import normalize

# --- fixed values --------------------------------------------------------------------------------------------------
SEASON_MONTH = {"春": 3, "夏": 6, "秋": 9, "冬": 12}
DAY_PART_MINUTE = {"深夜": 1380, "晚上": 1140, "下午": 840, "中午": 720, "上午": 540, "早上": 420, "清晨": 300, "凌晨": 60}
#: What unknown years sort as: after all known ones.
LAST = 9_999_999


def label_of(text: Column, section: Column | None = None) -> Column:
    """What a time says: its text, or else its section, in compatibility form and squeezed; empty for neither."""
    said = text if section is None else F.coalesce(F.when(F.length(text) > 0, text), section)
    return normalize(F.coalesce(said, F.lit("")))


def _number(label: Column, pattern: str) -> Column:
    """The number a pattern finds, null if there is none or it is beyond any calendar."""
    return F.nullif(F.regexp_extract(label, pattern, 1), F.lit("")).try_cast("int")


def bounds(label: Column, year_start: Column | None = None, year_end: Column | None = None) -> Column:
    """(start, end) in years of a label of ``label_of``: a century with a decade, a century, stated years, or a year in the
    label; null if unknown."""
    none = F.lit(None).cast("int")
    century, decade = _number(label, r"(\d+)\s*世纪"), _number(label, r"\d\s*世纪\s*(\d+)\s*年代")
    base = (century - 1) * 100
    start = F.coalesce(none if year_start is None else year_start, _number(label, r"(?:^|\D)(\d{1,4})\s*年"))
    end = F.coalesce(none if year_end is None else year_end, start)
    first = F.when(decade.isNotNull(), base + decade).when(century.isNotNull(), base + 1).otherwise(start)
    last = F.when(decade.isNotNull(), base + decade + 9).when(century.isNotNull(), base + 100).otherwise(end)
    return F.struct(first.alias("start"), last.alias("end"))


def _first(label: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for word, value in reversed(table.items()):
        out = F.when(label.contains(word), value).otherwise(out)
    return out


def order_key(label: Column, start: Column) -> Column:
    """(year, month, day, minute) of a label to sort by; unknown years come last."""
    month = F.coalesce(_number(label, r"(\d{1,2})\s*月"), _first(label, SEASON_MONTH))
    day = F.coalesce(_number(label, r"(\d{1,2})\s*日"), F.lit(0))
    clock = _number(label, r"(\d{1,2})\s*[:：]\s*\d{1,2}") * 60 + _number(label, r"\d{1,2}\s*[:：]\s*(\d{1,2})")
    minute = F.coalesce(clock, _first(label, DAY_PART_MINUTE))
    known = start.isNotNull()
    pick = lambda c, other: F.when(known, c).otherwise(other)
    return F.struct(F.coalesce(start, F.lit(LAST)).alias("year"), pick(month, 13).alias("month"), pick(day, 32).alias("day"), pick(minute, 1440).alias("minute"))


def overlaps(start: Column, end: Column, low: int | None, high: int | None) -> Column:
    """The interval meets [low, high]; where a bound is asked for, unknown years do not."""
    out = F.lit(True)
    if low is not None:
        out = out & F.coalesce(end >= low, F.lit(False))
    if high is not None:
        out = out & F.coalesce(start <= high, F.lit(False))
    return out


#: Fixed value: what an event without any time shows.
NO_TIME = "时间不详"


def display(text: Column, section: Column, year_start: Column, year_end: Column) -> Column:
    """The time as shown: a label that names its year, else the stated years and the label."""
    said = lambda c: F.when(F.length(c) > 0, c)
    label = F.trim(F.coalesce(said(text), said(section), F.lit(NO_TIME)))
    end = F.coalesce(year_end, year_start)
    years = F.when(end != year_start, F.concat_ws("-", year_start, end)).otherwise(year_start.cast("string"))
    years = F.concat(years, F.lit(" 年"))
    return (
        F.when(label.rlike("年|世纪|纪元") | year_start.isNull() | (year_start < 0), label)
        .when(label == NO_TIME, years)
        .otherwise(F.concat(years, F.lit(" "), label))
    )
