"""Days, freshness windows, relative times, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(ts: Column) -> Column:
    """Publish day in UTC+8."""
    return F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd")


def hours_between(late: Column, early: Column) -> Column:
    """Exact hours."""
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / 3.6e9


def round_start(now: Column) -> Column:
    """Start of the running round: hours 0, 3, 6 and 12 UTC."""
    hour = F.hour(now)
    return F.date_trunc("day", now) + F.make_interval(hours=F.when(hour >= 12, 12).when(hour >= 6, 6).when(hour >= 3, 3).otherwise(0))


def chinese_date(text: Column) -> Column:
    """YYYY 年 M 月 D 日 as an ISO instant at 12:00 in UTC+8; empty if there is none."""
    part = lambda i: F.regexp_extract(text, r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", i)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) == "", "").otherwise(F.concat(day, F.lit("T04:00:00.000Z")))


def relative_time(text: Column, now: Column) -> Column:
    """N分钟前, N小时前, N天前, 今天/昨天/前天 [HH:MM] (12:00 if missing); null if it is none of these."""
    amount = lambda unit: F.try_to_number(F.regexp_extract(text, rf"(\d+)\s*{unit}前", 1), F.lit("999999")).cast("int")
    back = F.when(text.contains("今天"), 0).when(text.contains("昨天"), 1).when(text.contains("前天"), 2)
    clock = lambda i, default: F.coalesce(F.try_to_number(F.regexp_extract(text, r"(\d{1,2}):(\d{2})", i), F.lit("99")).cast("int"), F.lit(default))
    wall = F.date_trunc("day", now + F.expr("INTERVAL 8 HOURS")) - F.make_interval(days=back) + F.make_interval(hours=clock(1, 12), mins=clock(2, 0)) - F.expr("INTERVAL 8 HOURS")
    return F.coalesce(now - F.make_interval(mins=amount("分钟")), now - F.make_interval(hours=amount("小时")), now - F.make_interval(days=amount("天")), wall)


def windows(official: Column, window_days: Column) -> tuple[Column, Column]:
    """(direct, rescued) window in hours: 7 days or 36 hours, the direct one widened by the source."""
    base = F.when(official, 168).otherwise(36)
    return F.greatest(base, F.coalesce(window_days * 24, F.lit(0))), base


def fresh(published: Column, rescued: Column, direct_hours: Column, rescued_hours: Column, now: Column) -> Column:
    """Kept by the freshness filter: unknown dates pass, the future only up to 24 hours."""
    inside = lambda ts, hours: (ts <= now + F.expr("INTERVAL 24 HOURS")) & (hours_between(now, ts) <= hours)
    return F.when(published.isNotNull(), inside(published, direct_hours)).when(rescued.isNotNull(), inside(rescued, rescued_hours)).otherwise(True)


def relative_label(day: Column, today: str) -> Column:
    """今天, 昨天 or the day itself."""
    gap = F.date_diff(F.lit(today).cast("date"), F.expr("try_cast({} as date)".format("date_key")) if isinstance(day, str) else F.try_to_date(day))
    return F.when(gap == 0, "今天").when(gap == 1, "昨天").otherwise(F.col(day) if isinstance(day, str) else day)


def loose_timestamp(text: Column) -> Column:
    """RFC 2822 with or without a weekday, ISO, or a plain day; null if it is none of these."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s*(?:GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(text)))


def published_from_html(html: Column) -> Column:
    """From meta elements, JSON-LD, ``<time datetime>``, a Chinese date or a bare day; from 2015 on."""
    head = F.substring(html, 1, 240_000)
    meta = F.regexp_extract(head, r"""(?i)<meta[^>]+(?:property|name|itemprop)=["'](?:article:published_time|pubdate|publishdate|date|datePublished)["'][^>]*content=["']([^"']+)""", 1)
    linked = F.regexp_extract(head, r'"datePublished"\s*:\s*"([^"]+)"', 1)
    time = F.regexp_extract(head, r"""(?i)<time[^>]*datetime=["']([^"']+)""", 1)
    chinese = F.regexp_replace(F.regexp_extract(head, r"((?:201[5-9]|20[2-9]\d)\s*年\s*\d{1,2}\s*月\s*\d{1,2})\s*日", 1), r"\s*[年月]\s*", "-")
    bare = F.regexp_extract(head, r"(?:^|\D)((?:201[5-9]|20[2-9]\d)-\d{2}-\d{2})(?:\D|$)", 1)
    return F.coalesce(*[loose_timestamp(F.when(c != "", c)) for c in (meta, linked, time)], F.try_to_timestamp(F.when(chinese != "", chinese), F.lit("yyyy-M-d")), loose_timestamp(F.when(bare != "", bare)))
