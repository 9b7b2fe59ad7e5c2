"""URLs and dates that stand in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import values


def normalize_url(url: Column) -> Column:
    """Host in lower case without www., no fragment, no tracking parameters, no slash at the end of a path.

    A text that is no absolute URL is trimmed and lower-cased.
    """
    plain = F.trim(url)
    bare = F.regexp_replace(plain, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(values.TRACKING_PARAMS))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    root = F.when(path == "", F.lit("/")).otherwise(path)
    whole = F.concat(scheme, F.lit("://"), host, root, tail)
    trimmed = F.when((whole.endswith("/")) & ((root != "/") | (tail != "")), F.expr("NULL").cast("string")).otherwise(whole)
    out = F.coalesce(trimmed, F.substr(whole, F.lit(1), F.length(whole) - 1))
    return F.when(F.coalesce(url, F.lit("")) == "", "").when((scheme == "") | (host == ""), F.lower(plain)).otherwise(out)


def _day(y: Column, m: Column, d: Column) -> Column:
    """ISO instant at 01:00 UTC; days beyond the month roll over; null outside 2015-2100."""
    y, m, d = (F.expr("try_cast(null as int)") if c is None else F.try_to_number(c, F.lit("9999")).cast("int") for c in (y, m, d))
    ok = y.between(2015, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.concat(F.date_format(F.date_add(F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1)), F.when(ok, d) - 1), "yyyy-MM-dd"), F.lit("T01:00:00.000Z")))


def published_from_url(url: Column) -> Column:
    """From /YYYYMM/tYYYYMMDD, else YYYY/M/D with any separator, else YYYYMMDD; null if there is none."""
    folder = F.regexp_extract(url, r"/[0-9]{6}/t([0-9]{8})[_\-.]", 1)
    parted = r"(?:^|[^0-9])([0-9]{4})[/\-_.]([0-9]{1,2})[/\-_.]([0-9]{1,2})(?:[^0-9]|$)"
    compact = F.regexp_extract(url, r"(?:^|[^0-9])(20[12][0-9](?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01]))(?:[^0-9]|$)", 1)
    pieces = lambda c: _day(F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.coalesce(pieces(folder), _day(*(F.regexp_extract(url, parted, i) for i in (1, 2, 3))), pieces(compact))


def archive_key(url: Column) -> Column:
    """Name of a page's archive folder."""
    return F.substring(F.sha1(url), 1, 16)


def blocked_ip(ip: Column) -> Column:
    """Private, local, test and multicast addresses."""
    octet = lambda i: F.try_to_number(F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", i), F.lit("999")).cast("int")
    a, b = octet(1), octet(2)
    v4 = a.isin(0, 10, 127, 224, 240, 255) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(168, 0)) | ((a == 198) & b.isin(18, 19))
    v6 = F.lower(ip).rlike("^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff)")
    return F.when(a.isNotNull(), v4).otherwise(v6)
