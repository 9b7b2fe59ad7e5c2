"""Feeds, HTML lists, JSON lists and bytes, parsed in batches; the network stays outside."""

from __future__ import annotations

import html as entities
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from datetime import datetime, timedelta, timezone
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire import values

#: What every source yields.
CANDIDATE = "title string, source_name string, source_url string, category string, language string, source_type string, content_snippet string, published_at string"
FIELDS = [c.split()[0] for c in CANDIDATE.split(", ")]


def decode_bytes(raw: bytes, declared: str | None = None) -> tuple[str, str]:
    """(encoding, text): byte-order mark, then the declared charset, then that of the markup, then trials in order."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if raw.startswith(mark):
            return name, raw[len(mark) :].decode(name.replace("utf-16", "utf-16-"), "replace") if "16" in name else raw[3:].decode("utf-8", "replace")
    found = re.search(rb"""(?i)(?:charset|encoding)\s*=\s*["']?([A-Za-z0-9_.:-]+)""", raw[:2048])
    for label in (declared, found and found[1].decode("ascii")):
        name = values.CHARSET_ALIASES.get((label or "").strip().lower())
        if name:
            return name, raw.decode(name, "replace")
    for name in ("utf-8", "shift_jis", "euc-jp", "iso-2022-jp", "euc-kr", "gb18030", "big5"):
        try:
            return name, raw.decode(name)
        except UnicodeDecodeError:
            continue
    return "utf-8", raw.decode("utf-8", "replace")


def loose_date(text: str | None) -> datetime | None:
    """RFC 2822, ISO or a plain day; None if it is neither."""
    text = (text or "").strip()
    if not text:
        return None
    try:
        out = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        try:
            out = parsedate_to_datetime(text)
        except (ValueError, TypeError):
            return None
    return out if out.tzinfo else out.replace(tzinfo=timezone.utc)


def local_day(text: str, pattern: str, hour: int, offset: int) -> str:
    """A day found by a pattern with three groups, at an hour of a time zone, as ISO; empty if there is none."""
    found = re.search(pattern, text or "")
    if not found:
        return ""
    y, m, d = (int(x) for x in found.groups()[:3])
    try:
        return iso(datetime(y, m, d, hour, tzinfo=timezone(timedelta(hours=offset))))
    except ValueError:
        return ""


def iso(at: datetime | None) -> str:
    """ISO instant in UTC with milliseconds."""
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z") if at else ""


class Element:
    """A parsed HTML element."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def find(self, tag: str, **attrs: str) -> Iterator[Element]:
        """Descendants by tag (``*``: any) and parts of attributes, in order."""
        for c in self.children:
            if isinstance(c, Element):
                if tag in ("*", c.tag) and all(v in c.attrs.get(k.rstrip("_"), "") for k, v in attrs.items()):
                    yield c
                yield from c.find(tag, **attrs)

    def text(self) -> str:
        """All text, with white space joined."""
        return re.sub(r"\s+", " ", "".join(c if isinstance(c, str) else c.text() + " " for c in self.children)).strip()


class _Builder(HTMLParser):
    VOID = {"br", "img", "meta", "link", "input", "hr", "source", "base", "col", "wbr"}

    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in self.VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def parse_html(text: str) -> Element:
    """The document's root; unclosed elements end with their parent."""
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def parse_feed(text: str) -> list[dict]:
    """Items of RSS 2.0, RSS 1.0 (RDF) and Atom: title, link, date, snippet; broken XML gives none."""
    try:
        root = ET.fromstring(re.sub(r"^[^<]*", "", text))
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rpartition("}")[2]
    out = []
    for item in (e for e in root.iter() if name(e) in ("item", "entry")):
        got = {}
        for c in item:
            value = (c.attrib.get("href") if name(c) == "link" and c.attrib.get("href") else "".join(c.itertext())) or ""
            got.setdefault(name(c), value.strip())
        date = next((got[k] for k in ("pubDate", "date", "published", "updated") if got.get(k)), "")
        snippet = next((got[k] for k in ("encoded", "description", "summary", "content") if got.get(k)), "")
        out.append({"title": got.get("title", ""), "url": got.get("link", ""), "date": date, "snippet": re.sub(r"<[^>]+>", "", entities.unescape(snippet)).strip()})
    return out


def feed_rows(body: str, source: dict) -> list[dict]:
    """Candidates of a feed; one that was decoded wrongly (over 5 % replacement characters) is an error."""
    if body.count("\ufffd") > 0.05 * len(body):
        raise ValueError("feed decoding: too many U+FFFD")
    return [_row(i["title"], i["url"], iso(loose_date(i["date"])), i["snippet"][:2000], source) for i in parse_feed(body)]


def _row(title: str, url: str, published: str, snippet: str, source: dict) -> dict:
    return {"title": title.strip(), "source_name": source["name"], "source_url": url.strip(), "category": source.get("category", ""), "language": source.get("language", ""), "source_type": source.get("source_type", ""), "content_snippet": snippet, "published_at": published}


def html_list(card: str, link: str = "a", href: str = "", date: str = r"(\d{4})-(\d{1,2})-(\d{1,2})", hour: int = 9, offset: int = 8, least: int = 5, snippet: str | None = None, **attrs: str) -> Callable[[str, dict], list[dict]]:
    """A parser of list pages: cards by tag and attributes, a link by a pattern, a day in the card's text."""

    def parse(body: str, source: dict) -> list[dict]:
        out, seen = [], set()
        for e in parse_html(body).find(card, **attrs):
            a = e if e.tag == link else next((x for x in e.find(link) if re.search(href, x.attrs.get("href", ""))), None)
            if a is None or not re.search(href, a.attrs.get("href", "")):
                continue
            url = urljoin(source["url"], a.attrs.get("href", ""))
            title = (a.attrs.get("title") or a.text()).strip()
            if len(title) < least or url in seen:
                continue
            seen.add(url)
            times = next((t.attrs.get("datetime") for t in e.find("time") if t.attrs.get("datetime")), "")
            published = iso(loose_date(times)) if times else local_day(e.text(), date, hour, offset)
            body_text = next((p.text() for p in e.find(snippet)), title) if snippet else title
            out.append(_row(title, url, published, body_text[:2000], source))
        return out

    return parse


def json_list(items: str, title: str, url: str, date: str, millis: bool = False, snippet: str | None = None, hour: int = 9, offset: int = 8, suffix: str = "", window_days: int | None = None) -> Callable[[str, dict], list[dict]]:
    """A parser of JSON answers: a dotted path to the items and to their fields; markup in titles goes."""

    def get(x, path: str):
        for k in path.split("."):
            x = x.get(k) if isinstance(x, dict) else x[int(k)] if isinstance(x, list) and k.isdigit() and int(k) < len(x) else None
        return x

    def parse(body: str, source: dict) -> list[dict]:
        try:
            found = get(json.loads(body), items) if items else json.loads(body)
        except ValueError:
            return []
        out, seen = [], set()
        for x in found or []:
            name = entities.unescape(re.sub(r"<[^>]+>", "", str(get(x, title) or ""))).strip()
            link = urljoin(source["url"], str(get(x, url) or ""))
            raw = get(x, date)
            if millis:
                published = iso(datetime.fromtimestamp(raw / 1000, timezone.utc)) if isinstance(raw, int | float) and raw > 0 else ""
            else:
                published = local_day(str(raw or ""), r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", hour, offset) if not suffix else iso(loose_date(f"{raw}{suffix}"))
            if window_days and (not published or loose_date(published) < source["now"] - timedelta(days=window_days)):
                continue
            if len(name) >= 3 and link not in seen:
                seen.add(link)
                body_text = entities.unescape(re.sub(r"<[^>]+>", "", str(get(x, snippet) or ""))).strip()[:500] if snippet else ""
                out.append(_row(name, link, published, body_text or name, source))
        return out

    return parse


def segments(items: list[dict], kind: str = "Article") -> list[list[dict]]:
    """Runs of consecutive items of a kind."""
    out: list[list[dict]] = []
    open_run = False
    for i in items:
        if i.get("kind") == kind:
            if not open_run:
                out.append([])
            out[-1].append(i)
        open_run = i.get("kind") == kind
    return out


def cdata_list(body: str, source: dict) -> list[dict]:
    """List items inside the CDATA sections of XML records; white space within dates is squashed first."""
    found = "".join(re.findall(r"(?s)<!\[CDATA\[(.*?)\]\]>", body))
    return html_list("li")(re.sub(r"(\d)\s*-\s*(\d)", r"\1-\2", found), source)


def dotted_feed(body: str, source: dict) -> list[dict]:
    """A feed whose dates are YYYY.MM.DD at 09:00 in UTC+9, else loose."""
    rows = []
    for i in parse_feed(body):
        at = local_day(i["date"], r"(\d{4})\.(\d{1,2})\.(\d{1,2})", 9, 9) or iso(loose_date(i["date"]))
        if len(i["title"]) >= 3:
            rows.append(_row(i["title"], i["url"], at, i["snippet"][:2000] or i["title"], source))
    return rows


def attribute_list(body: str, source: dict) -> list[dict]:
    """``<site>`` elements with Title, ID and Date (M/D/YYYY, 09:00 in UTC+3) as attributes."""
    rows = []
    for raw in re.findall(r"<site\b([^>]*)>", body):
        got = {k.lower(): entities.unescape(v) for k, v in re.findall(r'(\w+)="([^"]*)"', raw)}
        day = re.match(r"(\d{1,2})/(\d{1,2})/(\d{4})", got.get("date", ""))
        at = iso(datetime(int(day[3]), int(day[1]), int(day[2]), 9, tzinfo=timezone(timedelta(hours=3)))) if day else ""
        if got.get("id") and len(got.get("title", "")) >= 5:
            rows.append(_row(got["title"], urljoin(source["url"], f"?id={got['id']}"), at, got["title"], source))
    return rows


def relative_instant(text: str, now: datetime) -> str:
    """N分钟前, N小时前, N天前, 今天, 昨天, 前天 with or without a clock time, else a loose date."""
    amount = re.search(r"(\d+)\s*(分钟|小时|天)前", text)
    if amount:
        return iso(now - timedelta(**{{"分钟": "minutes", "小时": "hours", "天": "days"}[amount[2]]: int(amount[1])}))
    back = next((i for i, w in enumerate(("今天", "昨天", "前天")) if w in text), None)
    if back is None:
        return iso(loose_date(text))
    clock = re.search(r"(\d{1,2}):(\d{2})", text)
    wall = (now + timedelta(hours=8)).replace(hour=int(clock[1]) if clock else 12, minute=int(clock[2]) if clock else 0, second=0, microsecond=0)
    return iso(wall - timedelta(days=back, hours=8))


def relative_list(body: str, source: dict) -> list[dict]:
    """Cards with relative times; short summaries give way to the title."""
    rows, seen = [], set()
    for card in parse_html(body).find("*", class_="text_box"):
        a = next((x for x in card.find("a") if re.search(r"/\d{4}/\d{2}/.*\.html", x.attrs.get("href", ""))), None)
        if a is None or len(a.text()) < 5 or a.attrs["href"] in seen:
            continue
        seen.add(a.attrs["href"])
        when = next((t.text() for t in card.find("span", class_="time")), "")
        summary = next((p.text() for p in card.find("p")), "")
        rows.append(_row(a.text(), urljoin(source["url"], a.attrs["href"]), relative_instant(when, source["now"]), summary[:2000] if len(summary) >= 20 else a.text(), source))
    return rows


def timeline_list(body: str, source: dict) -> list[dict]:
    """Articles of a timeline: runs of consecutive article edges, at most 20 rows."""
    try:
        edges = json.loads(body)["data"]["timelines"]["edges"]
    except (ValueError, KeyError, TypeError):
        return []
    nodes = [{"kind": e["node"]["content"].get("__typename"), **e["node"]["content"]} for e in edges if e.get("node", {}).get("content")]
    rows = []
    for n in (x for run in segments(nodes) for x in run):
        day = re.match(r"(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{2})", n.get("published_at") or "")
        at = iso(datetime(*map(int, day.groups()), tzinfo=timezone(timedelta(hours=8)))) if day else iso(loose_date(n.get("published_at")))
        rows.append(_row(n.get("title", ""), urljoin(source["url"], n.get("path", "")), at, n.get("description") or n.get("simple_content") or n.get("title", ""), source))
    return rows[:20]


def with_details(listed: DataFrame, details: DataFrame, most: int = 15) -> DataFrame:
    """Listed rows (source_name, ord, source_url, ...) with the day of their detail page (url, html), some a source."""
    near = listed.withColumn("rn", F.row_number().over(Window.partitionBy("source_name").orderBy("ord"))).where(F.col("rn") <= most).drop("rn")
    day = F.regexp_extract("html", r"""(?s)class=["'][^"']*time[^"']*["'][^>]*>[^<]*?(\d{4}[-/]\d{1,2}[-/]\d{1,2})""", 1)
    dates = details.select(F.col("url").alias("source_url"), F.date_format(F.try_to_timestamp(F.regexp_replace(day, "/", "-"), F.lit("yyyy-M-d")), "yyyy-MM-dd'T04:00:00.000Z'").alias("published_at"))
    return near.drop("published_at").join(dates, "source_url", "left")


#: Parsers of list pages by registry key.
PARSERS: dict[str, Callable[[str, dict], list[dict]]] = {
    "feed": feed_rows,
    "anthropic": html_list("a", href=r"^/(news|research)/", date=r"(\d{4})-(\d{2})-(\d{2})", snippet="p"),
    "deepseek": html_list("*", href=r"/news/[^/]+/?$", date=r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", hour=12, snippet="p", class_="card"),
    "beijing": html_list("li", href=r"t\d{8}_"),
    "cac": html_list("li", href=r"/\d{4}-\d{2}/\d{2}/c_\d+\.htm"),
    "gov": json_list("searchVO.listVO", "title", "url", "pubtimeStr"),
    "jiangsu": cdata_list,
    "jiqizhixin": timeline_list,
    "msit": dotted_feed,
    "qbitai": relative_list,
    "sdaia": attribute_list,
    "zhidx": html_list("a", href=r"/p/\d+\.html", least=8),
    "guangdong": html_list("li", href=r"content/post_"),
    "meti": html_list("li", date=r"(\d{4})年(\d{1,2})月(\d{1,2})日", offset=9),
    "miit": json_list("data.searchResult.dataResults", "title", "url", "deploytime", window_days=45),
    "nda": html_list("li", date=r"(\d{4})\.(\d{1,2})\.(\d{1,2})"),
    "ndrc": html_list("li", date=r"(\d{4})/(\d{1,2})/(\d{1,2})"),
    "shanghai": json_list("data.list", "title", "url", "display_date"),
    "soumu": feed_rows,
    "tc260": html_list("li"),
    "thehill": json_list("", "title.rendered", "link", "date_gmt", snippet="excerpt.rendered", suffix="Z"),
    "xinzhiyuan": html_list("article", class_="entry-card"),
    "zhejiang": json_list("data.list", "title", "policyurl", "pubdate", millis=True),
}


def parse_pages(fetched: DataFrame, parsers: dict[str, Callable[[str, dict], list[dict]]] | None = None) -> DataFrame:
    """Candidates of fetched bodies: rows (scraper, name, url, category, language, source_type, body, now).

    Bodies are parsed where they are, batch by batch; an unknown key or a parser's exception becomes a row with the
    error in ``error`` and no title.
    """
    known = parsers or PARSERS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                source = {k: r.get(k) for k in ("name", "url", "category", "language", "source_type")} | {"now": pd.Timestamp(r["now"]).tz_localize("UTC").to_pydatetime()}
                parser = known.get(r["scraper"])
                try:
                    rows = parser(r["body"], source) if parser else []
                    error = None if parser else f"no scraper {r['scraper']}"
                except Exception as e:  # a page that breaks a parser must not stop the round
                    rows, error = [], f"SCRAPER_THROW {e}"[:200]
                out += [x | {"error": None} for x in rows] or ([dict.fromkeys(FIELDS) | {"source_name": r["name"], "error": error}] if error else [])
            yield pd.DataFrame(out, columns=[*FIELDS, "error"])

    return fetched.mapInPandas(run, f"{CANDIDATE}, error string")


def decode_column(rows: DataFrame, raw: str, declared: str) -> DataFrame:
    """``rows`` with encoding and text of a binary column; null bytes stay null."""

    @F.pandas_udf("encoding string, text string")
    def decoded(data: pd.Series, label: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if d is None else decode_bytes(bytes(d), x) for d, x in zip(data, label, strict=True)], columns=["encoding", "text"])

    return rows.withColumn("__d", decoded(raw, declared)).select(*rows.columns, "__d.encoding", "__d.text")


def html_to_text(column):
    """Body-level text by expressions only: noise elements go, blocks become lines, short lines go, 8,000 at most."""
    out = column
    for tag in ("script", "style", "noscript", "iframe", "svg", "nav", "header", "footer", "form", "aside"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: F.length(x) >= 8)
    return F.substring(F.array_join(lines, "\n"), 1, 8000)
