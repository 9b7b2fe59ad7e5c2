"""Queries of sources and of what happens to rows on their way in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import values
from tidewire.functions import text, times
from tidewire.operators import feeds, intake
from tidewire.plans.adapters import ARTICLES, articles, read
from tidewire.queries import Catalog
from tidewire.sources import parse

catalog = Catalog()
A = f"WITH {ARTICLES} "
HOME = "https://x.example/list/"
#: Each page as a listed item: its id, a title and a day of January 2024.
ITEMS = "SELECT page_id AS id, page_id // 10 AS chunk, 's' || (page_id // 10 % 7) AS source_name, 'Notice ' || page_id || ' of ' || strlen(coalesce(html, '')) AS title, page_id % 28 + 1 AS d FROM pages"


def _items(s, d):
    i = F.col("page_id")
    return read(s, d, "pages").select(i.alias("id"), F.floor(i / 10).alias("chunk"), F.concat(F.lit("s"), (F.floor(i / 10) % 7).cast("string")).alias("source_name"), F.concat(F.lit("Notice "), i.cast("string"), F.lit(" of "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")).alias("title"), (i % 28 + 1).alias("d"))


def _filled(template: str):
    """A template with the item's {id}, {title}, {d}, {dd} (two digits), {ms} (the day in milliseconds) and {h} (hours)."""
    out = F.lit(template)
    day = F.col("d").cast("string")
    known = {"id": F.col("id").cast("string"), "title": F.col("title"), "d": day, "dd": F.lpad(day, 2, "0"), "ms": (F.lit(1704067200000) + (F.col("d") - 1) * 86400000).cast("string"), "h": (F.col("id") % 48 + 1).cast("string")}
    for name, value in known.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _listed(name: str, key: str, item: str, url: str, published: str, head: str = "", tail: str = "", between: str = "", now: str = "2024-01-20 00:00:00", where: str = "true") -> None:
    """Register a query that parses list pages of ten items each, and its SQL, which never sees a page."""

    @catalog.add(name, f"SELECT title, source_name, {url} AS source_url, {published} AS published_at FROM ({ITEMS}) WHERE {where}")
    def _(s, d):
        pages = _items(s, d).groupBy("source_name", "chunk").agg(F.concat(F.lit(head), F.array_join(F.collect_list(_filled(item)), between), F.lit(tail)).alias("body"))
        fetched = pages.select(F.lit(key).alias("scraper"), F.col("source_name").alias("name"), F.lit(HOME).alias("url"), F.lit("policy").alias("category"), F.lit("zh").alias("language"), F.lit("official").alias("source_type"), "body", F.lit(now).alias("now"))
        return parse.parse_pages(fetched).select("title", "source_name", "source_url", "published_at")


def _at(hour: str) -> str:
    """The item's day at an hour of UTC."""
    return f"'2024-01-' || lpad(d::VARCHAR, 2, '0') || 'T{hour}:00:00.000Z'"


_LI = "<li><a href=\"{0}\" title=\"{{title}}\">x</a> <span>{1}</span></li>"
_listed("S03_news_cards", "anthropic", '<a href="/news/n{id}" title="{title}"><time datetime="2024-01-{dd}T00:00:00Z">x</time><p>about</p></a>', "'https://x.example/news/n' || id", _at("00"))
_listed("S04_chinese_cards", "deepseek", '<div class="card"><a href="/news/n{id}">{title}</a> 2024 年 1 月 {d} 日<p>about</p></div>', "'https://x.example/news/n' || id", _at("04"))
_listed("S05_titled_links", "beijing", _LI.format("./202401/t202401{dd}_{id}.html", "2024-01-{dd}"), "'https://x.example/list/202401/t202401' || lpad(d::VARCHAR, 2, '0') || '_' || id || '.html'", _at("01"))
_listed("S06_dated_paths", "cac", '<li><a href="/2024-01/{dd}/c_{id}.htm">{title}</a> 2024-01-{dd}</li>', "'https://x.example/2024-01/' || lpad(d::VARCHAR, 2, '0') || '/c_' || id || '.htm'", _at("01"))
_listed("S07_search_answers", "gov", '{"title":"<em>{title}</em>","url":"https://x.example/g/{id}","pubtimeStr":"2024.01.{dd}"}', "'https://x.example/g/' || id", _at("01"), '{"searchVO":{"listVO":[', "]}}", ",")
_listed("S08_plain_links", "zhidx", '<a href="/p/{id}.html" title="{title}">2024-01-{dd}</a>', "'https://x.example/p/' || id || '.html'", _at("01"))
_listed("S09_cdata_records", "jiangsu", '<record><![CDATA[<li><a href="/art/{id}.html" title="{title}">x</a><span>2024 - 01 - {dd}</span></li>]]></record>', "'https://x.example/art/' || id || '.html'", _at("01"), "<datastore>", "</datastore>")
_listed("S10_timeline", "jiqizhixin", '{"node":{"content":{"__typename":"Article","title":"{title}","path":"/a/{id}","published_at":"2024/1/{d} 10:00:00"}}},{"node":{"content":{"__typename":"Ad","title":"ad"}}}', "'https://x.example/a/' || id", _at("02"), '{"data":{"timelines":{"edges":[', "]}}}", ",")
_listed("S11_japanese_days", "meti", _LI.format("/m/{id}", "2024年1月{d}日"), "'https://x.example/m/' || id", _at("00"))
_listed("S12_bounded_search", "miit", '{"title":"{title}","url":"/z/{id}","deploytime":"2024-01-{dd}"}', "'https://x.example/z/' || id", _at("01"), '{"data":{"searchResult":{"dataResults":[', "]}}}", ",", "2024-02-20 00:00:00", "d >= 6")
_listed("S13_dotted_feed", "msit", "<item><title>{title}</title><link>https://x.example/k/{id}</link><pubDate>2024.01.{dd}</pubDate></item>", "'https://x.example/k/' || id", _at("00"), "<rss><channel>", "</channel></rss>")
_listed("S14_post_links", "guangdong", _LI.format("/content/post_{id}.html", "2024-01-{dd}"), "'https://x.example/content/post_' || id || '.html'", _at("01"))
_listed("S15_slashed_days", "ndrc", _LI.format("./t{id}.html", "2024/01/{dd}"), "'https://x.example/list/t' || id || '.html'", _at("01"))
_listed("S16_relative_times", "qbitai", '<div class="text_box"><h4><a href="https://x.example/2024/01/{id}.html">{title}</a></h4><p>short</p><span class="time">{h}小时前</span></div>', "'https://x.example/2024/01/' || id || '.html'", "strftime(TIMESTAMP '2024-01-20 00:00:00' - to_hours(id % 48 + 1), '%Y-%m-%dT%H:%M:%S.000Z')")
_listed("S17_attributes", "sdaia", '<site ID="{id}" Title="{title}" Date="1/{d}/2024 1:00"/>', "'https://x.example/list/?id=' || id", _at("06"), "<r>", "</r>")
_listed("S18_paged_answers", "shanghai", '{"title":"{title}","url":"/h/{id}","display_date":"2024-01-{dd}"}', "'https://x.example/h/' || id", _at("01"), '{"data":{"list":[', "]}}", ",")
_listed("S19_rdf", "soumu", "<item><title>{title}</title><link>https://x.example/j/{id}</link><dc:date>2024-01-{dd}T09:00:00+09:00</dc:date></item>", "'https://x.example/j/' || id", _at("00"), '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns="http://purl.org/rss/1.0/">', "</rdf:RDF>")
_listed("S20_home_blocks", "tc260", _LI.format("/front/{id}.html", "2024-01-{dd}"), "'https://x.example/front/' || id || '.html'", _at("01"))
_listed("S21_posts_answers", "thehill", '{"title":{"rendered":"{title}"},"link":"https://x.example/w/{id}","date_gmt":"2024-01-{dd}T10:00:00","excerpt":{"rendered":"<p>x</p>"}}', "'https://x.example/w/' || id", _at("10"), "[", "]", ",")
_listed("S22_entry_cards", "xinzhiyuan", '<article class="entry-card"><a href="/x/{id}">{title}</a><time datetime="2024-01-{dd}T03:00:00+00:00">x</time></article>', "'https://x.example/x/' || id", _at("03"))
_listed("S23_form_answers", "zhejiang", '{"title":"{title}","policyurl":"/v/{id}","pubdate":{ms}}', "'https://x.example/v/' || id", _at("00"), '{"data":{"list":[', "]}}", ",")


@catalog.add("S02_unregistered", "SELECT DISTINCT 's' || (page_id // 10 % 7) AS source_name, 'no scraper nobody' AS error FROM pages")
def _(s, d):
    one = _items(s, d).select("source_name").distinct()
    fetched = one.select(F.lit("nobody").alias("scraper"), F.col("source_name").alias("name"), F.lit(HOME).alias("url"), F.lit("x").alias("category"), F.lit("x").alias("language"), F.lit("x").alias("source_type"), F.lit("<p>").alias("body"), F.lit("2024-01-20 00:00:00").alias("now"))
    return parse.parse_pages(fetched).select("source_name", "error")


@catalog.add("S24_two_levels", f"SELECT source_name, id, {_at('04')} AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY id) AS rn FROM ({ITEMS})) WHERE rn <= 15")
def _(s, d):
    rows = _items(s, d).withColumn("source_url", F.concat(F.lit(HOME), F.col("id").cast("string")))
    details = rows.select(F.col("source_url").alias("url"), _filled('<span class="post-time">on 2024/1/{d}</span>').alias("html"))
    return parse.with_details(rows.select("source_name", F.col("id").alias("ord"), "id", "source_url"), details).select("source_name", "id", "published_at")


@catalog.add("S33_health_errors", f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'boom ' || url END AS thrown, CASE WHEN page_id % 11 = 0 THEN 'timeout' END AS error, CASE WHEN page_id % 5 <> 0 THEN strlen(html) % 3 END AS matched,
    CASE WHEN page_id % 7 <> 0 THEN CASE WHEN page_id % 4 = 0 THEN 503 ELSE 200 END END AS status, page_id % 3 AS n, strlen(html) % 2 AS fresh FROM pages)
    SELECT page_id, CASE WHEN thrown IS NOT NULL THEN 'SCRAPER_THROW ' || substr(thrown, 1, 180) WHEN error IS NOT NULL THEN 'SCRAPER_ERROR ' || error
    WHEN matched = 0 THEN 'PARSED_ZERO http=' || coalesce(status::VARCHAR, 'n/a') || '{values.HEALTH_NOTES["PARSED_ZERO"]}' WHEN status < 200 OR status > 299 THEN 'HTTP ' || status
    WHEN matched IS NULL AND n = 0 THEN 'ZERO_NO_META{values.HEALTH_NOTES["ZERO_NO_META"]}' WHEN fresh = 0 AND matched > 0 THEN 'FILTERED_ALL matched=' || matched || '{values.HEALTH_NOTES["FILTERED_ALL"]}' ELSE '' END AS error FROM h""")
def _(s, d):
    i, size = F.col("page_id"), F.octet_length("html")
    error = intake.scrape_health(F.when(i % 13 == 0, F.concat(F.lit("boom "), "url")), F.when(i % 11 == 0, "timeout"), F.when(i % 5 != 0, size % 3), F.when(i % 7 != 0, F.when(i % 4 == 0, 503).otherwise(200)), i % 3, size % 2)
    return read(s, d, "pages").select("page_id", F.coalesce(error, F.lit("")).alias("error"))


@catalog.add("P01_candidates", "SELECT event_id AS id, event_type AS title FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def _(s, d):
    i = F.col("event_id")
    rows = read(s, d, "events").select(i.alias("id"), F.when(i % 7 == 0, " 　\n").otherwise(F.concat(F.lit(" \t"), "event_type", F.lit("  "))).alias("title"), F.when(i % 11 != 0, "https://x.example").alias("source_url"))
    return intake.candidates(rows).select("id", "title")


@catalog.add("P04_feed_times", """SELECT event_id FROM events WHERE CASE WHEN event_id % 10 = 0 THEN user_id % 2 = 0
    ELSE ts <= TIMESTAMP '2024-01-21 00:00:00' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - to_hours(CASE WHEN user_id % 2 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 240 ELSE 168 END ELSE CASE WHEN user_id % 3 = 0 THEN 240 ELSE 36 END END) END""")
def _(s, d):
    official = F.col("user_id") % 2 == 0
    direct, _ = times.windows(official, F.when(F.col("user_id") % 3 == 0, 10))
    kept = intake.feed_time(F.when(F.col("event_id") % 10 != 0, F.col("ts")), official, direct, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return read(s, d, "events").where(kept).select("event_id")


@catalog.add("P05_not_noise", "SELECT event_id AS id FROM events WHERE event_type <> 'error'")
def _(s, d):
    return articles(s, d).where(feeds.not_noise()).select("id")


_SAID = "coalesce(text, '')"


@catalog.add("P18_service_failure", "SELECT doc_id, " + " OR ".join(f"contains({_SAID}, '{w}')" for w in values.SERVICE_FAILURES) + " AS failed FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", text.service_failure(F.col("text")).alias("failed"))


@catalog.add("P19_reason_class", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'quality' ELSE 'fetch' END AS class, contains(lower(url), 'host-1') OR page_id % 5 = 0 AS refusing FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)")
def _(s, d):
    i = F.col("page_id")
    url = F.concat(F.when(i % 5 == 0, "https://WWW.Politico.com/").otherwise(F.when(F.contains(F.lower("url"), F.lit("host-1")), "https://aiera.com.cn/").otherwise("https://x.example/")), i.cast("string"))
    reason = F.when(i % 6 == 0, "Ungrounded_Summary:x").when(i % 3 == 0, "摘要与正文对不上").otherwise("missing_body")
    return read(s, d, "pages").withColumn("url", F.coalesce("url", F.lit(""))).select("page_id", text.reason_class(reason).alias("class"), intake.refusing(url).alias("refusing"))


_ORG = "|".join(values.INCIDENT_ORGS)
_TRIGGER = "|".join(w.replace("-", "\\-") for w in values.INCIDENT_TRIGGERS)


@catalog.add("P20_incidents", f"SELECT doc_id, regexp_matches(t, '(?i){_TRIGGER}') AND (regexp_matches(t, '(?i)(^|[^A-Za-z0-9_])({_ORG})([^A-Za-z0-9_]|$)') OR doc_id % 5 = 0) AS incident FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A recall at Meta: ' WHEN doc_id % 3 = 1 THEN 'metadata outage ' ELSE '' END || {_SAID} AS t FROM documents)")
def _(s, d):
    i = F.col("doc_id")
    title = F.concat(F.when(i % 3 == 0, "A recall at Meta: ").when(i % 3 == 1, "metadata outage ").otherwise(""), F.coalesce("text", F.lit("")))
    return read(s, d, "documents").select("doc_id", text.is_incident(title, F.lit(""), F.when(i % 5 == 0, "The Register").otherwise("x")).alias("incident"))


@catalog.add("P21_roundups", f"""SELECT doc_id, doc_id % 4 <> 0 AND length(trim({_SAID}, ' ')) >= 200 AND (regexp_matches(t, '[；;｜|]') AND length(t) >= 20 OR regexp_matches(t, '{values.ROUNDUP_COLUMN}') AND length(t) >= 12) AS roundup
    FROM (SELECT *, string_split({_SAID}, chr(10))[1] || CASE doc_id % 3 WHEN 0 THEN '; more' WHEN 1 THEN ' 早报' ELSE '' END AS t FROM documents)""")
def _(s, d):
    i, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    title = F.concat(F.split(body, "\n")[0], F.when(i % 3 == 0, "; more").when(i % 3 == 1, " 早报").otherwise(""))
    return read(s, d, "documents").select("doc_id", text.is_roundup(title, body, i % 4 == 0).alias("roundup"))


@catalog.add("P24_fatal_probe", f"SELECT event_id, user_id % 10 IN (1, 2, 3) OR regexp_matches(event_type || CASE WHEN event_id % 17 = 0 THEN ' incorrect api KEY' ELSE '' END, '{values.FATAL_ANSWER}') AS fatal FROM events")
def _(s, d):
    answer = F.concat("event_type", F.when(F.col("event_id") % 17 == 0, " incorrect api KEY").otherwise(""))
    return read(s, d, "events").select("event_id", intake.fatal_probe(F.col("user_id") % 10 + 400, answer).alias("fatal"))


@catalog.add("P26_clickbait", f"SELECT doc_id, regexp_matches({_SAID} || CASE WHEN doc_id % 9 = 0 THEN '突发' ELSE '' END, '{values.CLICKBAIT}') AS bait FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 0, "突发").otherwise("")).rlike(values.CLICKBAIT).alias("bait"))


@catalog.add("F16_replaced_percent", "SELECT doc_id, round(CASE WHEN length(t) = 0 THEN 100.0 ELSE 100.0 * (length(t) - length(replace(t, '�', ''))) / length(t) END, 6) AS percent FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), 'a', '�') ELSE coalesce(text, '') END AS t FROM documents)")
def _(s, d):
    body = F.coalesce("text", F.lit(""))
    said = F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 3 == 0, F.replace(body, F.lit("a"), F.lit("�"))).otherwise(body)
    return read(s, d, "documents").select("doc_id", F.round(text.replaced_percent(said), 6).alias("percent"))


@catalog.add("T03_publish_days", "SELECT CASE WHEN event_id % 19 = 0 THEN 'unknown' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') END AS date_key, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    rows = read(s, d, "events").withColumn("published_ts", F.when(F.col("event_id") % 19 != 0, F.col("ts")))
    return intake.route(rows).groupBy("date_key").agg(F.count("*").alias("n"))


@catalog.add("T04_dead_letters", "SELECT event_id FROM events WHERE event_id % 19 = 0")
def _(s, d):
    rows = read(s, d, "events").withColumn("published_ts", F.when(F.col("event_id") % 19 != 0, F.col("ts")))
    return intake.route(rows).where(F.col("date_key") == values.SENTINEL).select("event_id")


@catalog.add("T06_round_history", A + "SELECT n.id, count(DISTINCT h.id) > 0 AS known FROM a n LEFT JOIN a h ON h.event_norm = n.event_norm AND h.id % 50 = 0 AND h.date_key <> 'unknown' AND h.date_key >= '2024-01-21' WHERE n.id % 50 <> 0 GROUP BY 1")
def _(s, d):
    a = articles(s, d).select("id", "event_norm", "date_key")
    state = a.where("id % 50 = 0 and date_key <> 'unknown' and date_key >= '2024-01-21'").select("event_norm", F.lit(True).alias("known")).distinct()
    return a.where("id % 50 <> 0").join(state, "event_norm", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@catalog.add("T07_retry_queue", """WITH q AS (SELECT page_id, page_id % 4 AS done, page_id % 3 = 0 AS held, page_id % 5 = 0 AS refusing, page_id % 7 < 3 AS clean FROM pages),
    n AS (SELECT *, CASE WHEN done >= 3 OR (clean AND NOT held) THEN done ELSE done + CASE WHEN held THEN 1 WHEN refusing THEN 2 ELSE 1 END END AS after FROM q)
    SELECT CASE WHEN refusing THEN 'https://www.thehill.com/' ELSE 'https://x.example/' END || page_id AS source_url, CASE WHEN done >= 3 THEN 'shelved' WHEN held THEN 'held' WHEN clean THEN 'released' WHEN after >= 3 THEN 'shelved' ELSE 'queued' END AS state, after::BIGINT AS attempts FROM n""")
def _(s, d):
    i = F.col("page_id")
    queue = read(s, d, "pages").select("page_id", F.concat(F.when(i % 5 == 0, "https://www.thehill.com/").otherwise("https://x.example/"), i.cast("string")).alias("source_url"), F.when(i % 3 == 0, "ungrounded_summary:x").otherwise("missing_body").alias("reason"), F.when(i % 4 != 0, i % 4).alias("attempts"))
    return intake.retry(queue, queue.where("page_id % 7 < 3").select("source_url"))


@catalog.add("A19_overflow", A + "SELECT date_key, greatest(0, count(*) - 30) AS hidden FROM a GROUP BY 1")
def _(s, d):
    return articles(s, d).groupBy("date_key").agg(F.count("*").alias("n")).select("date_key", intake.overflow(F.col("n"), 30).alias("hidden"))
