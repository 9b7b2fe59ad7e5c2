"""Queries over the column functions and the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import values
from tidewire.functions import scores, text, times, urls
from tidewire.plans.adapters import ARTICLES, articles, read
from tidewire.queries import Catalog
from tidewire.sources import parse

catalog = Catalog()
A = f"WITH {ARTICLES} "
TITLE = "substr(text, 1, 60)"
SPACE = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
PUNCT = """[|｜·—～~\\-，。；：、！？“”‘’《》〈〉「」『』()（）\\[\\]{}<>/.,;:!?"'']"""


def _docs(s, d):
    return read(s, d, "documents")


@catalog.add("F01_normalize_url", f"""WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b FROM pages),
    q AS (SELECT page_id, lower(regexp_extract(b, '^([a-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(b, '^[a-z]+://([^/?]*)', 1)), '^www\\.', '') AS h, regexp_extract(b, '^[a-z]+://[^/?]*([^?]*)', 1) AS path,
      list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains([{", ".join("'" + p + "'" for p in values.TRACKING_PARAMS)}], lower(string_split(x, '=')[1]))) AS k FROM p),
    w AS (SELECT page_id, h, CASE WHEN path = '' THEN '/' ELSE path END AS path, CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS t FROM q)
    SELECT page_id, CASE WHEN (h || path || t) LIKE '%/' AND NOT (path = '/' AND t = '') THEN substr(h || path || t, 1, length(h || path || t) - 1) ELSE h || path || t END AS norm FROM w""")
def _(s, d):
    return read(s, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("norm"))


@catalog.add("F02_normalize_title", f"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({TITLE}, '【[^】]*】', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '{SPACE}', '', 'g'), '{PUNCT}', '', 'g')) AS norm FROM documents""")
def _(s, d):
    return _docs(s, d).select("doc_id", text.normalize_title(F.substring("text", 1, 60)).alias("norm"))


@catalog.add("F03_dedupable", f"SELECT doc_id, length(lower(regexp_replace(regexp_replace({TITLE}, '{SPACE}', '', 'g'), '{PUNCT}', '', 'g'))) >= 8 AS ok FROM documents WHERE {TITLE} NOT LIKE '%[%'")
def _(s, d):
    return _docs(s, d).where(~F.substring("text", 1, 60).contains("[")).select("doc_id", text.dedupable(text.normalize_title(F.substring("text", 1, 60))).alias("ok"))


@catalog.add("F04_normalize_event", f"SELECT doc_id, regexp_replace(lower({TITLE}), '[\\s\\x{{3000}}\\p{{P}}]', '', 'g') AS norm FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.normalize_event(F.substring("text", 1, 60)).alias("norm"))


GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i, 2)))"
@catalog.add("F05_dice", f"""WITH p AS (SELECT x.doc_id, substr(x.text, 1, 40) AS a, substr(y.text, 1, 40) AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 WHERE length(substr(x.text, 1, 40)) > 1 AND length(substr(y.text, 1, 40)) > 1)
    SELECT doc_id, round(2.0::DOUBLE * len(list_intersect({GRAMS.format('a')}, {GRAMS.format('b')})) / (len({GRAMS.format('a')}) + len({GRAMS.format('b')})), 6) AS dice FROM p""")
def _(s, d):
    t = _docs(s, d).select("doc_id", F.substring("text", 1, 40).alias("a"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").where("length(a) > 1 and length(b) > 1")
    return p.select("doc_id", F.round(text.dice(F.col("a"), F.col("b")), 6).alias("dice"))


@catalog.add("F06_numbers", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') AS nums FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(text.numbers(F.col("text")), ",").alias("nums"))


@catalog.add("F07_jaccard", """WITH p AS (SELECT x.doc_id, list_distinct(string_split(x.text, ' ')) AS a, list_distinct(string_split(y.text, ' ')) AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)
    SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS j FROM p""")
def _(s, d):
    t = _docs(s, d).select("doc_id", F.array_distinct(F.split("text", " ")).alias("a"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return p.select("doc_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@catalog.add("F08_day_key", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", times.day_key(F.col("ts")).alias("day"))


DATED = "'https://x.example' || CASE o_orderkey % 4 WHEN 0 THEN '/' || strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m') || '/t' || strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m%d') || '_1.html' WHEN 1 THEN '/' || strftime(o_orderdate + INTERVAL 25 YEAR, '%Y/%m/%d') || '/n' WHEN 2 THEN '/a/' || strftime(o_orderdate + INTERVAL 25 YEAR, '%Y%m%d') || '/' ELSE '/none' END"
@catalog.add("F09_date_from_url", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%dT01:00:00.000Z') END AS published FROM orders")
def _(s, d):
    o = read(s, d, "orders")
    day = F.col("o_orderdate") + F.expr("INTERVAL 25 YEAR")
    form = lambda f: F.date_format(day, f)
    kind = F.col("o_orderkey") % 4
    url = F.concat(F.lit("https://x.example"), F.when(kind == 0, F.concat(F.lit("/"), form("yyyyMM"), F.lit("/t"), form("yyyyMMdd"), F.lit("_1.html"))).when(kind == 1, F.concat(F.lit("/"), form("yyyy/MM/dd"), F.lit("/n"))).when(kind == 2, F.concat(F.lit("/a/"), form("yyyyMMdd"), F.lit("/"))).otherwise("/none"))
    return o.select("o_orderkey", F.coalesce(urls.published_from_url(url), F.lit("")).alias("published"))


@catalog.add("F15_replaced_ratio", A + "SELECT id, round((length(summary) - length(replace(summary, '�', '')))::DOUBLE / length(summary), 6) AS r FROM a")
def _(s, d):
    return articles(s, d).select("id", F.round(text.replaced_ratio(F.col("summary")), 6).alias("r"))


@catalog.add("P17_clean_entry", A + "SELECT id, length(title) > 2 AND title NOT LIKE '%�%' AND length(summary) >= 5 AND (length(summary) - length(replace(summary, '�', ''))) * 20 <= length(summary) AS ok FROM a")
def _(s, d):
    return articles(s, d).select("id", ((F.length("title") > 2) & ~F.col("title").contains("�") & (F.length("summary") >= 5) & (text.replaced_percent(F.col("summary")) <= 5)).alias("ok"))


@catalog.add("F17_sub_scores", A + "SELECT id, CASE WHEN id % 11 = 0 THEN 50 ELSE least(floor(ai_score / 2.0 + 0.5), 40) + least(floor((id % 63) / 2.0 + 0.5), 30) + least(id % 35, 30) END::BIGINT AS score FROM a")
def _(s, d):
    gone = F.col("id") % 11 == 0
    part = lambda c: F.when(~gone, c.cast("double"))
    return articles(s, d).select("id", scores.sub_scores(part(F.col("ai_score") / 2), part((F.col("id") % 63) / 2), part(F.col("id") % 35), F.lit(50)).alias("score"))


@catalog.add("F18_ceilings", A + "SELECT id, CASE WHEN id % 7 = 0 THEN ai_score WHEN id % 3 = 0 AND id % 2 = 0 THEN least(ai_score, 72) WHEN id % 3 = 0 THEN least(ai_score, 79) WHEN id % 2 = 0 THEN least(ai_score, 72) ELSE ai_score END AS score FROM a")
def _(s, d):
    i = F.col("id")
    return articles(s, d).select("id", scores.capped(F.col("ai_score"), i % 2 == 0, i % 3 == 0, i % 7 == 0).alias("score"))


@catalog.add("F20_canonical_tags", A + "SELECT id, array_to_string(list_distinct(list_transform(list_filter(companies, lambda c: c IN ('c1', 'c2', 'd3')), lambda c: CASE WHEN c = 'd3' THEN 'C-ONE' WHEN c = 'c1' THEN 'C-ONE' ELSE 'C-TWO' END)), ',') AS names FROM a")
def _(s, d):
    aliases = F.create_map(*[F.lit(x) for x in ("c1", "C-ONE", "c2", "C-TWO", "d3", "C-ONE")])
    return articles(s, d).select("id", F.array_join(scores.canonical_tags(F.transform("companies", lambda c: F.upper(c)), aliases), ",").alias("names"))


@catalog.add("F22_tag_invariant", A + "SELECT id, CASE WHEN category = 'policy' THEN array_to_string(regions, ',') ELSE '' END AS regions FROM a")
def _(s, d):
    return articles(s, d).select("id", F.when(F.col("category") == "policy", F.array_join("regions", ",")).otherwise("").alias("regions"))


@catalog.add("F23_category_check", A + "SELECT id, CASE WHEN category IN ('policy', 'noise') THEN category ELSE 'technology' END AS category FROM a")
def _(s, d):
    return articles(s, d).select("id", F.when(F.col("category").isin(values.CATEGORIES), F.col("category")).otherwise("technology").alias("category"))


@catalog.add("F24_safe_json", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE regexp_extract(props, '[0-9]+')::BIGINT END AS k FROM events")
def _(s, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("[1, broken")).otherwise(F.col("props"))
    ok = F.try_parse_json(raw).isNotNull() & raw.startswith("{")
    return read(s, d, "events").select("event_id", F.coalesce(F.when(ok, F.from_json(raw, "k long")["k"]), F.lit(-1)).alias("k"))


@catalog.add("F26_tag_values", A + "SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_concat(companies, keywords, ['llm'])), lambda v: v <> 'llm')), ',') AS tags FROM a")
def _(s, d):
    return articles(s, d).select("id", F.array_join(F.array_sort(scores.tag_values(F.col("companies"), F.col("keywords"), F.array(F.lit(" LLM ")))), ",").alias("tags"))


@catalog.add("F27_key_points", "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), lambda p: substr(trim(p), 1, 80))[1:4], '|') AS points FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(text.key_points(F.split("text", "\n")), "|").alias("points"))


_SPACES = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@catalog.add("F28_verify_quote", f"""SELECT doc_id, (length(q) BETWEEN 8 AND 120 AND contains(regexp_replace(t, '{_SPACES}', '', 'g'), regexp_replace(q, '{_SPACES}', '', 'g')))::BIGINT AS ok
    FROM (SELECT doc_id, t, regexp_replace(trim('“' || substr(t, 5, 5 + doc_id % 130) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'zzzzqqqq' END || '” '), '^["“”「『]+|["“”」』]+$', '', 'g') AS q FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def _(s, d):
    body = F.coalesce("text", F.lit(""))
    quote = F.concat(F.lit("“"), F.substring(body, F.lit(5), (F.col("doc_id") % 130 + 5).cast("int")), F.when(F.col("doc_id") % 2 == 0, "").otherwise("zzzzqqqq"), F.lit("” "))
    return _docs(s, d).select("doc_id", (text.verify_quote(quote, body) != "").cast("long").alias("ok"))


@catalog.add("F30_grounding")
def _(s, d):
    stop = ["AI", "API", "CEO", "GPU"]
    return _docs(s, d).select("doc_id", F.size(text.hard_tokens(F.col("text"), stop)).alias("tokens"), text.grounded(F.col("text"), F.col("text"), stop).alias("grounded"))


_WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def shell_sql(x: str) -> str:
    """Whether a text is a page shell, in DuckDB."""
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {_strip_sql('l')})"
    patterns = [r"(?i)404\s*(not\s*found|页面|错误)", r"(?i)(^|[^A-Za-z0-9_])not\s*found([^A-Za-z0-9_]|$)", r"HTTP\s*/?\s*1\.[01]\s+404"]
    arms = [f"{_strip_sql(x)} = ''", *(f"regexp_matches({x}, '{r}')" for r in patterns), *(f"contains({x}, '{m}')" for m in values.SHELL_STRONG)]
    arms.append(f"len(list_filter({lines}, lambda l: length(l) <= {values.SHELL_LINE} AND regexp_matches(l, '{'|'.join(values.SHELL_WEAK)}'))) > 0")
    arms.append(f"length(array_to_string(list_filter({lines}, lambda l: l <> '' AND NOT (length(l) <= {values.NAVIGATION_LINE} AND regexp_matches(l, '{values.NAVIGATION}'))), chr(10))) < {values.LEAST_MATERIAL}")
    return "(" + " OR ".join(arms) + ")"


#: Every other document has its text as the content, the others only as a snippet; the title is the first line.
MATERIAL_SQL = f"""SELECT doc_id, CASE WHEN length(c) >= 200 AND NOT {shell_sql('c')} THEN 'content'
    WHEN length(n) >= 200 AND NOT {shell_sql('n')} AND NOT (n = t OR (t <> '' AND length(n) < 300 AND (contains(n, t) OR contains(t, n)))) THEN 'snippet' ELSE 'none' END AS m
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS c, {_strip_sql("coalesce(text, '')")} AS n, {_strip_sql("string_split(coalesce(text, ''), chr(10))[1]")} AS t FROM documents)"""


def material(s, d):
    """(doc_id, m): what each document offers for a summary."""
    body = F.coalesce("text", F.lit(""))
    m = text.pick_material(F.when(F.col("doc_id") % 2 == 0, body).otherwise(""), body, F.split(body, "\n")[0])
    return _docs(s, d).select("doc_id", F.coalesce(m["from"], F.lit("none")).alias("m"))


@catalog.add("F29_material", MATERIAL_SQL)
def _(s, d):
    return material(s, d)


@catalog.add("F32_reason_code", A + "SELECT id, string_split(summary || ':' || id, ':')[1] AS code FROM a")
def _(s, d):
    return articles(s, d).select("id", F.split_part(F.concat("summary", F.lit(":"), F.col("id").cast("string")), F.lit(":"), F.lit(1)).alias("code"))


@catalog.add("F33_relative_time", "SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-20 03:00:00' - to_minutes(event_id % 50) WHEN 1 THEN TIMESTAMP '2024-01-20 03:00:00' - to_hours(event_id % 20) WHEN 2 THEN TIMESTAMP '2024-01-19 00:30:00' ELSE TIMESTAMP '2024-01-20 04:00:00' END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(s, d):
    i = F.col("event_id")
    said = F.when(i % 4 == 0, F.concat((i % 50).cast("string"), F.lit("分钟前"))).when(i % 4 == 1, F.concat((i % 20).cast("string"), F.lit(" 小时前"))).when(i % 4 == 2, F.lit("昨天 08:30")).otherwise("今天")
    return read(s, d, "events").select("event_id", F.date_format(times.relative_time(said, F.lit("2024-01-20 03:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@catalog.add("F34_chinese_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT04:00:00.000Z') AS at FROM orders")
def _(s, d):
    day = F.date_format("o_orderdate", "发布于 yyyy年M月d日".replace("发布于 ", "'发布于 '"))
    return read(s, d, "orders").select("o_orderkey", times.chinese_date(day).alias("at"))


def _text_sql(x: str) -> str:
    """What ``parse.html_to_text`` does, in DuckDB."""
    for tag in ("script", "style", "noscript", "iframe", "svg", "nav", "header", "footer", "form", "aside"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table)>|<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{sign}')"
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\r]+', ' ', 'g'))), lambda l: length(l) >= 8)"
    return f"substr(array_to_string({lines}, chr(10)), 1, 8000)"


@catalog.add("F35_html_to_text", f"SELECT page_id, length(t) AS chars, sha256(t) AS sha FROM (SELECT page_id, {_text_sql('html')} AS t FROM pages)")
def _(s, d):
    return read(s, d, "pages").select("page_id", F.length(parse.html_to_text(F.col("html"))).alias("chars"), F.sha2(parse.html_to_text(F.col("html")), 256).alias("sha"))


_IMAGES = r"""(?i)<img[^>]*?\b(?:data-src|data-original|src)=["'](https?://[^"']+)["']"""
_PAGE = """html || '<img src="' || url || '"><img class=x src="' || url || '/a.PNG"><img data-src="' || url || CASE WHEN page_id % 2 = 0 THEN '/a.PNG' ELSE '/b.webp?w=1' END || '"><img src="/c.jpg"><img data-original="https://x.example/' || page_id % 3 || '.jpeg"><img src="https://x.example/i.svg">'"""


@catalog.add("F36_image_refs", f"SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(p, '{_IMAGES.replace(chr(39), chr(39) * 2)}', 1), lambda u: regexp_matches(u, '(?i)\\.(png|jpe?g|webp|gif)(\\?|$)')))) AS images FROM (SELECT page_id, {_PAGE} AS p FROM pages)")
def _(s, d):
    refs = F.regexp_extract_all(F.expr(_PAGE.replace("page_id % 3", "(page_id % 3)")), F.lit(_IMAGES), F.lit(1))
    return read(s, d, "pages").select("page_id", F.size(F.array_distinct(F.filter(refs, lambda u: u.rlike(r"(?i)\.(png|jpe?g|webp|gif)(\?|$)")))).cast("long").alias("images"))


@catalog.add("F38_hours_since", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 3.6e9, 6) AS h FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", F.round(times.hours_between(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts")), 6).alias("h"))


@catalog.add("F39_thresholds", A + "SELECT DISTINCT source_name, CASE WHEN source_name = 'u5' THEN 2 WHEN length(source_name) = 2 THEN 7 ELSE 3 END::BIGINT AS threshold FROM a")
def _(s, d):
    own = F.when(F.col("source_name") == "u5", 2)
    return articles(s, d).select("source_name").distinct().select("source_name", F.coalesce(own, F.when(F.length("source_name") == 2, 7).otherwise(3)).cast("long").alias("threshold"))


@catalog.add("F41_date_label", "SELECT DISTINCT strftime(ts, '%m-%d') || ' ' || ['周日', '周一', '周二', '周三', '周四', '周五', '周六'][dayofweek(ts) + 1] AS label FROM events")
def _(s, d):
    names = F.array(*[F.lit(x) for x in ("周日", "周一", "周二", "周三", "周四", "周五", "周六")])
    return read(s, d, "events").select(F.concat_ws(" ", F.date_format("ts", "MM-dd"), F.element_at(names, F.dayofweek("ts"))).alias("label")).distinct()


@catalog.add("F42_intro", """SELECT doc_id, CASE WHEN length(t) < 40 THEN '' WHEN length(t) <= 180 THEN t WHEN regexp_extract(t, '(?s)^(.{39,179}[。！？])', 1) <> '' THEN regexp_extract(t, '(?s)^(.{39,179}[。！？])', 1) ELSE substr(t, 1, 180) END AS intro
    FROM (SELECT doc_id, regexp_replace(trim('“' || CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), '.', '。') ELSE coalesce(text, '') END || '”'), '^["“”「]+|["“”」]+$', '', 'g') AS t FROM documents)""")
def _(s, d):
    body = F.coalesce("text", F.lit(""))
    said = F.concat(F.lit("“"), F.when(F.col("doc_id") % 2 == 0, F.replace(body, F.lit("."), F.lit("。"))).otherwise(body), F.lit("”"))
    return _docs(s, d).select("doc_id", F.coalesce(text.intro(said), F.lit("")).alias("intro"))


@catalog.add("F43_first_sentence", "SELECT doc_id, substr(string_split_regex(text, '[。！.!]')[1], 1, 60) AS first FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.first_sentence(F.col("text")).alias("first"))


@catalog.add("F45_spread", A + "SELECT id, 89 - floor((id % 10) * 9 / 9.0 + 0.5)::BIGINT AS score FROM a")
def _(s, d):
    return articles(s, d).select("id", scores.spread(F.col("id") % 10, F.lit(10), F.lit(80), F.lit(89)).alias("score"))


@catalog.add("P02_windows", A + "SELECT DISTINCT source_name, CASE WHEN length(source_name) = 2 THEN greatest(168, 240) ELSE 36 END::BIGINT AS direct, CASE WHEN length(source_name) = 2 THEN 168 ELSE 36 END::BIGINT AS rescued FROM a")
def _(s, d):
    official = F.length("source_name") == 2
    direct, rescued = times.windows(official, F.when(official, 10))
    return articles(s, d).select("source_name").distinct().select("source_name", direct.cast("long").alias("direct"), rescued.cast("long").alias("rescued"))


@catalog.add("P03_freshness", "SELECT event_id FROM events WHERE event_id % 10 = 0 OR (ts <= TIMESTAMP '2024-01-21 00:00:00' AND ts >= CASE WHEN user_id < 10 THEN TIMESTAMP '2024-01-13 00:00:00' ELSE TIMESTAMP '2024-01-18 12:00:00' END)")
def _(s, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    direct, rescued = times.windows(F.col("user_id") < 10, F.lit(None))
    ts = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    return read(s, d, "events").where(times.fresh(ts, F.lit(None).cast("timestamp"), direct, rescued, now)).select("event_id")


@catalog.add("P12_half_products", A + "SELECT id, trim(takeaway) = '' OR summary LIKE '%�%' OR length(title) < 12 OR category = 'noise' AS half FROM a")
def _(s, d):
    return articles(s, d).select("id", text.any_of([F.trim("takeaway") == "", F.col("summary").contains("�"), F.length("title") < 12, F.col("category") == "noise"]).alias("half"))


@catalog.add("P22_shells", "SELECT doc_id, " + shell_sql("coalesce(text, '')") + " AS shell FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", text.is_shell(F.col("text")).alias("shell"))


@catalog.add("P25_alert_tiers", A + """, r AS (SELECT date_key, count(*) FILTER (trim(takeaway) = '' AND id % 5 = 0) AS q, count(*) FILTER (is_featured = 1 AND id % 9 = 0) AS n FROM a GROUP BY 1)
    SELECT date_key, CASE WHEN q >= 5 OR (n = 0 AND q >= 3) OR (q + n >= 10 AND q * 10 > (q + n) * 3) THEN 'batch' ELSE 'routine' END AS tier FROM r""")
def _(s, d):
    r = articles(s, d).groupBy("date_key").agg(F.count_if((F.trim("takeaway") == "") & (F.col("id") % 5 == 0)).alias("q"), F.count_if((F.col("is_featured") == 1) & (F.col("id") % 9 == 0)).alias("n"))
    q, n = F.col("q"), F.col("n")
    return r.select("date_key", F.when((q >= 5) | ((n == 0) & (q >= 3)) | ((q + n >= 10) & (q * 10 > (q + n) * 3)), "batch").otherwise("routine").alias("tier"))


@catalog.add("P27_blocked_ips", """WITH i AS (SELECT event_id, event_id % 256 AS a, event_id * 7 % 256 AS b FROM events)
    SELECT event_id, a IN (0, 10, 127, 224, 240, 255) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (168, 0)) OR (a = 198 AND b IN (18, 19)) AS blocked FROM i""")
def _(s, d):
    e = F.col("event_id")
    ip = F.concat_ws(".", (e % 256).cast("string"), (e * 7 % 256).cast("string"), F.lit("1"), F.lit("1"))
    return read(s, d, "events").select("event_id", urls.blocked_ip(ip).alias("blocked"))


@catalog.add("S31_source_pruning", A + "SELECT DISTINCT source_name FROM a WHERE category <> 'policy' AND source_name NOT LIKE 'u1%'")
def _(s, d):
    return articles(s, d).where((F.col("category") != "policy") & ~F.concat(F.lit("https://"), F.when(F.col("source_name").startswith("u1"), "qbitai.com").otherwise("x.example")).rlike(values.DOMESTIC_HOSTS)).select("source_name").distinct()


@catalog.add("S32_fetch_gate", A + "SELECT source_name FROM a GROUP BY 1 HAVING (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(collected_at))) / 3.6e9 >= 6")
def _(s, d):
    last = articles(s, d).groupBy("source_name").agg(F.max("collected_at").alias("at"))
    return last.where(times.hours_between(F.lit("2024-01-31 00:00:00").cast("timestamp"), F.col("at")) >= 6).select("source_name")


@catalog.add("S01_feeds", A + "SELECT source_name, '2024-01-15T02:00:00.000Z' AS published_at, count(*) AS n FROM a GROUP BY 1")
def _(s, d):
    item = F.concat(F.lit("<item><title>"), "source_name", F.lit(" news</title><link>"), "source_url", F.lit("</link><pubDate>Mon, 15 Jan 2024 10:00:00 +0800</pubDate></item>"))
    rows = articles(s, d).withColumn("source_url", F.regexp_replace("source_url", r"\?.*", ""))
    # a feed per source and range of ids, so that a body stays small however many items a source has
    feeds = rows.groupBy("source_name", F.floor(F.col("id") / 2000)).agg(F.array_join(F.collect_list(item), "").alias("items"))
    fetched = feeds.select(F.lit("feed").alias("scraper"), F.col("source_name").alias("name"), F.lit("https://x.example/").alias("url"), F.lit("company").alias("category"), F.lit("en").alias("language"), F.lit("media").alias("source_type"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("body"), F.lit("2024-01-20 00:00:00").alias("now"))
    return parse.parse_pages(fetched).groupBy("source_name", "published_at").agg(F.count("*").alias("n"))


@catalog.add("F14_charsets", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'utf-8' END AS encoding, CASE WHEN text IS NOT NULL THEN true END AS same FROM documents")
def _(s, d):
    rows = _docs(s, d).select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.when(F.col("doc_id") % 2 == 0, "utf8").alias("declared"), "text")
    out = parse.decode_column(rows.select("doc_id", "raw", "declared", F.col("text").alias("was")), "raw", "declared")
    return out.select("doc_id", "encoding", (F.col("text") == F.col("was")).alias("same"))
