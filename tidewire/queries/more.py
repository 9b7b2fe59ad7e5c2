"""Further queries: dates in pages, subjects, health texts, checkpoints, patches, client state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire import values
from tidewire.functions import scores, text, times, urls
from tidewire.operators import dedup, store
from tidewire.plans.adapters import ARTICLES, HEALTH, articles, health, read
from tidewire.queries import Catalog
from tidewire.queries.scalars import MATERIAL_SQL, material

catalog = Catalog()
A = f"WITH {ARTICLES} "
H = f"WITH {ARTICLES}, {HEALTH} "
DAY = "o_orderdate + INTERVAL 25 YEAR"


def _dated(s, d):
    return read(s, d, "orders").withColumn("day", F.col("o_orderdate") + F.expr("INTERVAL 25 YEAR"))


@catalog.add("F10_date_from_html", f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN '' ELSE strftime({DAY}, '%Y-%m-%d') END AS day FROM orders")
def _(s, d):
    iso, kind = F.date_format("day", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    html = (
        F.when(kind == 0, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('T08:00:00Z">')))
        .when(kind == 1, F.concat(F.lit('{"datePublished": "'), iso, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('<time class="x" datetime="'), iso, F.lit('">')))
        .when(kind == 3, F.concat(F.lit("发布 "), F.date_format("day", "yyyy 年 M 月 d"), F.lit(" 日")))
        .when(kind == 4, F.concat(F.lit("<p>on "), iso, F.lit("</p>")))
        .otherwise("<p>no date</p>")
    )
    return _dated(s, d).select("o_orderkey", F.coalesce(F.date_format(times.published_from_html(html), "yyyy-MM-dd"), F.lit("")).alias("day"))


@catalog.add("F11_resolved_date", f"SELECT o_orderkey, strftime({DAY}, '%Y-%m-%d') AS day FROM orders")
def _(s, d):
    iso, odd = F.date_format("day", "yyyy-MM-dd"), F.col("o_orderkey") % 2 == 1
    url = F.when(odd, F.concat(F.lit("https://x/"), F.date_format("day", "yyyy/MM/dd"), F.lit("/n"))).otherwise("https://x/n")
    html = F.concat(F.lit('<time datetime="'), iso, F.lit('">'))
    return _dated(s, d).select("o_orderkey", F.coalesce(F.substring(urls.published_from_url(url), 1, 10), F.date_format(times.published_from_html(html), "yyyy-MM-dd")).alias("day"))


@catalog.add("F13_rfc_dates", f"SELECT o_orderkey, strftime({DAY} + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS at FROM orders")
def _(s, d):
    rfc = F.concat(F.date_format("day", "EEE, "), F.date_format("day", "dd MMM yyyy"), F.lit(" 10:00:00 +0800"))
    return _dated(s, d).select("o_orderkey", F.date_format(times.loose_timestamp(rfc), "yyyy-MM-dd HH:mm").alias("at"))


def _subjects_sql(x: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){'|'.join(patterns)}') THEN '{name}' END" for name, patterns in values.SUBJECTS.items())
    return f"list_filter([{found}], lambda v: v IS NOT NULL)"


#: Two headlines of each document: its first line, with some names and numbers behind it.
_PAIR = "SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] || CASE doc_id % 5 WHEN 0 THEN ' OpenAI v2' WHEN 1 THEN ' 新闻Meta开源' WHEN 2 THEN ' 通义更新 3' ELSE '' END AS a, string_split(coalesce(text, ''), chr(10))[1] || CASE doc_id % 7 WHEN 0 THEN ' Claude v2' WHEN 1 THEN ' metadata of applesauce 4' WHEN 2 THEN ' ChatGPT' ELSE '' END AS b FROM documents"


def _pair(s, d):
    i, line = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n")[0]
    more = lambda n, words: F.when(i % n == 0, words[0]).when(i % n == 1, words[1]).when(i % n == 2, words[2]).otherwise("")
    return read(s, d, "documents").select("doc_id", F.concat(line, more(5, (" OpenAI v2", " 新闻Meta开源", " 通义更新 3"))).alias("a"), F.concat(line, more(7, (" Claude v2", " metadata of applesauce 4", " ChatGPT"))).alias("b"))


@catalog.add("F19_subjects", f"SELECT doc_id, array_to_string({_subjects_sql('a')}, ',') AS subjects FROM ({_PAIR})")
def _(s, d):
    return _pair(s, d).select("doc_id", F.array_join(text.subjects(F.col("a")), ",").alias("subjects"))


@catalog.add("D06_pair_veto", f"""SELECT doc_id, NOT (len(x) > 0 AND len(y) > 0 AND NOT list_has_any(x, y)) AND NOT (len(m) > 0 AND len(n) > 0 AND m <> n) AS stands FROM (SELECT doc_id, {_subjects_sql('a')} AS x, {_subjects_sql('b')} AS y,
    list_sort(list_distinct(regexp_extract_all(a, '[0-9]+'))) AS m, list_sort(list_distinct(regexp_extract_all(b, '[0-9]+'))) AS n FROM ({_PAIR}))""")
def _(s, d):
    return _pair(s, d).select("doc_id", text.same_story(F.col("a"), F.col("b")).alias("stands"))


@catalog.add("D06_pair_veto", "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 1 AS stands FROM documents")
def _(s, d):
    a = F.when(F.col("doc_id") % 3 == 0, "OpenAI ships a model").otherwise("A model ships")
    b = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Claude model "), F.lit("v2"))).otherwise("Claude model")
    a = F.when(F.col("doc_id") % 4 == 1, F.concat(a, F.lit(" v3"))).otherwise(a)
    return read(s, d, "documents").select("doc_id", text.same_story(a, b).alias("stands"))


@catalog.add("A06_overlap_weight", A + """, b AS (SELECT id, date_key, ai_score, list_distinct(companies) AS s, list_distinct(keywords) AS t FROM a WHERE category <> 'noise'),
    n AS (SELECT date_key, count(*) AS n FROM b GROUP BY 1), u AS (SELECT date_key, unnest(list_distinct(list_concat(s, t))) AS tag FROM b),
    f AS (SELECT date_key, tag, ln((n + 1.0) / (count(*) + 1)) + 0.3 AS idf FROM u JOIN n USING (date_key) GROUP BY date_key, tag, n),
    k AS (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY ai_score DESC, id) AS rn FROM b),
    h AS (SELECT x.id, x.date_key, unnest(list_concat(list_transform(list_intersect(x.s, y.s), lambda v: {'tag': v, 'w': 1}), list_transform(list_intersect(x.t, y.t), lambda v: {'tag': v, 'w': 2}))) AS e FROM b x JOIN k y ON y.date_key = x.date_key AND y.rn = 1 WHERE x.id <> y.id)
    SELECT id, round(sum(e.w * idf), 5) AS weight FROM h JOIN f ON f.date_key = h.date_key AND f.tag = h.e.tag GROUP BY 1""")
def _(s, d):
    b = articles(s, d).where("category <> 'noise'").select("id", "date_key", "ai_score", F.array_distinct("companies").alias("s"), F.array_distinct("keywords").alias("t"))
    days = b.groupBy("date_key").agg(F.count("*").alias("n"), F.max_by(F.struct("id", "s", "t"), F.struct("ai_score", -F.col("id"))).alias("best"))  # a row a day
    used = b.select("date_key", F.explode(F.array_union("s", "t")).alias("tag")).groupBy("date_key", "tag").agg(F.count("*").alias("df"))
    idf = used.join(days.select("date_key", "n"), "date_key").select("date_key", "tag", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 0.3).alias("idf"))
    weigh = lambda own, w: F.transform(F.array_intersect(own, f"best.{own}"), lambda v: F.struct(v.alias("tag"), F.lit(w).alias("w")))
    hits = b.join(days.drop("n"), "date_key").where(F.col("id") != F.col("best.id")).select("id", "date_key", F.explode(F.concat(weigh("s", 1), weigh("t", 2))).alias("e")).select("id", "date_key", "e.*")
    return hits.join(idf, ["date_key", "tag"]).groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("idf")), 5).alias("weight"))


@catalog.add("A17_archive_stats", "SELECT count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages")
def _(s, d):
    return read(s, d, "pages").agg(F.count("*").alias("files"), F.sum(F.length("html")).alias("chars"))


@catalog.add("F25_material_level", A + "SELECT id, CASE WHEN id % 3 = 0 THEN 'summary' WHEN id % 3 = 1 THEN 'full' ELSE 'unknown' END AS level FROM a")
def _(s, d):
    i = F.col("id")
    detail = F.when(i % 3 == 0, '{"material_level": "summary"}').when(i % 3 == 1, '{"tier": 2}').otherwise("broken {")
    ok = F.try_parse_json(detail).isNotNull()
    return articles(s, d).select("id", F.when(~ok, "unknown").otherwise(F.coalesce(F.get_json_object(detail, "$.material_level"), F.lit("full"))).alias("level"))


@catalog.add("F31_material_gate", "SELECT doc_id, CASE WHEN m = 'content' THEN 'featured' WHEN m = 'snippet' THEN 'summary' ELSE 'demoted' END AS state FROM (" + MATERIAL_SQL + ")")
def _(s, d):
    return material(s, d).select("doc_id", F.when(F.col("m") == "content", "featured").when(F.col("m") == "snippet", "summary").otherwise("demoted").alias("state"))


@catalog.add("F37_archive_key", "SELECT page_id, substr(sha1(url), 1, 16) AS key FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", urls.archive_key(F.col("url")).alias("key"))


@catalog.add("F40_labels", A + "SELECT id, CASE WHEN ai_score >= 90 THEN '重磅' WHEN ai_score >= 80 THEN '重要' WHEN ai_score >= 70 THEN '值得看' WHEN ai_score >= 60 THEN '可看' ELSE '边缘' END AS band, strftime(collected_at + INTERVAL 8 HOUR, '%m-%d %H:%M') AS at FROM a")
def _(s, d):
    return articles(s, d).select("id", scores.band(F.col("ai_score")).alias("band"), F.date_format(F.col("collected_at") + F.expr("INTERVAL 8 HOURS"), "MM-dd HH:mm").alias("at"))


@catalog.add("P13_clean_for_reprocess", A + "SELECT id FROM a WHERE trim(takeaway) <> '' AND summary NOT LIKE '%�%' AND length(title) > 10")
def _(s, d):
    return articles(s, d).where((F.trim("takeaway") != "") & ~F.col("summary").contains("�") & (F.length("title") > 10)).select("id")


@catalog.add("J07_source_alerts", H + ", q AS (SELECT source_name, count(*) FILTER (fetched = 0) AS z FROM h WHERE date_key >= '2024-01-25' GROUP BY 1) SELECT source_name, z AS zero_days FROM q WHERE z >= 5")
def _(s, d):
    sources = articles(s, d).select("source_name").distinct()
    z = health(s, d).where("date_key >= '2024-01-25'").groupBy("source_name").agg(F.count_if(F.col("fetched") == 0).alias("zero_days"))
    return sources.join(z, "source_name", "left").where("zero_days >= 5")


@catalog.add("D05_group_merge", A + ", g AS (SELECT *, id // 4 AS grp FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ai_score DESC, id) AS rn, CAST(sum(merged_count) OVER (PARTITION BY grp) AS BIGINT) + count(*) OVER (PARTITION BY grp) - 1 AS merged FROM g) SELECT id, merged FROM r WHERE rn = 1")
def _(s, d):
    g = articles(s, d).withColumn("grp", F.floor(F.col("id") / 4))
    return g.groupBy("grp").agg(F.max_by("id", F.struct("ai_score", -F.col("id"))).alias("id"), (F.sum("merged_count") + F.count("*") - 1).alias("merged")).select("id", "merged")


@catalog.add("D11_distinct_titles", A + ", t AS (SELECT title, min(id) AS ord FROM a WHERE date_key >= '2024-01-25' GROUP BY 1) SELECT title, ord FROM t")
def _(s, d):
    return articles(s, d).where("date_key >= '2024-01-25'").groupBy("title").agg(F.min("id").alias("ord"))


@catalog.add("D13_favorites", "SELECT user_id, event_id % 50 AS item FROM events WHERE event_type = 'click' EXCEPT SELECT user_id, event_id % 50 FROM events WHERE event_type = 'error'")
def _(s, d):
    e = read(s, d, "events").withColumn("item", F.col("event_id") % 50)
    added = e.where("event_type = 'click'").select("user_id", "item").distinct()
    return added.join(e.where("event_type = 'error'").select("user_id", "item"), ["user_id", "item"], "left_anti")


@catalog.add("D14_explicit_merges", A + ", m AS (SELECT id AS keep, id + 1 AS gone FROM a WHERE id % 100 = 0 AND id < 9999) SELECT id, merged_count + coalesce((SELECT 1 FROM m WHERE keep = a.id), 0) AS merged_count FROM a WHERE id NOT IN (SELECT gone FROM m)")
def _(s, d):
    a = articles(s, d).select("id", "merged_count")
    pairs = a.where("id % 100 = 0 and id < 9999").select(F.col("id").alias("keep"), (F.col("id") + 1).alias("gone"))
    bumped = store.bump(a, pairs.select(F.col("keep").alias("id"), F.lit(1).alias("delta")), "id", "merged_count")
    return store.delete_keys(bumped, pairs.select(F.col("gone").alias("id")), "id")


@catalog.add("D16_changed_tags", A + "SELECT id FROM a WHERE list_contains(companies, 'c1') OR list_contains(companies, 'c2')")
def _(s, d):
    aliases = F.create_map(*[F.lit(x) for x in ("c1", "C-ONE", "c2", "C-TWO")])
    after = F.transform("companies", lambda c: F.coalesce(F.try_element_at(aliases, c), c))
    return articles(s, d).where(F.col("companies") != after).select("id")


@catalog.add("D17_rescore", A + "SELECT id, CASE WHEN id % 3 = 0 THEN least(ai_score, 72) ELSE ai_score END AS ai_score FROM a WHERE date_key IN ('2024-01-10', '2024-01-11')")
def _(s, d):
    return articles(s, d).where(F.col("date_key").isin("2024-01-10", "2024-01-11")).select("id", scores.capped(F.col("ai_score"), F.col("id") % 3 == 0, F.lit(False), F.lit(False)).alias("ai_score"))


@catalog.add("K09_reprocess_update", A + "SELECT id, CASE WHEN id % 6 = 0 THEN 'new title' ELSE title END AS title, CASE WHEN id % 6 = 0 THEN 99 ELSE ai_score END AS ai_score FROM a")
def _(s, d):
    a = articles(s, d).select("id", "title", "ai_score")
    return store.patch(a, a.where("id % 6 = 0").select("id", F.lit("new title").alias("title"), F.lit(99).cast("long").alias("ai_score")), "id", ["title", "ai_score"])


@catalog.add("K11_bulk_copy", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM orders")
def _(s, d):
    o = read(s, d, "orders").select("o_orderkey")
    copied = store.insert_or_ignore(o.where("o_orderkey % 3 = 0"), o, "o_orderkey", "o_orderkey")
    return copied.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys"))


@catalog.add("K14_archive_merge", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM pages")
def _(s, d):
    p = read(s, d, "pages").select("page_id")
    old, new = p.withColumn("version", F.lit(1).cast("long")), p.where("page_id % 5 = 0").withColumn("version", F.lit(2).cast("long"))
    return old.join(new, "page_id", "left_anti").unionByName(new)


@catalog.add("K18_json_rows", A + """SELECT id, '{"id":' || id || ',"date_key":"' || date_key || '","ai_score":' || ai_score || '}' AS body FROM a""")
def _(s, d):
    return articles(s, d).select("id", F.to_json(F.struct("id", "date_key", "ai_score")).alias("body"))


@catalog.add("S27_checkpoint_scan", "SELECT user_id AS id, max(event_id) AS seq FROM events WHERE event_id % 9 <> 0 AND event_type <> 'error' GROUP BY 1")
def _(s, d):
    e = read(s, d, "events")
    line = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "x").alias("error"))))
    rows = e.select(F.from_json(line, "id long, seq long, error string").alias("r")).select("r.*").where("id is not null and error is null")
    return rows.groupBy("id").agg(F.max("seq").alias("seq"))


@catalog.add("S28_failure_log", "SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    line = F.concat(F.lit("[fail] user="), F.col("user_id").cast("string"), F.lit(" seq="), F.col("event_id").cast("string"))
    log = read(s, d, "events").select(F.when(F.col("event_type") == "error", line).otherwise("ok").alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\[fail\] user=(\d+) seq=(\d+)$", i)
    return log.where(part(1) != "").groupBy(part(1).cast("long").alias("user_id")).agg(F.max(part(2).cast("long")).alias("last"))


@catalog.add("S30_probe_items", A + "SELECT id, title FROM a")
def _(s, d):
    xml = F.concat(F.lit("<item><title><![CDATA["), "title", F.lit("]]></title><link>"), F.col("id").cast("string"), F.lit("</link></item>"))
    rows = articles(s, d).select(xml.alias("x"))
    return rows.select(F.regexp_extract("x", r"<link>(\d+)</link>", 1).cast("long").alias("id"), F.regexp_extract("x", r"<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>", 1).alias("title"))


@catalog.add("T09_cool_down", "WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE event_type = 'signup'), f AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 3 DAY) FROM f WHERE (SELECT min(e.ts) FROM e WHERE e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 3 DAY) IS NOT NULL) SELECT user_id, count(*) AS fired FROM f GROUP BY 1")
def _(s, d):
    # a running state per user: the last instant that fired, and how often; times of one user and type are few
    hits = read(s, d, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.unix_micros(F.col("ts").cast("timestamp")))).alias("at"))
    gap = 3 * 86_400_000_000
    state = F.named_struct(F.lit("last"), F.lit(-(10**18)), F.lit("n"), F.lit(0).cast("long"))
    step = lambda st, t: F.when(t - st["last"] >= gap, F.named_struct(F.lit("last"), t, F.lit("n"), st["n"] + 1)).otherwise(st)
    return hits.select("user_id", F.aggregate("at", state, step)["n"].alias("fired"))


@catalog.add("W10_keepers", """WITH b AS (SELECT DISTINCT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS late, row_number() OVER (PARTITION BY series, date_trunc('month', day) ORDER BY day) AS first FROM b)
    SELECT series, CAST(day AS VARCHAR) AS day FROM r WHERE late <= 14 OR first = 1""")
def _(s, d):
    backups = read(s, d, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).distinct()
    return store.backup_keepers(backups, series=["series"]).select("series", F.col("day").cast("string").alias("day"))


@catalog.add("J06_sources_with_health", H + ", q AS (SELECT source_name, CAST(sum(fetched) AS BIGINT) AS fetched FROM h GROUP BY 1), s2 AS (SELECT source_name FROM s UNION ALL SELECT 'u-none') SELECT source_name, coalesce(fetched, 0) AS fetched FROM s2 LEFT JOIN q USING (source_name)")
def _(s, d):
    h = health(s, d)
    sources = h.select("source_name").distinct().union(s.range(1).select(F.lit("u-none")))
    return sources.join(h.groupBy("source_name").agg(F.sum("fetched").alias("fetched")), "source_name", "left").fillna(0, ["fetched"])


@catalog.add("D02_first_url_of_hash", "SELECT substr(sha1(url), 1, 2) AS shard, min(page_id) AS page_id FROM pages GROUP BY 1")
def _(s, d):
    p = read(s, d, "pages").withColumn("shard", F.substring(F.sha1("url"), 1, 2))
    return dedup.first_by(p, "shard", "page_id").select("shard", "page_id")
