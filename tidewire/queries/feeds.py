"""Read-side queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import feeds
from tidewire.plans.adapters import ARTICLES, HEALTH, TODAY, articles, health
from tidewire.queries import Catalog

catalog = Catalog()
A = f"WITH {ARTICLES} "
H = f"WITH {ARTICLES}, {HEALTH} "
SHOWN = "category <> 'noise'"
CLEAN = "trim(takeaway) <> '' AND summary NOT LIKE '%�%' AND title NOT LIKE '%�%'"
GATE = f"(is_featured = 1 OR ai_score >= 65 OR (ai_score >= 60 AND (category = 'policy' OR source_name IN ('u3', 'u7')))) AND {CLEAN}"


@catalog.add("A01_count", A + f"SELECT count(*) AS total FROM a WHERE {SHOWN}")
def _(s, d):
    return articles(s, d).where(feeds.not_noise()).agg(F.count("*").alias("total"))


@catalog.add("A02_day_index", A + "SELECT date_key, count(*) AS total, CAST(sum(is_featured) AS BIGINT) AS featured FROM a GROUP BY 1")
def _(s, d):
    return articles(s, d).groupBy("date_key").agg(F.count("*").alias("total"), F.sum("is_featured").alias("featured"))


@catalog.add("A03_day_counts", A + f"SELECT count(*) AS total, coalesce(CAST(sum(CASE WHEN is_featured = 1 THEN 1 ELSE 0 END) AS BIGINT), 0) AS featured FROM a WHERE date_key = '2024-01-10' AND {SHOWN}")
def _(s, d):
    return articles(s, d).where((F.col("date_key") == "2024-01-10") & feeds.not_noise()).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("is_featured") == 1, 1).otherwise(0)), F.lit(0)).alias("featured"))


@catalog.add(
    "A04_tag_facets",
    A + f""", t AS (SELECT id, 'companies' AS facet, unnest(list_distinct(companies)) AS name FROM a WHERE {SHOWN}
    UNION ALL SELECT id, 'keywords', unnest(list_distinct(keywords)) FROM a WHERE {SHOWN}
    UNION ALL SELECT id, 'regions', unnest(list_distinct(regions)) FROM a WHERE category = 'policy'),
    c AS (SELECT facet, name, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, name) AS rn FROM c)
    SELECT facet, name, n FROM r WHERE facet <> 'keywords' OR rn <= 30""",
)
def _(s, d):
    return feeds.tag_facets(articles(s, d))


@catalog.add("A05_tag_idf", A + f""", t AS (SELECT id, unnest(list_distinct(list_concat(companies, keywords))) AS tag FROM a WHERE {SHOWN})
    SELECT tag, count(*) AS df, round(ln(((SELECT count(*) FROM a WHERE {SHOWN}) + 1.0) / (count(*) + 1)) + 0.3, 6) AS idf FROM t GROUP BY 1""")
def _(s, d):
    rows = articles(s, d).where(feeds.not_noise())
    total = rows.agg(F.count("*").alias("total"))
    df = rows.select(F.explode(F.array_distinct(F.concat("companies", "keywords"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("tag", "df", F.round(F.log((F.col("total") + 1) / (F.col("df") + 1)) + 0.3, 6).alias("idf"))  # one row


@catalog.add("A07_min_featured", A + "SELECT date_key, min(CASE WHEN is_featured = 1 THEN ai_score END) AS least FROM a GROUP BY 1")
def _(s, d):
    return articles(s, d).groupBy("date_key").agg(F.min(F.when(F.col("is_featured") == 1, F.col("ai_score"))).alias("least"))


@catalog.add("A08_day_distribution", A + "SELECT strftime(collected_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM a GROUP BY 1")
def _(s, d):
    from tidewire.functions.times import day_key

    return articles(s, d).groupBy(day_key(F.col("collected_at")).alias("day")).agg(F.count("*").alias("n"))


@catalog.add("A09_band_histogram", A + "SELECT CASE WHEN ai_score >= 90 THEN '重磅' WHEN ai_score >= 80 THEN '重要' WHEN ai_score >= 70 THEN '值得看' WHEN ai_score >= 60 THEN '可看' ELSE '边缘' END AS band, count(*) AS n FROM a GROUP BY 1")
def _(s, d):
    from tidewire.functions.scores import band

    return articles(s, d).groupBy(band(F.col("ai_score")).alias("band")).agg(F.count("*").alias("n"))


@catalog.add("A10_score_collapse", A + """, c AS (SELECT date_key, ai_score, count(*) AS n, min(id) AS first FROM a GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY n DESC, first) AS rn, CAST(sum(n) OVER (PARTITION BY date_key) AS BIGINT) AS total FROM c)
    SELECT date_key, ai_score AS mode, n, (total >= 6 AND n >= 5 AND n * 3 >= total) AS collapsed FROM r WHERE rn = 1""")
def _(s, d):
    c = articles(s, d).groupBy("date_key", "ai_score").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = c.groupBy("date_key").agg(F.max_by(F.struct("ai_score", "n"), F.struct("n", -F.col("first"))).alias("top"), F.sum("n").alias("total"))
    n = F.col("top.n")
    return out.select("date_key", F.col("top.ai_score").alias("mode"), n.alias("n"), ((F.col("total") >= 6) & (n >= 5) & (n * 3 >= F.col("total"))).alias("collapsed"))


@catalog.add("A11_days_to_refine", A + "SELECT date_key FROM a GROUP BY 1 HAVING sum(CASE WHEN summary LIKE '%�%' THEN 1 ELSE 0 END) > 20")
def _(s, d):
    return articles(s, d).groupBy("date_key").agg(F.sum(F.when(F.col("summary").contains("�"), 1).otherwise(0)).alias("n")).where("n > 20").select("date_key")


@catalog.add("A12_distinct_days", A + "SELECT DISTINCT date_key FROM a WHERE source_name IN ('u3', 'u7')")
def _(s, d):
    return articles(s, d).where(F.col("source_name").isin("u3", "u7")).select("date_key").distinct()


@catalog.add("A13_day_stats", A + """, l AS (SELECT date_key, ai_score, is_featured, id % 37 AS lag FROM a WHERE date_key <> 'unknown')
    SELECT date_key, count(*) AS total, CAST(sum(is_featured) AS BIGINT) AS featured, list_sort(list(lag))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_lag, max(lag) AS max_lag,
    count(*) FILTER (ai_score < 60) AS low, count(*) FILTER (lag > 30) AS late FROM l GROUP BY 1""")
def _(s, d):
    rows = articles(s, d).where("date_key <> 'unknown'").withColumn("lag", F.col("id") % 37)
    # the upper median from counts of values, so that no list of all rows is built
    counts = rows.groupBy("date_key", "lag").agg(F.count("*").alias("n"))
    run = Window.partitionBy("date_key").orderBy("lag")
    median = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("date_key"))).where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("date_key").agg(F.min("lag").alias("median_lag"))
    agg = rows.groupBy("date_key").agg(F.count("*").alias("total"), F.sum("is_featured").alias("featured"), F.max("lag").alias("max_lag"), F.count_if(F.col("ai_score") < 60).alias("low"), F.count_if(F.col("lag") > 30).alias("late"))
    return agg.join(median, "date_key")


@catalog.add("A14_confusion", A + "SELECT category AS before, CASE WHEN ai_score >= 90 THEN 'policy' ELSE category END AS after, count(*) AS n, count(*) FILTER (ai_score >= 90 AND category <> 'policy') AS changed FROM a GROUP BY 1, 2")
def _(s, d):
    after = F.when(F.col("ai_score") >= 90, "policy").otherwise(F.col("category"))
    return articles(s, d).groupBy(F.col("category").alias("before"), after.alias("after")).agg(F.count("*").alias("n"), F.count_if((F.col("ai_score") >= 90) & (F.col("category") != "policy")).alias("changed"))


@catalog.add("A15_failure_streak", H + """, o AS (SELECT source_name, fetched, row_number() OVER (PARTITION BY source_name ORDER BY date_key DESC) AS rn FROM h WHERE date_key <> (SELECT max(date_key) FROM h))
    SELECT source_name, coalesce(min(CASE WHEN fetched > 0 THEN rn END) - 1, count(*)) AS streak FROM o GROUP BY 1""")
def _(s, d):
    h = health(s, d)
    last = h.agg(F.max("date_key").alias("last"))
    done = h.join(F.broadcast(last), h.date_key != F.col("last"))  # one row: the running day is left out
    rn = F.row_number().over(Window.partitionBy("source_name").orderBy(F.col("date_key").desc()))
    return done.withColumn("rn", rn).groupBy("source_name").agg(F.coalesce(F.min(F.when(F.col("fetched") > 0, F.col("rn"))) - 1, F.count("*")).cast("long").alias("streak"))


@catalog.add("A16_same_source_merge", A + """SELECT event_norm, source_name, count(*) - 1 AS merged, CAST(sum(merged_count) AS BIGINT) AS before, string_agg(title, '|' ORDER BY id) AS titles
    FROM a WHERE date_key = '2024-01-12' GROUP BY 1, 2""")
def _(s, d):
    titles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "title"))), lambda x: x["title"]), "|")
    return articles(s, d).where("date_key = '2024-01-12'").groupBy("event_norm", "source_name").agg((F.count("*") - 1).alias("merged"), F.sum("merged_count").alias("before"), titles.alias("titles"))


@catalog.add("A18_integrity", A + "SELECT count(*) AS n, max(id) AS max_id, count(*) FILTER (trim(takeaway) = '') AS quarantined FROM a")
def _(s, d):
    return articles(s, d).agg(F.count("*").alias("n"), F.max("id").alias("max_id"), F.count_if(F.trim("takeaway") == "").alias("quarantined"))


@catalog.add("A20_summary_counters", A + "SELECT count(*) AS n, count(*) FILTER (is_featured = 1) AS featured, count(*) FILTER (date_key = 'unknown') AS undated, count(*) FILTER (category = 'noise') AS noise FROM a")
def _(s, d):
    return articles(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("is_featured") == 1).alias("featured"), F.count_if(F.col("date_key") == "unknown").alias("undated"), F.count_if(F.col("category") == "noise").alias("noise"))


@catalog.add("P06_main_gate", A + f"SELECT id, ai_score FROM a WHERE {SHOWN} AND {GATE}")
def _(s, d):
    return articles(s, d).where(feeds.not_noise() & feeds.main_gate(["u3", "u7"])).select("id", "ai_score")


@catalog.add("P07_where_builder", A + f"SELECT id FROM a WHERE {SHOWN} AND date_key = '2024-01-15' AND category = 'click' AND list_contains(companies, 'c4')")
def _(s, d):
    parts = [F.col("date_key") == "2024-01-15", F.col("category") == "click", feeds.has_tag("companies", "c4")]
    return articles(s, d).where(feeds.where_all([feeds.not_noise(), *parts])).select("id")


@catalog.add("P08_typed_tag", A + f"SELECT id, date_key FROM a WHERE {SHOWN} AND list_contains(keywords, 'k7')")
def _(s, d):
    return articles(s, d).where(feeds.not_noise() & feeds.has_tag("keywords", "k7")).select("id", "date_key")


@catalog.add("P09_like_tag", A + "SELECT id FROM a WHERE ('\"' || array_to_string(list_concat(companies, keywords, regions), '\",\"') || '\"') ILIKE '%\"C4\"%'")
def _(s, d):
    return articles(s, d).where(feeds.like_tag('%C4"')).select("id")


@catalog.add("P10_score_bands", A + "SELECT id, ai_score FROM a WHERE (ai_score >= 60 AND ai_score < 70) OR (ai_score >= 90 AND ai_score < 999)")
def _(s, d):
    return articles(s, d).where(feeds.score_bands([60, 90, 0, 200])).select("id", "ai_score")


@catalog.add("P11_category_or_featured", A + f"SELECT id, is_featured, ai_score FROM a WHERE {SHOWN} AND (category = 'view' OR is_featured = 1)")
def _(s, d):
    return articles(s, d).where(feeds.not_noise() & ((F.col("category") == "view") | (F.col("is_featured") == 1))).select("id", "is_featured", "ai_score").orderBy(F.col("is_featured").desc(), F.col("ai_score").desc())


@catalog.add("P14_bad_rows", A + "SELECT id FROM a WHERE trim(takeaway) = '' OR summary LIKE '%�%'")
def _(s, d):
    return articles(s, d).where((F.trim("takeaway") == "") | F.col("summary").contains("�")).select("id")


@catalog.add("P15_retry_queue", A + "SELECT id, merged_count AS attempts FROM a WHERE trim(takeaway) = '' AND (merged_count IS NULL OR merged_count < 3) ORDER BY collected_at, id LIMIT 50")
def _(s, d):
    return articles(s, d).where((F.trim("takeaway") == "") & (F.col("merged_count").isNull() | (F.col("merged_count") < 3))).orderBy("collected_at", "id").limit(50).select("id", F.col("merged_count").alias("attempts"))


@catalog.add("P16_unknown_rate", A + "SELECT source_name, count(*) AS n, count(*) FILTER (date_key = 'unknown') AS unknown, (count(*) >= 5 AND count(*) FILTER (date_key = 'unknown') * 5 > count(*)) AS alarm FROM a GROUP BY 1")
def _(s, d):
    unknown = F.count_if(F.col("date_key") == "unknown")
    return articles(s, d).groupBy("source_name").agg(F.count("*").alias("n"), unknown.alias("unknown"), ((F.count("*") >= 5) & (unknown * 5 > F.count("*"))).alias("alarm"))


@catalog.add("P23_new_since_round", "SELECT event_id AS id, ts >= TIMESTAMP '2024-01-20 06:00:00' AS is_new FROM events")
def _(s, d):
    from tidewire.functions.times import round_start

    return articles(s, d).select("id", (F.col("collected_at") >= round_start(F.lit("2024-01-20 11:20:00").cast("timestamp"))).alias("is_new"))


@catalog.add("P28_bad_since", A + "SELECT id FROM a WHERE collected_at >= TRY_CAST('no date' AS TIMESTAMP)")
def _(s, d):
    return articles(s, d).where("collected_at >= try_cast('no date' as timestamp)").select("id")


@catalog.add("W01_catchup", A + f""", r AS (SELECT id, date_key, ai_score, row_number() OVER (PARTITION BY date_key ORDER BY is_featured DESC, ai_score DESC, id) AS rn FROM a
    WHERE {SHOWN} AND {CLEAN} AND date_key < '{TODAY}' AND date_key >= '2024-01-28' AND collected_at >= TIMESTAMP '2024-01-25 00:00:00'),
    e AS (SELECT *, dense_rank() OVER (ORDER BY date_key DESC) AS day_rn FROM r)
    SELECT * FROM e WHERE rn <= CASE WHEN day_rn = 1 THEN 10 ELSE 3 END""")
def _(s, d):
    return feeds.catch_up(articles(s, d), "2024-01-25", TODAY)


@catalog.add("W02_source_health", H + """, z AS (SELECT *, sum(CASE WHEN fetched > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_name ORDER BY date_key DESC) AS alive FROM h),
    q AS (SELECT source_name, count(*) FILTER (alive = 0) AS zero_days, max(CASE WHEN fetched > 0 THEN date_key END) AS last_active, max(date_key) AS latest_date, arg_max(fetched, date_key) AS latest_fetched FROM z GROUP BY 1),
    c AS (SELECT DISTINCT source_name, 3 AS threshold FROM a UNION ALL SELECT 'u-none', 3)
    SELECT c.source_name, coalesce(zero_days, 0) AS zero_days, last_active, latest_date, coalesce(latest_fetched, 0) AS latest_fetched,
    CASE WHEN latest_date IS NULL THEN 'no_data' WHEN coalesce(zero_days, 0) >= threshold THEN 'alert' ELSE 'ok' END AS status FROM c LEFT JOIN q USING (source_name)""")
def _(s, d):
    a = articles(s, d)
    sources = a.select("source_name").distinct().union(s.range(1).select(F.lit("u-none"))).withColumn("threshold", F.lit(3))
    return feeds.health_report(health(s, d), sources).drop("threshold").fillna(0, ["latest_fetched"])


@catalog.add("W08_related", A + f""", b AS (SELECT id, date_diff('day', DATE '1970-01-01', date_key::DATE) AS day, event_norm AS event, list_distinct(companies) AS subj, list_distinct(keywords) AS topic FROM a WHERE {SHOWN} AND date_key <> 'unknown'),
    days AS (SELECT DISTINCT day FROM b), tot AS (SELECT d.day, count(b.id) + 1 AS total FROM days d LEFT JOIN b ON b.day < d.day AND b.day >= d.day - 30 GROUP BY 1),
    e AS (SELECT id, day, unnest(list_distinct(list_concat(subj, topic))) AS tag FROM b), u AS (SELECT tag, day, count(*) AS n FROM e GROUP BY 1, 2),
    f AS (SELECT x.tag, x.day, ln(total / (coalesce(sum(y.n), 0) + 1.0)) + 0.3 AS idf FROM u x JOIN tot ON tot.day = x.day LEFT JOIN u y ON y.tag = x.tag AND y.day < x.day AND y.day >= x.day - 30 GROUP BY x.tag, x.day, total),
    t AS (SELECT id, day, unnest(subj) AS tag, 1 AS w FROM b UNION ALL SELECT id, day, unnest(topic), 2 FROM b),
    h AS (SELECT l.id, r.id AS other, sum(l.w * idf) AS weight, count(*) FILTER (l.w = 1) AS subjects, count(*) FILTER (l.w = 2) AS topics FROM t l JOIN t r ON l.tag = r.tag AND l.w = r.w AND r.day < l.day AND r.day >= l.day - 30 JOIN f ON f.tag = l.tag AND f.day = l.day GROUP BY 1, 2),
    p AS (SELECT id, other, weight, subjects, topics FROM h UNION ALL SELECT l.id, r.id, 0, 0, 0 FROM b l JOIN b r ON l.event = r.event AND r.day < l.day AND r.day >= l.day - 30 WHERE l.event <> ''),
    q AS (SELECT id, other, round(sum(weight), 6) AS weight, sum(subjects) AS subjects, sum(topics) AS topics FROM p GROUP BY 1, 2),
    k AS (SELECT q.*, CASE WHEN x.event = y.event AND x.event <> '' THEN 0 WHEN subjects >= 1 AND topics >= 1 THEN 1 WHEN topics >= 2 THEN 2 END AS kind, y.day AS other_day FROM q JOIN b x ON x.id = q.id JOIN b y ON y.id = q.other),
    r AS (SELECT id, other, kind, row_number() OVER (PARTITION BY id ORDER BY kind, weight DESC, other_day DESC, other) AS rn FROM k WHERE kind IS NOT NULL)
    SELECT id, other, kind::BIGINT AS kind, rn FROM r WHERE rn <= 3""")
def _(s, d):
    return feeds.related(articles(s, d))


@catalog.add("W09_latest_health", H + "SELECT source_name, max(date_key) AS date_key, arg_max(fetched, date_key) AS fetched FROM h GROUP BY 1")
def _(s, d):
    return health(s, d).groupBy("source_name").agg(F.max("date_key").alias("date_key"), F.max_by("fetched", "date_key").alias("fetched"))


@catalog.add("L01_page", A + f"SELECT id, date_key, category, ai_score, (SELECT count(*) FROM a WHERE {SHOWN} AND {GATE}) AS total FROM a WHERE {SHOWN} AND {GATE} ORDER BY date_key DESC, ai_score DESC, id LIMIT 20 OFFSET 20")
def _(s, d):
    return feeds.page(articles(s, d), [feeds.main_gate(["u3", "u7"])], 2, 20)


@catalog.add("L02_featured", A + f"SELECT id, ai_score FROM a WHERE {SHOWN} AND is_featured = 1 AND date_key = '2024-01-15'")
def _(s, d):
    return articles(s, d).where(feeds.not_noise() & (F.col("is_featured") == 1) & (F.col("date_key") == "2024-01-15")).orderBy(F.col("ai_score").desc(), "id").select("id", "ai_score")


@catalog.add("L03_archive", A + f"""SELECT id, date_key, ai_score - date_diff('day', TRY_CAST(date_key AS DATE), DATE '{TODAY}') * 0.5::DOUBLE AS decayed FROM a
    WHERE {SHOWN} AND {GATE.replace(" OR source_name IN ('u3', 'u7')", "")} AND date_key < '{TODAY}' AND date_key >= '2024-01-01' ORDER BY decayed DESC, date_key DESC, id LIMIT 10""")
def _(s, d):
    return feeds.archive(articles(s, d), TODAY)


@catalog.add("L04_recent_titles", A + f"SELECT title, date_key FROM a WHERE {SHOWN} AND date_key >= '2024-01-28' AND date_key <> 'unknown' ORDER BY date_key DESC, id DESC LIMIT 200")
def _(s, d):
    return articles(s, d).where(feeds.not_noise() & (F.col("date_key") >= "2024-01-28") & (F.col("date_key") != "unknown")).orderBy(F.col("date_key").desc(), F.col("id").desc()).limit(200).select("title", "date_key")


@catalog.add("L05_recent_events", A + f"SELECT id, event_norm FROM a WHERE {SHOWN} AND date_key >= '2024-01-28' ORDER BY date_key DESC, ai_score DESC, id LIMIT 120")
def _(s, d):
    return articles(s, d).where(feeds.not_noise() & (F.col("date_key") >= "2024-01-28")).orderBy(F.col("date_key").desc(), F.col("ai_score").desc(), "id").limit(120).select("id", "event_norm")


@catalog.add("L06_day_articles", A + "SELECT id, ai_score FROM a WHERE date_key = '2024-01-15'")
def _(s, d):
    return articles(s, d).where("date_key = '2024-01-15'").orderBy("ai_score", "id").select("id", "ai_score")


@catalog.add("L07_health_history", H + "SELECT source_name, date_key, fetched FROM h WHERE date_key >= '2024-01-17'")
def _(s, d):
    return health(s, d).where("date_key >= '2024-01-17'").orderBy(F.col("date_key").desc(), "source_name")


@catalog.add("L08_alerts_first", H + """, q AS (SELECT source_name, CAST(sum(fetched) AS BIGINT) AS n FROM h WHERE date_key >= '2024-01-24' GROUP BY 1)
    SELECT source_name, n < 12 AS is_alert, row_number() OVER (ORDER BY n < 12 DESC, source_name) AS place FROM q""")
def _(s, d):
    g = health(s, d).where("date_key >= '2024-01-24'").groupBy("source_name").agg(F.sum("fetched").alias("n")).withColumn("is_alert", F.col("n") < 12)
    return g.select("source_name", "is_alert", F.row_number().over(Window.orderBy(F.col("is_alert").desc(), "source_name")).cast("long").alias("place"))  # a row a source


@catalog.add("L09_follow_feed", A + f""", w AS (SELECT * FROM (VALUES (0, 'c3'), (1, 'k7'), (2, 'd5')) v(ord, tag)),
    h AS (SELECT a.id, date_key, ai_score, w.ord, row_number() OVER (PARTITION BY w.ord ORDER BY date_key DESC, ai_score DESC, a.id) AS rn FROM a JOIN w ON list_contains(list_concat(companies, keywords), w.tag) WHERE {SHOWN})
    SELECT id, date_key, ai_score, CAST(min(ord) AS BIGINT) AS ord FROM h WHERE rn <= 10 GROUP BY 1, 2, 3 ORDER BY date_key DESC, ai_score DESC, id LIMIT 30""")
def _(s, d):
    return feeds.follow_feed(articles(s, d), ["c3", "k7", "d5"])


@catalog.add("L10_tag_bar", A + f", t AS (SELECT unnest(list_distinct(keywords)) AS name FROM a WHERE {SHOWN}) SELECT name, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def _(s, d):
    return feeds.tag_facets(articles(s, d)).where("facet = 'keywords'").orderBy(F.col("n").desc(), "name").limit(10).select("name", "n")


@catalog.add("L11_days_with_labels", A + f"""SELECT date_key, count(*) AS n, CASE date_diff('day', TRY_CAST(date_key AS DATE), DATE '2024-01-30') WHEN 0 THEN '今天' WHEN 1 THEN '昨天' ELSE date_key END AS label FROM a WHERE {SHOWN} GROUP BY 1""")
def _(s, d):
    gap = F.date_diff(F.lit("2024-01-30").cast("date"), F.expr("try_cast(date_key as date)"))
    return articles(s, d).where(feeds.not_noise()).groupBy("date_key").agg(F.count("*").alias("n")).withColumn("label", F.when(gap == 0, "今天").when(gap == 1, "昨天").otherwise(F.col("date_key")))


@catalog.add("L12_neighbour_days", A + ", d AS (SELECT DISTINCT date_key FROM a) SELECT date_key, lag(date_key) OVER (ORDER BY date_key) AS prev, lead(date_key) OVER (ORDER BY date_key) AS next FROM d")
def _(s, d):
    return feeds.neighbours(articles(s, d).select("date_key").distinct())


@catalog.add("L13_latest_edition", A + f"SELECT coalesce(max(CASE WHEN date_key = '{TODAY}' THEN date_key END), max(CASE WHEN date_key <> 'unknown' THEN date_key END)) AS day FROM a")
def _(s, d):
    key = F.col("date_key")
    return articles(s, d).agg(F.coalesce(F.max(F.when(key == TODAY, key)), F.max(F.when(key != "unknown", key))).alias("day"))


@catalog.add("D09_degraded_fill", A + """, p AS (SELECT id, source_url, CAST(collected_at AS VARCHAR) AS published_at, CASE WHEN trim(takeaway) = '' THEN 0 ELSE 1 END AS pool FROM a WHERE date_key = '2024-01-15' AND (trim(takeaway) = '' OR summary LIKE '%�%')),
    o AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pool, published_at DESC, id) AS rn FROM p)
    SELECT id, source_url, pool FROM o WHERE rn = 1 ORDER BY published_at DESC, id LIMIT 10""")
def _(s, d):
    day = articles(s, d).where("date_key = '2024-01-15'").select("id", "source_url", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("published_at"), "takeaway", "summary")
    main = day.where("trim(takeaway) = ''").select("id", "source_url", "published_at")
    failed = day.where(F.col("summary").contains("�") & (F.trim("takeaway") != "")).select("id", "source_url", "published_at")
    return feeds.degraded_fill(main, failed, 10).drop("published_at")
