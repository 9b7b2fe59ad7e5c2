"""Queries of a collection round: dedup, joins, selection, state changes, retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import dedup, select, store
from tidewire.plans.adapters import ARTICLES, TODAY, articles, read
from tidewire.queries import Catalog

catalog = Catalog()
A = f"WITH {ARTICLES} "
NORM = "regexp_replace(regexp_replace(source_url, '\\?utm_source=x$', ''), '^https://www\\.', 'https://')"


def _norm(df):
    return df.withColumn("url_norm", urls.normalize_url(F.col("source_url")))


def _titled(df):
    return df.withColumn("title_norm", text.normalize_title(F.col("title"))).withColumn("ord", F.col("id"))


TITLE = "lower(replace(title, ' ', ''))"


@catalog.add("D01_url_dedup", A + f", r AS (SELECT id, {NORM} AS url_norm, row_number() OVER (PARTITION BY {NORM} ORDER BY id) AS rn FROM a) SELECT id, url_norm FROM r WHERE rn = 1")
def _(s, d):
    return dedup.first_by(_norm(articles(s, d)), "url_norm", "id").select("id", "url_norm")


@catalog.add("D02_title_merge", A + f""", t AS (SELECT *, CASE WHEN length({TITLE}) >= 8 THEN {TITLE} ELSE '#' || id END AS key, CASE WHEN date_key = 'unknown' THEN NULL ELSE collected_at END AS p FROM a)
    SELECT arg_min(id, (p IS NULL, coalesce(p, TIMESTAMP '1970-01-01'), id)) AS id, min(id) AS ord, CAST(count(*) - 1 + sum(merged_count) AS BIGINT) AS merged_count FROM t GROUP BY key""")
def _(s, d):
    rows = _titled(articles(s, d)).withColumn("published_ts", F.when(F.col("date_key") != "unknown", F.col("collected_at")))
    return dedup.merge_titles(rows)


@catalog.add("D03_leader_clusters")
def _(s, d):
    return dedup.leader_clusters(articles(s, d).where("is_featured = 1").select(F.col("date_key").alias("round"), "id", F.col("event_norm").alias("name"), F.col("ai_score").alias("score")))


GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substr({0}, i, 2)))"
@catalog.add("D04_similar_titles", f"""WITH t AS (SELECT doc_id AS id, source AS block, lower(substr(text, 1, 40)) AS title FROM documents WHERE length(substr(text, 1, 40)) >= 16),
    g AS (SELECT *, {GRAMS.format('title')} AS grams, list_sort(list_distinct(regexp_extract_all(title, '[0-9]+'))) AS nums FROM t),
    p AS (SELECT x.id AS a, y.id AS b, round(2.0::DOUBLE * len(list_intersect(x.grams, y.grams)) / (len(x.grams) + len(y.grams)), 6) AS dice, x.nums AS xn, y.nums AS yn FROM g x JOIN g y ON x.block = y.block AND x.id < y.id)
    SELECT a, b, dice FROM p WHERE dice >= 0.55 AND NOT (len(xn) > 0 AND len(yn) > 0 AND xn <> yn)""")
def _(s, d):
    rows = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("block"), F.lower(F.substring("text", 1, 40)).alias("title"))
    return dedup.similar_titles(rows)


@catalog.add("D07_period_verdicts", A + """, c AS (SELECT id, ai_score, CASE id % 5 WHEN 0 THEN 'same_event' WHEN 1 THEN 'followup' ELSE 'new' END AS verdict, id - 100 AS related_id FROM a WHERE id >= 5000),
    j AS (SELECT c.*, r.ai_score AS ref, CASE WHEN verdict = 'followup' AND r.id IS NOT NULL THEN least(c.ai_score, r.ai_score - 15) ELSE c.ai_score END AS n FROM c LEFT JOIN a r ON r.id = c.related_id AND r.id < 5000)
    SELECT id, n AS ai_score, CASE WHEN verdict = 'followup' AND ref IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS is_followup FROM j WHERE NOT (ref IS NOT NULL AND (verdict = 'same_event' OR (verdict = 'followup' AND n < 60)))""")
def _(s, d):
    a = articles(s, d)
    c = a.where("id >= 5000").select("id", "ai_score")
    v = c.select("id", F.when(F.col("id") % 5 == 0, "same_event").when(F.col("id") % 5 == 1, "followup").otherwise("new").alias("verdict"), (F.col("id") - 100).alias("related_id"))
    return dedup.period_verdicts(c, v, a.where("id < 5000").select("id", "ai_score"))


@catalog.add("D08_old_news", A + f""" SELECT id FROM a WHERE NOT coalesce(date_diff('day', TRY_CAST(date_key AS DATE), DATE '{TODAY}') > 3, false) AND NOT (id % 11 = 0)""")
def _(s, d):
    a = articles(s, d).select("id", "date_key")
    return dedup.drop_old(a.select("id"), a.select("id", F.col("date_key").alias("event_date"), (F.col("id") % 11 == 0).alias("in_recent_titles")), TODAY)


@catalog.add("D10_split_roundups", """WITH e AS (SELECT doc_id AS id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40)[1:6] AS p FROM documents)
    SELECT id AS ord, id, CASE WHEN len(p) >= 2 THEN u ELSE 0 END AS part, CASE WHEN len(p) >= 2 THEN substr(p[u], 1, 30) ELSE 'whole ' || id END AS title,
    'https://x.example/' || id || CASE WHEN len(p) >= 2 THEN '#ev-' || u ELSE '' END AS source_url FROM (SELECT id, p, unnest(generate_series(1, CASE WHEN len(p) >= 2 THEN len(p) ELSE 1 END)) AS u FROM e)""")
def _(s, d):
    docs = read(s, d, "documents")
    url = F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    arts = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.concat(F.lit("whole "), F.col("doc_id").cast("string")).alias("title"), url.alias("source_url"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40)
    return dedup.split_roundups(arts, docs.select(F.col("doc_id").alias("id"), F.transform(lines, lambda x: F.named_struct(F.lit("title"), F.substring(x, 1, 30), F.lit("segment"), x)).alias("events")))


@catalog.add("D12_first_tag_wins", A + " SELECT id, least(CASE WHEN list_contains(companies, 'c3') THEN 0 ELSE 9 END, CASE WHEN list_contains(keywords, 'k7') THEN 1 ELSE 9 END)::BIGINT AS tag FROM a WHERE list_contains(companies, 'c3') OR list_contains(keywords, 'k7')")
def _(s, d):
    a = articles(s, d)
    both = a.where(F.array_contains("companies", "c3")).select("id", F.lit(0).alias("tag")).union(a.where(F.array_contains("keywords", "k7")).select("id", F.lit(1).alias("tag")))
    return both.groupBy("id").agg(F.min("tag").cast("long").alias("tag"))


@catalog.add("D15_rebucket", A + """, r AS (SELECT id, ai_score, strftime(collected_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS date_key FROM a),
    m AS (SELECT *, sum(CASE WHEN ai_score >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY date_key ORDER BY id) AS seen FROM r)
    SELECT id, date_key, CASE WHEN ai_score >= 80 AND seen <= 5 THEN 1 ELSE 0 END::BIGINT AS featured FROM m""")
def _(s, d):
    from tidewire.functions.times import day_key

    rows = articles(s, d).select("id", "ai_score", day_key(F.col("collected_at")).alias("date_key"), F.col("id").alias("ord"))
    return select.mark_featured(rows, first_share=1.0).select("id", "date_key", "featured")


@catalog.add("J01_existing_urls", A + f", n AS (SELECT id, source_url, {NORM} AS url_norm FROM a) SELECT id FROM n WHERE id >= 5000 AND source_url NOT IN (SELECT source_url FROM n WHERE id < 5000)")
def _(s, d):
    n = _norm(articles(s, d)).select("id", "source_url", "url_norm")
    return dedup.drop_existing(n.where("id >= 5000"), n.where("id < 5000")).select("id")


@catalog.add("J01_existing_set", A + f", n AS (SELECT id, source_url, {NORM} AS url_norm FROM a) SELECT DISTINCT source_url, url_norm FROM n WHERE id < 5000 AND (source_url IN (SELECT source_url FROM n WHERE id >= 5000) OR url_norm IN (SELECT url_norm FROM n WHERE id >= 5000))")
def _(s, d):
    n = _norm(articles(s, d)).select("id", "source_url", "url_norm")
    return dedup.existing_urls(n.where("id >= 5000"), n.where("id < 5000").select("source_url", "url_norm"))


@catalog.add("J02_title_matches", A + f", t AS (SELECT id, date_key, category, {TITLE} AS tn FROM a) SELECT c.id, h.id AS hit FROM t c JOIN t h ON c.tn = h.tn WHERE c.id >= 9000 AND h.id < 9000 AND h.category <> 'noise' AND h.date_key >= '2024-01-21'")
def _(s, d):
    t = _titled(articles(s, d)).select("id", "date_key", "category", "title_norm")
    hits = t.where("id < 9000 and category <> 'noise' and date_key >= '2024-01-21'").select(F.col("id").alias("hit"), "title_norm")
    return t.where("id >= 9000").join(hits, "title_norm").select("id", "hit")


@catalog.add("J03_event_matches", A + " SELECT c.id, count(*) AS hits FROM a c JOIN a h ON c.event_norm = h.event_norm WHERE c.id >= 9000 AND h.id < 9000 AND h.category <> 'noise' AND h.date_key >= '2024-01-21' AND h.date_key <> 'unknown' GROUP BY 1")
def _(s, d):
    a = articles(s, d)
    counts = a.where("id < 9000 and category <> 'noise' and date_key >= '2024-01-21' and date_key <> 'unknown'").groupBy("event_norm").agg(F.count("*").alias("hits"))
    return a.where("id >= 9000").join(counts, "event_norm").select("id", "hits")


@catalog.add("J04_title_hit_merge", A + f""", t AS (SELECT id, {TITLE} AS tn, CASE WHEN date_key = 'unknown' THEN NULL ELSE collected_at END AS p FROM a),
    f AS (SELECT c.id AS c, arg_min(h.id, (h.p IS NULL, coalesce(h.p, TIMESTAMP '1970-01-01'), h.id)) AS id FROM t c JOIN t h USING (tn) WHERE c.id >= 5000 AND h.id < 5000 GROUP BY 1)
    SELECT id, count(*) AS bump FROM f GROUP BY 1""")
def _(s, d):
    t = _titled(articles(s, d)).withColumn("published_ts", F.when(F.col("date_key") != "unknown", F.col("collected_at")))
    return dedup.title_hits(t.where("id >= 5000"), t.where("id < 5000"))


@catalog.add("J08_company_veto", A + " SELECT c.id, CASE WHEN c.date_key = 'unknown' THEN NULL ELSE len(list_intersect(c.companies, r.companies)) > 0 END AS overlap FROM a c JOIN a r ON r.id = c.id - 100")
def _(s, d):
    a = articles(s, d)
    r = a.select((F.col("id") + 100).alias("id"), F.col("companies").alias("other"))
    return a.join(r, "id").select("id", F.when(F.col("date_key") != "unknown", F.arrays_overlap("companies", "other")).alias("overlap"))


@catalog.add("J09_valid_pairs", A + ", p AS (SELECT id, unnest([id % 7, id % 5 - 1, id % 3]) AS a, generate_subscripts([1, 2, 3], 1) AS pos FROM a), v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM p WHERE a BETWEEN 0 AND 5) SELECT id AS b, a FROM v WHERE rn = 1")
def _(s, d):
    pairs = articles(s, d).select("id", F.posexplode(F.array(F.col("id") % 7, F.col("id") % 5 - 1, F.col("id") % 3)).alias("pos", "a"))
    return dedup.first_by(pairs.where(F.col("a").between(0, 5)), "id", "pos").select(F.col("id").alias("b"), "a")


@catalog.add("J10_rest_without_featured", A + " SELECT id FROM a WHERE id NOT IN (SELECT id FROM a WHERE is_featured = 1)")
def _(s, d):
    a = articles(s, d)
    return a.join(a.where("is_featured = 1").select("id"), "id", "left_anti").select("id")


@catalog.add("J11_archive_without_catchup", A + " SELECT id FROM a WHERE date_key < '2024-01-28' AND category <> 'noise' AND id NOT IN (SELECT id FROM a WHERE ai_score > 70)")
def _(s, d):
    a = articles(s, d)
    return a.where("date_key < '2024-01-28' and category <> 'noise'").join(a.where("ai_score > 70").select("id"), "id", "left_anti").select("id")


@catalog.add("J12_missed_candidates", A + " SELECT id FROM a WHERE id NOT IN (SELECT id FROM a WHERE ai_score >= 60) AND collected_at >= TIMESTAMP '2024-01-28 12:00:00' ORDER BY collected_at DESC, id LIMIT 40")
def _(s, d):
    a = articles(s, d)
    return a.join(a.where("ai_score >= 60").select("id"), "id", "left_anti").where("collected_at >= timestamp '2024-01-28 12:00:00'").orderBy(F.col("collected_at").desc(), "id").limit(40).select("id")


@catalog.add("J13_archive_gap", A + " SELECT count(*) AS gap FROM (SELECT DISTINCT source_url FROM a) x WHERE length(source_url) % 3 <> 0")
def _(s, d):
    u = articles(s, d).select("source_url").distinct().withColumn("key", urls.archive_key(F.col("source_url")))
    manifest = u.where(F.length("source_url") % 3 == 0).select("key")
    return u.join(manifest, "key", "left_anti").agg(F.count("*").alias("gap"))


@catalog.add("J14_backfill_plan", A + " SELECT source_url, min(id) AS id FROM a WHERE length(source_url) % 3 <> 0 AND length(source_url) % 5 <> 0 GROUP BY 1 ORDER BY 2 LIMIT 60")
def _(s, d):
    a = articles(s, d).withColumn("key", urls.archive_key(F.col("source_url")))
    have, failed = a.where(F.length("source_url") % 3 == 0).select("key"), a.where(F.length("source_url") % 5 == 0).select("key")
    todo = a.join(have, "key", "left_anti").join(failed, "key", "left_anti")
    return dedup.first_by(todo, "key", "id").orderBy("id").limit(60).select("source_url", "id")


@catalog.add("J15_day_intro", A + ", m AS (SELECT DISTINCT date_key, 'intro ' || date_key AS intro FROM a WHERE date_key < '2024-01-15') SELECT x.date_key, m.intro FROM (SELECT DISTINCT date_key FROM a) x LEFT JOIN m USING (date_key)")
def _(s, d):
    days = articles(s, d).select("date_key").distinct()
    return days.join(days.where("date_key < '2024-01-15'").select("date_key", F.concat(F.lit("intro "), "date_key").alias("intro")), "date_key", "left")


@catalog.add("J16_not_in_store", A + f", n AS (SELECT id, {NORM} AS u FROM a) SELECT id FROM n WHERE id % 10 = 0 AND u NOT IN (SELECT u FROM n WHERE id % 10 <> 0)")
def _(s, d):
    n = _norm(articles(s, d)).select("id", "url_norm")
    return n.where("id % 10 = 0").join(n.where("id % 10 <> 0").select("url_norm"), "url_norm", "left_anti").select("id")


@catalog.add("J18_checkpoint_skip", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def _(s, d):
    return read(s, d, "orders").join(read(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


TIERED = """ r AS (SELECT date_key AS day, id, CASE WHEN ai_score >= 90 THEN 0 WHEN ai_score >= 80 THEN 1 WHEN ai_score >= 70 THEN 2 WHEN ai_score >= 60 THEN 3 ELSE 4 END AS tier, id % 50 AS rank, id AS ord FROM a),
    c0 AS (SELECT *, CASE WHEN tier = 0 AND row_number() OVER (PARTITION BY day, tier ORDER BY rank, ord) > 1 THEN 1 ELSE tier END AS t1 FROM r),
    c1 AS (SELECT *, CASE WHEN t1 = 1 AND row_number() OVER (PARTITION BY day, t1 ORDER BY rank, ord) > 3 THEN 2 ELSE t1 END AS t2 FROM c0),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY day, t2 ORDER BY rank, ord) - 1 AS i, count(*) OVER (PARTITION BY day, t2) AS k, [90, 80, 70, 60, 40][t2 + 1] AS lo, [94, 89, 79, 69, 59][t2 + 1] AS hi FROM c1)"""
@catalog.add("W03_tier_cascade", A + "," + TIERED + " SELECT day, id, t2::BIGINT AS final_tier, (CASE WHEN t2 <> tier THEN tier ELSE -1 END)::BIGINT AS demoted_from, CASE WHEN k = 1 THEN floor((lo + hi) / 2.0 + 0.5) ELSE hi - floor(i * (hi - lo)::DOUBLE / (k - 1) + 0.5) END::BIGINT AS score FROM c2")
def _(s, d):
    from tidewire.functions.scores import tier

    return select.cascade(articles(s, d).select(F.col("date_key").alias("day"), "id", tier(F.col("ai_score")).alias("tier"), (F.col("id") % 50).alias("rank"), F.col("id").alias("ord"))).fillna(-1, ["demoted_from"])


@catalog.add("W04_refine_pool", A + """, r AS (SELECT id, date_key, ai_score, id % 401 = 0 AS incident FROM a WHERE date_key <> 'unknown'),
    x AS (SELECT *, incident AND row_number() OVER (PARTITION BY incident ORDER BY ai_score DESC, id) <= 8 AS forced, row_number() OVER (PARTITION BY date_key ORDER BY ai_score DESC, id) AS dr, date_key IN ('2024-01-05') AS isfull,
      date_key IN (SELECT DISTINCT date_key FROM r WHERE date_key <> '2024-01-05' ORDER BY date_key DESC LIMIT 3) AS recent FROM r),
    y AS (SELECT *, CASE WHEN forced THEN 0 WHEN isfull AND ai_score >= 80 AND dr <= 5 THEN 1 WHEN NOT isfull AND recent AND dr <= 10 THEN 2 WHEN NOT isfull THEN 3 END AS stage FROM x),
    z AS (SELECT *, row_number() OVER (ORDER BY stage, ai_score DESC, id) AS n FROM y WHERE stage IS NOT NULL)
    SELECT id, date_key, ai_score, stage::BIGINT AS stage FROM z WHERE stage < 2 OR n <= 30""")
def _(s, d):
    return select.refine_pool(articles(s, d).where("date_key <> 'unknown'").select("id", "date_key", "ai_score", (F.col("id") % 401 == 0).alias("incident")), ["2024-01-05"])


#: Every 23rd row is stored already, the others are the round's.
QUOTA = """ st AS (SELECT * FROM a WHERE id % 23 = 0), ex AS (SELECT date_key, count(*) AS existing FROM st GROUP BY 1),
    p AS (SELECT a.id, a.date_key, a.ai_score, category, coalesce(existing, 0) AS existing, id % 401 = 0 AS suspected, category = 'policy' AND id % 2 = 0 AND ai_score >= 70 AS off FROM a LEFT JOIN ex USING (date_key) WHERE id % 23 <> 0),
    p1 AS (SELECT *, off AND row_number() OVER (PARTITION BY date_key, off ORDER BY ai_score DESC, id) <= 2 AS prot FROM p),
    p2 AS (SELECT *, suspected AND ai_score >= 56 AND NOT prot AS sus FROM p1),
    p3 AS (SELECT *, sus AND row_number() OVER (PARTITION BY date_key, sus ORDER BY ai_score DESC, id) <= 3 AS inc FROM p2),
    p4 AS (SELECT *, NOT prot AND NOT inc AS pool, greatest(0, 20 - existing) AS room, CASE WHEN existing >= 10 THEN 70 ELSE 65 END AS least FROM p3),
    p5 AS (SELECT *, row_number() OVER (PARTITION BY date_key, pool ORDER BY ai_score DESC, id) AS place FROM p4),
    p6 AS (SELECT *, pool AND ai_score >= least AND place <= room AS reg, pool AND room > 0 AND ai_score >= 56 AND ai_score < least AS spare FROM p5),
    p7 AS (SELECT *, row_number() OVER (PARTITION BY date_key, spare ORDER BY ai_score DESC, id) AS sr, least(10 - existing - sum(reg::INT) OVER (PARTITION BY date_key), 5) AS short FROM p6),
    v AS (SELECT id, date_key, ai_score, row_number() OVER (PARTITION BY date_key ORDER BY ai_score, id) AS k FROM st WHERE category <> 'policy' AND is_featured <> 1),
    c AS (SELECT p7.id, v.id AS victim, p7.date_key, p7.place, sum(CASE WHEN v.ai_score < p7.ai_score THEN 0 ELSE 1 END) OVER (PARTITION BY p7.date_key ORDER BY place) AS broken
      FROM p7 JOIN v ON v.date_key = p7.date_key AND v.k = p7.place WHERE pool AND room = 0 AND place <= 5),
    p8 AS (SELECT p7.*, c.victim, pool AND room = 0 AND ai_score >= 85 AND c.victim IS NULL AS rush FROM p7 LEFT JOIN c ON c.id = p7.id AND broken = 0),
    p9 AS (SELECT *, row_number() OVER (PARTITION BY date_key, rush ORDER BY ai_score DESC, id) AS rr FROM p8)"""


@catalog.add("W05_quota", A + "," + QUOTA + " SELECT * FROM (SELECT id, date_key, ai_score, CASE WHEN prot THEN 'policy' WHEN inc THEN 'incident' WHEN reg THEN 'regular' WHEN spare AND sr <= short THEN 'backfill' WHEN victim IS NOT NULL THEN 'replace' WHEN rush AND rr <= 2 THEN 'breaking' END AS channel, coalesce(victim, -1) AS victim FROM p9) WHERE channel IS NOT NULL")
def _(s, d):
    a = articles(s, d)
    new = a.where("id % 23 <> 0").withColumns({"source_type": F.when(F.col("id") % 2 == 0, "official").otherwise("media"), "suspected": F.col("id") % 401 == 0})
    return select.quota(new, a.where("id % 23 = 0")).fillna(-1, ["victim"])


@catalog.add("W06_policy_floor", A + """, s AS (SELECT id, date_key, category, source_url FROM a WHERE ai_score >= 95 AND id % 23 <> 0),
    h AS (SELECT date_key, count(*) AS n, count(*) FILTER (category = 'policy') AS p FROM s GROUP BY 1),
    e AS (SELECT date_key, count(*) AS existing FROM a WHERE id % 23 = 0 GROUP BY 1),
    r AS (SELECT a.id, a.date_key, a.ai_score, row_number() OVER (PARTITION BY a.date_key ORDER BY a.ai_score DESC, a.id) AS rn, least(2 - coalesce(p, 0), 20 - coalesce(existing, 0) - coalesce(n, 0)) AS need
      FROM a LEFT JOIN h USING (date_key) LEFT JOIN e USING (date_key) WHERE a.id % 23 <> 0 AND a.category = 'policy' AND a.ai_score >= 56 AND (a.date_key, a.source_url) NOT IN (SELECT date_key, source_url FROM s))
    SELECT id, date_key, ai_score FROM r WHERE rn <= need""")
def _(s, d):
    a = articles(s, d).select("id", "date_key", "ai_score", "category", "source_url")
    new = a.where("id % 23 <> 0")
    return select.policy_floor(new, new.where("ai_score >= 95"), a.where("id % 23 = 0"))


@catalog.add("W07_featured", A + """, st AS (SELECT date_key, count(*) AS c, count(*) FILTER (is_featured = 1) AS f, min(ai_score) FILTER (is_featured = 1) AS m FROM a WHERE id % 211 = 0 GROUP BY 1),
    n AS (SELECT a.id, a.date_key, ai_score, collected_at, coalesce(c, 0) AS c, coalesce(f, 0) AS f, coalesce(m, 0) AS m, id % 9 = 4 AS retro, id % 10 = 3 AS loud, count(*) OVER (PARTITION BY a.date_key) AS n FROM a LEFT JOIN st USING (date_key) WHERE id % 211 <> 0),
    e AS (SELECT *, ai_score >= 80 AND NOT retro AND NOT loud AS e FROM n),
    k AS (SELECT *, sum(e::INT) OVER (PARTITION BY date_key ORDER BY id) AS seen, greatest(0, 5 - f) AS budget FROM e),
    r AS (SELECT *, e AND seen <= CASE WHEN c > 0 THEN budget ELSE least(n, budget, greatest(1, floor(n * 0.25))) END AS feat FROM k)
    SELECT id, feat::BIGINT AS featured, (NOT feat AND c > 0 AND NOT retro AND ai_score >= 85 AND ai_score >= m AND collected_at >= TIMESTAMP '2024-01-30 12:00:00')::BIGINT AS breaking FROM r""")
def _(s, d):
    a = articles(s, d)
    stored = a.where("id % 211 = 0").groupBy("date_key").agg(F.count("*").alias("existing_count"), F.count_if(F.col("is_featured") == 1).alias("existing_featured"), F.min(F.when(F.col("is_featured") == 1, F.col("ai_score"))).alias("featured_min_score"))
    i = F.col("id")
    new = a.where("id % 211 <> 0").withColumns({"ord": i, "newsness": F.when(i % 9 == 4, "retro").otherwise("new"), "original_title": F.when(i % 10 == 3, "史上最强 model").otherwise(""), "published_at": F.col("collected_at")})
    return select.mark_featured(new, stored, now="2024-01-31 00:00:00").select("id", "featured", "breaking")


@catalog.add("J17_replacements", A + """, c AS (SELECT date_key, id, ai_score, row_number() OVER (PARTITION BY date_key ORDER BY ai_score DESC, id) AS k FROM a WHERE id % 2 = 0 AND ai_score BETWEEN 55 AND 75),
    v AS (SELECT date_key, id, ai_score, row_number() OVER (PARTITION BY date_key ORDER BY ai_score, id) AS k FROM a WHERE id % 2 = 1 AND ai_score BETWEEN 65 AND 80),
    j AS (SELECT c.date_key, k, c.id, v.id AS victim, sum(CASE WHEN v.ai_score < c.ai_score THEN 0 ELSE 1 END) OVER (PARTITION BY c.date_key ORDER BY k) AS broken FROM c JOIN v USING (date_key, k) WHERE k <= 5)
    SELECT date_key, id, victim FROM j WHERE broken = 0""")
def _(s, d):
    a = articles(s, d).select("id", "date_key", "ai_score")
    return select.replacements(a.where("id % 2 = 0 and ai_score between 55 and 75"), a.where("id % 2 = 1 and ai_score between 65 and 80"))


@catalog.add("T12_degraded_scores", A + """, f AS (SELECT id, date_key, CASE WHEN category = 'policy' THEN 65 WHEN category = 'click' THEN 58 ELSE 55 END AS score FROM a WHERE date_key <> 'unknown'),
    r AS (SELECT *, row_number() OVER (PARTITION BY date_key ORDER BY score DESC, id) AS rn FROM f) SELECT id, date_key, score::BIGINT AS score FROM r WHERE rn <= 15""")
def _(s, d):
    f = articles(s, d).where("date_key <> 'unknown'").select("id", "date_key", F.when(F.col("category") == "policy", 65).when(F.col("category") == "click", 58).otherwise(55).cast("long").alias("score"))
    return f.withColumn("rn", F.row_number().over(Window.partitionBy("date_key").orderBy(F.col("score").desc(), "id"))).where("rn <= 15").drop("rn")


@catalog.add("K02_insert_or_ignore", A + """, o AS (SELECT id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY id) AS rn FROM a WHERE id < 4000) WHERE rn = 1),
    n AS (SELECT id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY id) AS rn FROM a WHERE id >= 4000) WHERE rn = 1)
    SELECT * FROM o UNION ALL SELECT * FROM n WHERE source_url NOT IN (SELECT source_url FROM o)""")
def _(s, d):
    a = articles(s, d).select("id", "source_url")
    return store.insert_or_ignore(dedup.first_by(a.where("id < 4000"), "source_url", "id"), a.where("id >= 4000"), "source_url", "id")


@catalog.add("K03_quarantine_upsert", """WITH o AS (SELECT o_orderkey AS source_url, 'old' AS reason, o_orderkey % 4 AS attempts, o_orderdate AS quarantined_at FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey AS source_url, repeat('r', 305) AS reason, 0::BIGINT AS attempts, o_orderdate + INTERVAL 1 DAY AS quarantined_at FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(n.source_url, o.source_url) AS source_url, CASE WHEN n.source_url IS NULL THEN o.reason ELSE substr(n.reason, 1, 300) END AS reason, coalesce(o.attempts, n.attempts) AS attempts, coalesce(o.quarantined_at, n.quarantined_at) AS quarantined_at FROM o FULL JOIN n USING (source_url)""")
def _(s, d):
    o = read(s, d, "orders")
    key = F.col("o_orderkey").alias("source_url")
    old = o.where("o_orderkey % 3 <> 0").select(key, F.lit("old").alias("reason"), (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_orderdate").alias("quarantined_at"))
    new = o.where("o_orderkey % 2 = 0").select(key, F.repeat(F.lit("r"), F.lit(305)).alias("reason"), F.lit(0).cast("long").alias("attempts"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("quarantined_at"))
    return store.upsert_quarantine(old, new)


@catalog.add("K04_intro_upsert", "WITH n AS (SELECT o_custkey AS date_key, o_orderkey AS intro, o_orderdate AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS rn FROM orders) SELECT date_key, v FROM n WHERE rn = 1")
def _(s, d):
    o = read(s, d, "orders").select(F.col("o_custkey").alias("date_key"), F.col("o_orderkey").alias("intro"), F.col("o_orderdate").alias("v"))
    return store.upsert_latest(o.where("intro % 2 = 0"), o.where("intro % 2 = 1"), "date_key", "v").select("date_key", "v")


@catalog.add("K05_health_upsert", A + " SELECT date_key, source_name, max(ai_score) AS fetched, max(merged_count) AS raw, arg_max(takeaway, id) AS error FROM a GROUP BY 1, 2")
def _(s, d):
    a = articles(s, d).select("date_key", "source_name", F.col("ai_score").alias("fetched"), F.col("merged_count").alias("raw"), F.col("takeaway").alias("error"), F.col("id").alias("seq"))
    return store.upsert_max(a.where("seq < 5000"), a.where("seq >= 5000"), ["date_key", "source_name"], ["fetched", "raw"], "error", "seq")


@catalog.add("K06_bump_counts", A + " SELECT a.id, a.merged_count + coalesce(d.n, 0)::BIGINT AS merged_count FROM a LEFT JOIN (SELECT id % 100 AS id, sum(id % 3) AS n FROM a GROUP BY 1) d ON a.id = d.id")
def _(s, d):
    a = articles(s, d).select("id", "merged_count")
    return store.bump(a, a.select((F.col("id") % 100).alias("id"), (F.col("id") % 3).alias("delta")), "id", "merged_count")


@catalog.add("K07_delete", A + " SELECT id FROM a WHERE id NOT IN (SELECT id FROM a WHERE category = 'noise')")
def _(s, d):
    a = articles(s, d).select("id", "category")
    return store.delete_keys(a.select("id"), a.where("category = 'noise'"), "id")


@catalog.add("K08_sparse_patch", A + " SELECT id, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'patched' ELSE date_key END AS date_key, CASE WHEN id % 2 = 0 THEN 7 ELSE merged_count END AS merged_count FROM a")
def _(s, d):
    a = articles(s, d).select("id", "date_key", "merged_count")
    patches = a.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, "patched").alias("date_key"), F.lit(7).cast("long").alias("merged_count"))
    return store.patch(a, patches, "id", ["date_key", "merged_count"])


@catalog.add("K10_attempts", A + " SELECT id, merged_count + CASE WHEN id % 10 = 0 THEN 2 ELSE 0 END AS attempts FROM a")
def _(s, d):
    a = articles(s, d).select("id", F.col("merged_count").alias("attempts"))
    return store.bump(a, a.where("id % 10 = 0").select("id", F.lit(2).alias("delta")), "id", "attempts")


@catalog.add("K12_guarded_swap", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def _(s, d):
    o = read(s, d, "orders").select("o_orderkey")
    return store.guarded_swap(o, o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 7 = 0"), "o_orderkey")


@catalog.add("K15_push_plan", "SELECT DISTINCT url FROM pages WHERE page_id % 4 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 0)")
def _(s, d):
    p = read(s, d, "pages").withColumn("key", urls.archive_key(F.col("url")))
    return p.where("page_id % 4 = 0").join(p.where("page_id % 4 <> 0").select("key"), "key", "left_anti").select("url").distinct()


@catalog.add("K20_retention", A + f" SELECT count(DISTINCT source_url) AS kept FROM a WHERE date_diff('day', TRY_CAST(date_key AS DATE), DATE '{TODAY}') <= CASE WHEN is_featured = 1 THEN 30 ELSE 7 END")
def _(s, d):
    return store.retained(articles(s, d), TODAY).agg(F.count("*").alias("kept"))


@catalog.add("K21_backups", """WITH b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CAST(day AS VARCHAR) AS day FROM (SELECT day FROM b ORDER BY day DESC LIMIT 14) UNION SELECT CAST(min(day) AS VARCHAR) FROM b GROUP BY date_trunc('month', day)""")
def _(s, d):
    return store.backup_keepers(read(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()).select(F.col("day").cast("string").alias("day"))
