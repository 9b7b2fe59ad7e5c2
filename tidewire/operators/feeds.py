"""Read-side operators over articles: day lists, pages, catch-up, archive, facets, related items, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import values

POLICY_FLOOR, MAIN_FLOOR = 60, 65


def not_noise() -> Column:
    """Rows that are shown at all."""
    return F.col("category") != "noise"


def main_gate(policy_sources: list[str], with_score: bool = True) -> Column:
    """Quality gate of the main feed; without the score clause that of the catch-up."""
    policy = F.col("category") == "policy"
    if policy_sources:
        policy = policy | F.col("source_name").isin(policy_sources)
    scored = (F.col("is_featured") == 1) | (F.col("ai_score") >= MAIN_FLOOR) | ((F.col("ai_score") >= POLICY_FLOOR) & policy)
    clean = (F.trim(F.coalesce("takeaway", F.lit(""))) != "") & ~F.contains("summary", F.lit("�")) & ~F.contains("title", F.lit("�"))
    return scored & clean if with_score else clean


def score_bands(least: list[int]) -> Column:
    """Union of the bands [m, m + 10); 90 is open; invalid bounds are ignored."""
    score = F.col("ai_score")
    parts = [(score >= m) & (score < (999 if m == 90 else m + 10)) for m in least if 0 < m <= 100]
    return reduce(lambda a, b: a | b, parts, F.lit(not parts))


def has_tag(field: str, tag: str) -> Column:
    """Typed tag membership."""
    return F.array_contains(field, tag)


def like_tag(tag: str) -> Column:
    """Any tag that is the text, whatever its ASCII case, with wildcards stripped."""
    bare = "".join(c for c in tag if c not in '"%_\\').lower()
    return F.exists(F.concat("companies", "keywords", "regions"), lambda v: F.lower(v) == bare)


def where_all(conditions: list[Column]) -> Column:
    """Conjunction of what a request asks for."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def page(articles: DataFrame, conditions: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page with the total of all pages on each row; sizes are clamped to 1-50, pages to 1 and more."""
    size, number = min(50, max(1, size)), max(1, number)
    rows = articles.where(where_all([not_noise(), *conditions]))
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(F.col("date_key").desc(), F.col("ai_score").desc(), "id").offset((number - 1) * size).limit(size)
    return shown.join(F.broadcast(total)).select("id", "date_key", "category", "ai_score", "total")  # one row


def catch_up(articles: DataFrame, since: str, before: str, days: int = 3, newest: int = 10, others: int = 3) -> DataFrame:
    """Rows collected since, of up to ``days`` days before a day: ten of the newest day, three of each other.

    The redundant bound on the row number lets the planner keep few rows per day before the shuffle; the days'
    ranks come from the few distinct days, not from a window over all rows.
    """
    first = F.date_format(F.date_sub(F.lit(before).cast("date"), days), "yyyy-MM-dd")
    rows = articles.where(not_noise() & main_gate([], with_score=False) & (F.col("date_key") < before) & (F.col("date_key") >= first) & (F.col("collected_at") >= F.try_to_timestamp(F.lit(since))))
    order = Window.partitionBy("date_key").orderBy(F.col("is_featured").desc(), F.col("ai_score").desc(), "id")
    top = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max(newest, others))
    ranks = top.select("date_key").distinct().withColumn("day_rn", F.dense_rank().over(Window.orderBy(F.col("date_key").desc())))
    out = top.join(F.broadcast(ranks), "date_key").where(F.col("rn") <= F.when(F.col("day_rn") == 1, newest).otherwise(others))  # at most ``days`` rows
    return out.select("id", "date_key", "ai_score", F.col("rn").cast("long").alias("rn"), F.col("day_rn").cast("long").alias("day_rn"))


def archive(articles: DataFrame, before: str, category: str | None = None, limit: int = 10, days: int = 30, decay: float = 0.5) -> DataFrame:
    """Best rows of the window before a day by a score that decays with age."""
    first = F.date_format(F.date_sub(F.lit(before).cast("date"), days), "yyyy-MM-dd")
    rows = articles.where(not_noise() & main_gate([]) & (F.col("date_key") < before) & (F.col("date_key") >= first))
    rows = rows.where(F.col("category") == category) if category else rows
    age = F.date_diff(F.lit(before).cast("date"), F.try_to_date("date_key"))
    return rows.withColumn("decayed", F.col("ai_score") - age * decay).orderBy(F.col("decayed").desc(), F.col("date_key").desc(), "id").limit(min(30, max(1, limit))).select("id", "date_key", "decayed")


def tag_facets(articles: DataFrame, keyword_limit: int = 30) -> DataFrame:
    """Counts of distinct tags per article by facet; regions only of policy pieces; keywords only the most used."""
    facet = lambda f: F.struct(F.lit(f).alias("facet"), F.array_distinct(F.transform(f, lambda v: F.trim(v))).alias("names"))
    regions = F.struct(F.lit("regions").alias("facet"), F.when(F.col("category") == "policy", F.array_distinct("regions")).otherwise(F.array().cast("array<string>")).alias("names"))
    rows = articles.where(not_noise()).select(F.explode(F.array(facet("companies"), facet("keywords"), regions)).alias("f")).select("f.facet", F.explode("f.names").alias("name")).where("name <> ''")
    counts = rows.groupBy("facet", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "name"))
    return counts.withColumn("rn", rank).where((F.col("facet") != "keywords") | (F.col("rn") <= keyword_limit)).select("facet", "name", "n")


def related(articles: DataFrame, days: int = 30, most: int = 3) -> DataFrame:
    """Up to three items of the ``days`` days before each article: id, other, kind and rn.

    kind 0: the same event; 1: a shared subject and keyword; 2: two shared keywords. Within a kind the greater
    weight goes first (inverse document frequencies among the items of the window, keywords doubly), then the later day,
    then the smaller id. Tags that say nothing about a story don't count.

    Articles of a day with the same event and tags have the same related items, so they are looked up once; of
    the items with the same event and tags only the newest can be among the first. Items are found by the event,
    and, only where that gives too few, by pairs of tags; nothing is compared with all others.
    """
    said = lambda *cs: F.filter(F.array_distinct(F.transform(F.concat(*cs), lambda v: F.lower(F.trim(v)))), lambda v: (v != "") & ~v.isin(values.GENERIC_TAGS))
    subjects = [c for c in ("companies", "people") if c in articles.columns]
    base = articles.where(not_noise() & (F.col("date_key") != values.SENTINEL)).select("id", F.unix_date(F.try_to_date("date_key")).alias("day"), F.trim(F.coalesce("event_norm", F.lit(""))).alias("event"), F.sort_array(said(*subjects)).alias("subjects"), F.sort_array(said("keywords")).alias("topics")).where("day is not null")
    base = base.withColumn("profile", F.md5(F.to_json(F.struct("event", "subjects", "topics"))))
    profiles = base.select("profile", "event", "subjects", "topics").distinct()
    before = lambda *keys: Window.partitionBy(*keys).orderBy("day").rangeBetween(-days, -1)
    # how often a tag, and anything, stands in the window of a day
    used = base.select("day", F.explode(F.array_union("subjects", "topics")).alias("tag")).groupBy("tag", "day").agg(F.count("*").alias("n"))
    totals = base.groupBy("day").agg(F.count("*").alias("n")).withColumn("total", F.coalesce(F.sum("n").over(before(F.lit(0))), F.lit(0)) + 1)  # a row a day
    idf = used.withColumn("df", F.coalesce(F.sum("n").over(before("tag")), F.lit(0))).join(F.broadcast(totals.select("day", "total")), "day").select("tag", "day", (F.log(F.col("total") / (F.col("df") + 1)) + 0.3).alias("idf"))
    asked = base.select("profile", "day").distinct()
    weights = asked.join(profiles, "profile").select("profile", "day", F.explode(F.array_union("subjects", "topics")).alias("tag")).join(idf, ["tag", "day"]).groupBy("profile", "day").agg(F.map_from_entries(F.collect_list(F.struct("tag", "idf"))).alias("idf"))
    asked = asked.join(profiles, "profile").join(weights, ["profile", "day"], "left")
    # an item is one of the newest of its profile until ``most`` newer ones are there
    newest = Window.partitionBy("profile").orderBy(F.col("day").desc(), "id")
    first = Window.partitionBy("profile", "day").orderBy("id")
    items = base.select("profile", "day", "id").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most)
    items = items.withColumn("until", F.least(F.coalesce(F.lag("day", most).over(newest), F.col("day") + days), F.col("day") + days)).where("until > day")
    items = items.select(F.col("profile").alias("other_profile"), F.explode(F.sequence(F.col("day") + 1, "until")).alias("on"), F.col("id").alias("other"), F.col("day").alias("other_day")).withColumnRenamed("on", "day")
    others = profiles.select(F.col("profile").alias("other_profile"), F.col("subjects").alias("other_subjects"), F.col("topics").alias("other_topics"), F.col("event").alias("other_event"))

    def ranked(pairs: DataFrame, kind: Column) -> DataFrame:
        shared_topics, shared_subjects = F.array_intersect("topics", "other_topics"), F.array_intersect("subjects", "other_subjects")
        sum_of = lambda tags, factor: F.aggregate(tags, F.lit(0.0), lambda x, v: x + factor * F.col("idf")[v])
        weight = F.round(sum_of(shared_topics, 2.0) + sum_of(shared_subjects, 1.0), 6)
        found = pairs.select("profile", "day", "other_profile", kind.alias("kind"), weight.alias("weight")).join(items, ["other_profile", "day"])
        order = Window.partitionBy("profile", "day").orderBy("kind", F.col("weight").desc(), F.col("other_day").desc(), "other")
        return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)

    same = asked.where("event <> ''").join(others.withColumn("event", F.col("other_event")), "event")
    by_event = ranked(same, F.lit(0)).select("profile", "day", "kind", "rn", "weight", "other", "other_day")
    have = by_event.groupBy("profile", "day").agg(F.max("rn").alias("have"))
    more = asked.join(have, ["profile", "day"], "left").where(F.coalesce("have", F.lit(0)) < most)

    def pairs_of(subjects: str, topics: str) -> Column:
        mixed = F.flatten(F.transform(subjects, lambda a: F.transform(topics, lambda b: F.struct(a.alias("a"), b.alias("b"), F.lit(True).alias("mixed")))))
        both = F.flatten(F.transform(topics, lambda a: F.transform(F.filter(topics, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"), F.lit(False).alias("mixed")))))
        return F.explode(F.concat(mixed, both)).alias("pair")

    mine = more.select("profile", "day", pairs_of("subjects", "topics"))
    theirs = others.select("other_profile", "other_event", pairs_of("other_subjects", "other_topics"))
    met = mine.join(theirs, "pair").groupBy("profile", "day", "other_profile").agg(F.max("pair.mixed").alias("mixed"))
    met = met.join(more, ["profile", "day"]).join(others, "other_profile").where((F.col("event") == "") | (F.col("event") != F.col("other_event")))
    by_tags = ranked(met, F.when(F.col("mixed"), 1).otherwise(2)).select("profile", "day", "kind", F.col("rn") + most, "weight", "other", "other_day")
    place = F.row_number().over(Window.partitionBy("profile", "day").orderBy("rn"))
    top = by_event.union(by_tags).withColumn("rn", place).where(F.col("rn") <= most)
    return base.select("id", "profile", "day").join(top, ["profile", "day"]).select("id", "other", F.col("kind").cast("long").alias("kind"), F.col("rn").cast("long").alias("rn"))


def health_report(health: DataFrame, sources: DataFrame) -> DataFrame:
    """Each source with its leading days without articles, status, last active and latest day."""
    newest = Window.partitionBy("source_name").orderBy(F.col("date_key").desc()).rowsBetween(Window.unboundedPreceding, 0)
    alive = health.withColumn("alive", F.sum((F.col("fetched") > 0).cast("int")).over(newest))
    agg = alive.groupBy("source_name").agg(F.count_if(F.col("alive") == 0).alias("zero_days"), F.max(F.when(F.col("fetched") > 0, F.col("date_key"))).alias("last_active"), F.max("date_key").alias("latest_date"), F.max_by("fetched", "date_key").alias("latest_fetched"))
    out = sources.join(agg, "source_name", "left").withColumn("zero_days", F.coalesce("zero_days", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("latest_date").isNull(), "no_data").when(F.col("zero_days") >= F.col("threshold"), "alert").otherwise("ok"))


def degraded_fill(main: DataFrame, queue: DataFrame, need: int) -> DataFrame:
    """Rows that fill a thin day: unprocessed ones first, then failed ones; one per URL, newest first."""
    pool = main.withColumn("pool", F.lit(0)).unionByName(queue.withColumn("pool", F.lit(1)))
    once = pool.withColumn("rn", F.row_number().over(Window.partitionBy("source_url").orderBy("pool", F.col("published_at").desc(), "id"))).where("rn = 1")
    return once.orderBy(F.col("published_at").desc(), "id").limit(need).select("id", "source_url", "published_at", "pool")


def follow_feed(articles: DataFrame, tags: list[str], per_tag: int = 10, most: int = 30) -> DataFrame:
    """Best rows of each followed tag, each article under the first tag that holds it."""
    wanted = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("tag")) for i, t in enumerate(tags[:8])])
    hits = articles.where(not_noise()).select("*", F.explode(F.filter(wanted, lambda w: F.array_contains(F.concat("companies", "keywords"), w["tag"]))).alias("w"))
    order = Window.partitionBy("w.ord").orderBy(F.col("date_key").desc(), F.col("ai_score").desc(), "id")
    top = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_tag)
    first = top.groupBy("id", "date_key", "ai_score").agg(F.min("w.ord").alias("ord"))
    return first.orderBy(F.col("date_key").desc(), F.col("ai_score").desc(), "id").limit(most).select("id", "date_key", "ai_score", F.col("ord").cast("long").alias("ord"))


def neighbours(day_index: DataFrame) -> DataFrame:
    """Each non-empty day with the one before and after it."""
    w = Window.orderBy("date_key")  # one row a day
    return day_index.select("date_key", F.lag("date_key").over(w).alias("prev"), F.lead("date_key").over(w).alias("next"))
