"""Selection per day: tiers, quotas, featured rows, replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire import values
from tidewire.functions import scores, times

_CONTEXT = ["existing_count", "existing_featured", "featured_min_score"]


def cascade(graded: DataFrame) -> DataFrame:
    """Tiers per day with seats: one in tier 0, three in tier 1; what is over falls to the next tier, in order of rank.

    ``graded`` has day, id, tier, rank and ord. Two passes of row numbers are the whole cascade, as later tiers have
    no limit. Scores are spread within the tier's band by the final order.
    """
    order = lambda *keys: Window.partitionBy(*keys).orderBy("rank", "ord")
    out = graded.withColumn("r0", F.row_number().over(order("day", "tier"))).withColumn("t1", F.when((F.col("tier") == 0) & (F.col("r0") > 1), 1).otherwise(F.col("tier")))
    out = out.withColumn("r1", F.row_number().over(order("day", "t1"))).withColumn("t2", F.when((F.col("t1") == 1) & (F.col("r1") > 3), 2).otherwise(F.col("t1")))
    out = out.withColumn("place", F.row_number().over(order("day", "t2")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("day", "t2")))
    score = scores.spread(F.col("place"), F.col("size"), scores.tier_bound(F.col("t2"), 0), scores.tier_bound(F.col("t2"), 1))
    return out.select("day", "id", F.col("t2").cast("long").alias("final_tier"), F.when(F.col("t2") != F.col("tier"), F.col("tier")).cast("long").alias("demoted_from"), score.alias("score"))


def mark_featured(rows: DataFrame, context: DataFrame | None = None, budget: int = 5, least: int = 80, first_share: float = 0.25, now: str | None = None) -> DataFrame:
    """Featured and breaking rows of the days, counted in list order.

    ``rows`` has id, date_key, ai_score, ord and title; newsness, original_title and published_at count if they are there.
    ``context`` has a row for each day that is not empty: date_key, existing_count, existing_featured and
    featured_min_score. A day's budget is shared by its rounds; a first round may fill a share of its rows only.
    Looks back and titles that shout are never featured. In a later round a fresh row that is not featured but as
    good as the day's featured ones is breaking.
    """
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    days = rows if context is None else rows.join(context.select("date_key", *_CONTEXT), "date_key", "left")
    days = days.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if context is not None else F.lit(0) for c in _CONTEXT})
    later, retro = F.col("existing_count") > 0, have("newsness") == "retro"
    eligible = ~retro & (F.col("ai_score") >= least) & (~later | (F.col("ai_score") >= 80)) & ~F.concat(have("title"), have("original_title")).rlike(values.CLICKBAIT)
    seen = F.sum(F.coalesce(eligible, F.lit(False)).cast("int")).over(Window.partitionBy("date_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    size = F.count("*").over(Window.partitionBy("date_key"))
    left = F.greatest(F.lit(0), F.lit(budget) - F.col("existing_featured"))
    cap = F.when(later, left).otherwise(F.least(size, left, F.greatest(F.lit(1), F.floor(size * first_share))))
    age = times.hours_between(F.lit(now).cast("timestamp") if now else F.current_timestamp(), F.try_to_timestamp(have("published_at")))
    breaking = later & ~retro & (F.col("ai_score") >= 85) & (F.col("ai_score") >= F.col("featured_min_score")) & F.coalesce(age <= 12, F.lit(False))
    out = days.withColumn("featured", F.coalesce(eligible & (seen <= cap), F.lit(False)).cast("long"))
    return out.withColumn("breaking", ((F.col("featured") == 0) & F.coalesce(breaking, F.lit(False))).cast("long")).drop(*_CONTEXT)


def quota(rows: DataFrame, stored: DataFrame | None = None, cap: int = 20, high_floor: int = 70, floor: int = 65, backfill: int = 56, backfill_most: int = 5) -> DataFrame:
    """Daily selection of a round: id, date_key, ai_score, channel, and the id of the row that it replaces.

    ``rows`` has id, date_key, ai_score, category, source_type and suspected; ``stored`` the rows that the days
    have already, with id, date_key, ai_score, category and is_featured. Outside the quota come up to two rows of
    official policy from 70 and up to three suspected incidents from 56. The others share what the stored ones leave of
    ``cap``, from 65, or from 70 once ten are stored; a day that stays under ten is filled up from 56 with at most five. A
    full day takes up to five rows for worse stored ones that are neither policy nor featured, and up to two more
    from 85. Ties go by id. Days with many rows are no single task's: ranks are cut before they are sorted.
    """
    best = lambda *keys: F.row_number().over(Window.partitionBy("date_key", *keys).orderBy(F.col("ai_score").desc(), "id"))
    there = rows.sparkSession.createDataFrame([], "date_key string, existing long") if stored is None else stored.groupBy("date_key").agg(F.count("*").alias("existing"))
    out = rows.join(there, "date_key", "left").withColumn("existing", F.coalesce("existing", F.lit(0)))
    out = out.withColumn("official", (F.col("source_type") == "official") & (F.col("category") == "policy") & (F.col("ai_score") >= high_floor))
    out = out.withColumn("protected", F.col("official") & (best("official") <= 2))
    out = out.withColumn("suspect", F.col("suspected") & (F.col("ai_score") >= backfill) & ~F.col("protected"))
    out = out.withColumn("incident", F.col("suspect") & (best("suspect") <= 3))
    out = out.withColumn("pool", ~F.col("protected") & ~F.col("incident"))
    least = F.when(F.col("existing") >= 10, high_floor).otherwise(floor)
    out = out.withColumns({"place": best("pool"), "room": F.greatest(F.lit(0), F.lit(cap) - F.col("existing"))})
    out = out.withColumn("regular", F.col("pool") & (F.col("ai_score") >= least) & (F.col("place") <= F.col("room")))
    out = out.withColumn("spare", F.col("pool") & (F.col("room") > 0) & (F.col("ai_score") >= backfill) & (F.col("ai_score") < least))
    short = F.least(F.lit(10) - F.col("existing") - F.sum(F.col("regular").cast("int")).over(Window.partitionBy("date_key")), F.lit(backfill_most))
    out = out.withColumn("filled", F.col("spare") & (best("spare") <= short))
    full = out.where("pool and room = 0 and existing > 0")
    taken = rows.sparkSession.createDataFrame([], "id long, victim long") if stored is None else replacements(full, stored.where("category <> 'policy' and is_featured <> 1")).select("id", "victim")
    out = out.join(taken, "id", "left")
    out = out.withColumn("rushed", F.col("pool") & (F.col("room") == 0) & (F.col("ai_score") >= 85) & F.col("victim").isNull())
    out = out.withColumn("breaking", F.col("rushed") & (best("rushed") <= 2))
    channel = F.when(F.col("protected"), "policy").when(F.col("incident"), "incident").when(F.col("regular"), "regular").when(F.col("filled"), "backfill").when(F.col("victim").isNotNull(), "replace").when(F.col("breaking"), "breaking")
    return out.withColumn("channel", channel).where("channel is not null").select("id", "date_key", "ai_score", "channel", "victim")


def policy_floor(rows: DataFrame, selected: DataFrame, stored: DataFrame | None = None, least: int = 56, seats: int = 2, cap: int = 20) -> DataFrame:
    """Policy rows that bring a day up to two selected ones, as far as stored and selected rows leave room.

    Rows under the URL of a selected row of their day are no candidates; a row without URL always is.
    """
    have = selected.groupBy("date_key").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "policy").alias("p"))
    pool = rows.where((F.col("category") == "policy") & (F.col("ai_score") >= least))
    pool = pool.join(selected.where("source_url <> ''").select("date_key", "source_url"), ["date_key", "source_url"], "left_anti").join(have, "date_key", "left")
    if stored is not None:
        pool = pool.join(stored.groupBy("date_key").agg(F.count("*").alias("existing")), "date_key", "left")
    existing = F.coalesce("existing", F.lit(0)) if stored is not None else F.lit(0)
    take = F.least(F.lit(seats) - F.coalesce("p", F.lit(0)), F.lit(cap) - existing - F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("date_key").orderBy(F.col("ai_score").desc(), "id")
    return pool.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= take).select("id", "date_key", "ai_score")


def replacements(candidates: DataFrame, victims: DataFrame, most: int = 5) -> DataFrame:
    """Rank-wise matches of best candidates and worst victims, up to the first that isn't strictly better."""
    up = candidates.withColumn("k", F.row_number().over(Window.partitionBy("date_key").orderBy(F.col("ai_score").desc(), "id"))).where(F.col("k") <= most)
    down = victims.withColumn("k", F.row_number().over(Window.partitionBy("date_key").orderBy("ai_score", "id"))).where(F.col("k") <= most)
    pairs = up.alias("c").join(down.alias("v"), ["date_key", "k"]).select("date_key", "k", F.col("c.id").alias("id"), F.col("v.id").alias("victim"), (F.col("v.ai_score") < F.col("c.ai_score")).alias("better"))
    broken = F.sum((~F.col("better")).cast("int")).over(Window.partitionBy("date_key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("broken", broken).where("broken = 0").select("date_key", "id", "victim")


def refine_pool(rows: DataFrame, full_days: list[str], limit: int = 30, days: int = 3) -> DataFrame:
    """Candidates for refinement in stages: incidents, few of full days, a share of each recent day, then the best.

    ``rows`` has id, date_key, ai_score and incident. A row keeps its first stage.
    """
    incident = Window.partitionBy("incident").orderBy(F.col("ai_score").desc(), "id")
    day = Window.partitionBy("date_key").orderBy(F.col("ai_score").desc(), "id")
    full = F.col("date_key").isin(full_days) if full_days else F.lit(False)
    recent = rows.where(~full).groupBy("date_key").count().orderBy(F.col("date_key").desc()).limit(days).select("date_key", F.lit(True).alias("recent"))
    out = rows.withColumn("forced", F.col("incident") & (F.row_number().over(incident) <= 8)).withColumn("drank", F.row_number().over(day)).join(F.broadcast(recent), "date_key", "left")  # ``days`` rows
    share = max(3, limit // max(1, days))
    stage = F.when(F.col("forced"), 0).when(full & (F.col("ai_score") >= 80) & (F.col("drank") <= 5), 1).when(~full & F.col("recent") & (F.col("drank") <= share), 2).when(~full, 3)
    out = out.withColumn("stage", stage).where("stage is not null")
    order = Window.orderBy("stage", F.col("ai_score").desc(), "id")
    # only the best ``limit`` rows of a stage can be taken: cut each stage before the global order
    each = Window.partitionBy("stage").orderBy(F.col("ai_score").desc(), "id")
    top = out.withColumn("srank", F.row_number().over(each)).where((F.col("stage") < 2) | (F.col("srank") <= limit))
    return top.withColumn("n", F.row_number().over(order)).where((F.col("stage") < 2) | (F.col("n") <= limit)).select("id", "date_key", "ai_score", F.col("stage").cast("long").alias("stage"))
