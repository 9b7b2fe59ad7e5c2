"""Exact and near duplicates within and across rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text


def first_by(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key; deterministic, unlike dropDuplicates."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def merge_titles(rows: DataFrame) -> DataFrame:
    """Rows with equal long titles become the earliest one (undated last), with counts summed, in the first place.

    ``rows`` has id, ord, title_norm, published_ts and merged_count.
    """
    key = F.when(text.dedupable(F.col("title_norm")), F.col("title_norm")).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    return rows.withColumn("key", key).groupBy("key").agg(
        F.min_by("id", F.struct(F.col("published_ts").isNull(), "published_ts", "ord")).alias("id"),
        F.min("ord").alias("ord"),
        (F.count("*") - 1 + F.sum("merged_count")).alias("merged_count"),
    ).select("id", "ord", "merged_count")


def existing_urls(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored URLs that equal a candidate's raw or normalised URL: a union of two equi-joins."""
    raw = stored.join(candidates.select("source_url"), "source_url", "left_semi")
    normal = stored.join(candidates.select("url_norm"), "url_norm", "left_semi")
    return raw.unionByName(normal).distinct()


def drop_existing(candidates: DataFrame, stored: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates whose raw URL is not stored; strict compares normalised URLs too."""
    out = candidates.join(stored.select("source_url"), "source_url", "left_anti")
    return out.join(stored.select("url_norm"), "url_norm", "left_anti") if strict else out


def title_hits(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Per stored row the number of candidates that repeat its title; each candidate counts for the earliest hit."""
    hits = candidates.select(F.col("id").alias("candidate"), "title_norm").join(stored.select("id", "title_norm", "published_ts"), "title_norm")
    first = hits.groupBy("candidate").agg(F.min_by("id", F.struct(F.col("published_ts").isNull(), "published_ts", "id")).alias("id"))
    return first.groupBy("id").agg(F.count("*").alias("bump"))


#: Words of bits for the commonest bigrams and for hashes of the others; ids in one list, lists in one chunk, at most
#: about; copies of a small table, so that no key meets it in one task.
COMMON, HASHED, COPIES, CHUNK, SPREAD = 5, 2, 128, 4096, 64


def _spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by) -> DataFrame:
    """Left join with a table of few keys; rows of a frequent key go to several tasks, by a hash of ``by``."""
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SPREAD))).join(salted, [*keys, "__salt"], "left").drop("__salt")


def _title_bits(titles: DataFrame) -> DataFrame:
    """Per title its number of bigrams, words of bits (w0 is the first) and its rare bigrams.

    The first words have a bit for each of the commonest bigrams, so their ANDs count what two titles share of these;
    the last ones have bits by hashes of the rare ones.
    """
    held = titles.select("title", F.explode(text.bigrams(F.col("title"))).alias("gram"))
    common = held.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(64 * COMMON)
    common = common.agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "gram"))).alias("grams")).select(F.posexplode("grams").alias("place", "g")).select("place", "g.gram")
    placed = held.join(F.broadcast(common), "gram", "left")  # 64 * COMMON rows at most
    hashed = F.lit(64 * COMMON) + F.pmod(F.xxhash64("gram"), F.lit(64 * HASHED)).cast("int")
    bits = placed.select("title", F.coalesce("place", hashed).alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)"))), F.lit(0).cast("long")).alias(f"w{w}") for w in range(COMMON + HASHED)]
    rare = placed.where("place is null").groupBy("title").agg(F.collect_list("gram").alias("rare"))
    out = bits.groupBy("title").agg(*words, F.count("*").cast("int").alias("size")).join(rare, "title", "left")
    return out.withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


def similar_titles(rows: DataFrame, least: float = 0.55, min_length: int = 16) -> DataFrame:
    """Pairs of titles of one block with a Dice similarity and no conflict of numbers.

    ``rows`` has id, block and title. Equal titles of a block are one row with a list of ids, of several where there
    are many. At 0.55 a prefix of rare bigrams is nearly two thirds of a title, and joining on it makes more candidates
    than there are pairs; so the titles of a block are compared as words of bits. They are dealt into chunks, a task gets
    two chunks, and each two titles meet once. Lists are expanded there: neither candidates nor pairs are shuffled.
    """
    base = rows.where((F.length("title") >= min_length) & F.col("id").isNotNull() & F.col("block").isNotNull()).select("id", "block", "title")
    many = base.groupBy("block", "title").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("block", "title", F.ceil(F.col("n") / COPIES).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), "parts"), F.lit(0).cast("long"))
    lists = _spread_join(base, many, ["block", "title"], ["id"]).groupBy("block", "title", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    large = lists.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("block", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    dealt = _spread_join(lists, large, ["block"], ["title", "part"]).withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    # need: half of what the sizes ask of the overlap, a little less for rounding; slack: rare bigrams that share a bit
    n = COMMON + HASHED
    slack = F.size("rare") - sum((F.bit_count(f"w{w}") for w in range(COMMON, n)), F.lit(0))
    more = F.struct("title", "part", "rare", text.numbers(F.col("title")).alias("nums"), "size")  # read for likely pairs only
    full = dealt.join(_title_bits(base.select("title").distinct()), "title").select("block", F.pmod(F.xxhash64("title", "part", F.lit(1)), "chunks").alias("chunk"), "chunks", "ids", *(f"w{w}" for w in range(n)), slack.alias("slack"), (F.col("size") * least / 2 - 1e-6).alias("need"), more.alias("more"))
    keys, tasks = ["block", "i", "j"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = full.select("*", F.col("chunk").alias("i"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("j")).repartition(tasks, *keys).alias("a")
    b = full.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "chunk")).alias("i"), F.col("chunk").alias("j")).repartition(tasks, *keys).alias("b")
    shared = lambda words: " + ".join(f"bit_count(a.w{w} & b.w{w})" for w in words)
    likely = F.expr(f"{shared(range(n))} + least(a.slack, b.slack) >= a.need + b.need")
    overlap = f"{shared(range(COMMON))} + if({shared(range(COMMON, n))} = 0, 0, size(array_intersect(a.more.rare, b.more.rare)))"
    dice = F.expr(f"2.0D * ({overlap}) / (a.more.size + b.more.size)")
    conflict = F.expr("size(a.more.nums) > 0 and size(b.more.nums) > 0 and a.more.nums <> b.more.nums")
    once = F.expr("a.i < a.j or a.more.title < b.more.title or (a.more.title = b.more.title and a.more.part <= b.more.part)")
    same = F.expr("a.more.title = b.more.title and a.more.part = b.more.part")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).where(likely & once & (dice >= least) & ~conflict)
    met = met.select(F.round(dice, 6).alias("dice"), same.alias("same"), F.col("a.ids").alias("xs"), F.col("b.ids").alias("ys"))
    pairs = met.select("dice", "same", "ys", F.explode("xs").alias("x")).select("dice", "same", "x", F.explode("ys").alias("y"))
    return pairs.where(F.expr("if(same, x < y, x <> y)")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dice")


def leader_clusters(rows: DataFrame, least: float = 0.72) -> DataFrame:
    """Greedy clusters of event names in a round, best score first: a row joins the first leader that it resembles.

    ``rows`` has round, id, name and score. A round is a bounded batch, so it is one group. The leader's name stays
    that of the first row; containment counts as resemblance. Not a transitive closure.
    """

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
        frame = frame.sort_values(["score", "id"], ascending=[False, True])
        leaders: list[tuple[int, str, set]] = []
        out = []
        for i, name in zip(frame.id, frame.name, strict=True):
            g = grams(name)
            for lead, other, og in leaders:
                alike = name == other or name in other or other in name or (len(name) > 1 and len(other) > 1 and 2 * len(g & og) / (len(g) + len(og)) >= least)
                if alike:
                    out.append(lead)
                    break
            else:
                leaders.append((i, name, g))
                out.append(i)
        return pd.DataFrame({"round": frame["round"].to_numpy(), "id": frame.id.to_numpy(), "leader": out})

    return rows.select("round", "id", F.coalesce("name", F.lit("")).alias("name"), "score").groupBy("round").applyInPandas(cluster, "round string, id long, leader long")


def period_verdicts(candidates: DataFrame, verdicts: DataFrame, recent: DataFrame, gap: int = 15, floor: int = 60) -> DataFrame:
    """Verdicts on repeats of recent events: the same event goes; a follow-up is scored below it, or goes."""
    joined = candidates.join(verdicts, "id", "left").join(recent.select(F.col("id").alias("related_id"), F.col("ai_score").alias("ref_score")), "related_id", "left")
    known = F.col("ref_score").isNotNull()
    score = F.when((F.col("verdict") == "followup") & known, F.least("ai_score", F.col("ref_score") - gap)).otherwise(F.col("ai_score"))
    out = joined.withColumn("new_score", score)
    gone = known & ((F.col("verdict") == "same_event") | ((F.col("verdict") == "followup") & (F.col("new_score") < floor)))
    return out.where(~F.coalesce(gone, F.lit(False))).select("id", F.col("new_score").alias("ai_score"), (F.coalesce((F.col("verdict") == "followup") & known, F.lit(False))).cast("long").alias("is_followup"))


def drop_old(articles: DataFrame, checks: DataFrame, today: str, days: int = 3) -> DataFrame:
    """Rows whose event is older than three days or stands in recent titles go; rows without a check stay."""
    joined = articles.join(checks, "id", "left")
    old = F.date_diff(F.lit(today).cast("date"), F.try_to_date("event_date")) > days
    return joined.where(~F.coalesce(old, F.lit(False)) & ~F.coalesce("in_recent_titles", F.lit(False))).select(*articles.columns)


def split_roundups(articles: DataFrame, events: DataFrame, most: int = 6) -> DataFrame:
    """Round-ups with at least two usable events are replaced in place by them; others stay.

    ``articles`` has ord, id, title and source_url; ``events`` has id and events (title, segment).
    """
    usable = F.slice(F.filter("events", lambda e: F.length(e["title"]).between(8, 60) & (F.length(e["segment"]) >= 40)), 1, most)
    joined = articles.join(events, "id", "left").withColumn("parts", F.when(F.size(usable) >= 2, usable))
    parts = joined.where("parts is not null").select("ord", "id", F.posexplode("parts").alias("n", "e"), "source_url").select("ord", "id", (F.col("n") + 1).cast("long").alias("part"), F.col("e.title").alias("title"), F.concat("source_url", F.lit("#ev-"), (F.col("n") + 1).cast("string")).alias("source_url"))
    whole = joined.where("parts is null").select("ord", "id", F.lit(0).cast("long").alias("part"), "title", "source_url")
    return whole.union(parts)
