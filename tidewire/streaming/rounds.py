"""Collection rounds as micro-batches, the reader's watermark and a trigger with a cool-down."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.times import fresh, windows
from tidewire.functions.urls import normalize_url
from tidewire.operators import dedup


def run_rounds(spark: SparkSession, incoming: str, schema: str, store: str, checkpoint: str, now: Callable[[], str], on_round: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Read new candidate files, one round a trigger, and append what the store lacks.

    A round drops stale rows by each source's own window (lateness differs by row, so this is a filter and no
    watermark), keeps the first row of each normalised URL, and leaves out stored URLs. Rows go to the day they
    were published, or to ``unknown``. A round is appended below its batch id and replaced if it is run again, so
    a restart after a lost executor gives the same store. ``now`` is asked once a round.
    """
    stream = spark.readStream.schema(schema).json(incoming)

    def round_(batch: DataFrame, number: int) -> None:
        at = F.lit(now()).cast("timestamp")
        direct, rescued = windows(F.col("source_type") == "official", F.col("window_days"))
        ts = F.try_to_timestamp("published_at")
        rows = batch.where(fresh(ts, F.lit(None).cast("timestamp"), direct, rescued, at)).withColumn("url_norm", normalize_url(F.col("source_url")))
        rows = rows.withColumn("date_key", F.coalesce(F.date_format(ts + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd"), F.lit("unknown"))).withColumn("collected_at", at)
        once = dedup.first_by(rows, "url_norm", "published_at", "source_url")
        try:
            stored = spark.read.parquet(store).where(F.col("round") != number).select("url_norm")
            once = once.join(stored, "url_norm", "left_anti")
        except Exception as e:  # the first round has no store yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        once.write.mode("overwrite").parquet(f"{store}/round={number}")
        if on_round:
            on_round(once, number)

    return stream.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reader_frontiers(seen: DataFrame) -> DataFrame:
    """Per user the newest frontier that was committed; it never goes back."""
    return seen.groupBy("user_id").agg(F.max("frontier").alias("frontier"))


def unread(articles: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Per user the number of rows collected after the frontier."""
    days = articles.groupBy("collected_at").agg(F.count("*").alias("n"))
    # a running total over instants, then one range lookup per user through a sorted union
    marks = frontiers.select(F.col("frontier").alias("at"), "user_id", F.lit(0).alias("n")).unionByName(days.select(F.col("collected_at").alias("at"), F.lit(None).cast("long").alias("user_id"), "n"))

    day = F.to_date("at")
    later_days = marks.groupBy(day.alias("day")).agg(F.sum("n").alias("day_n")).withColumn("later", F.coalesce(F.sum("day_n").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("day").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("day", "at")
    out = marks.withColumn("day", day).withColumn("upto", F.sum("n").over(inside) - F.sum("n").over(same)).join(F.broadcast(later_days.select("day", "later")), "day")  # a row a day
    return out.where("user_id is not null").select("user_id", (F.col("upto") + F.col("later")).alias("unread"))


def cooled_triggers(hits: DataFrame, minutes: int = 90) -> DataFrame:
    """Of a stream of hits (name, at), those that fire: at least ``minutes`` after the last one of that name."""

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        fired = []
        for at in sorted(pd.concat(list(frames))["at"]):
            if last is None or (at - pd.Timestamp(last)).total_seconds() >= minutes * 60:
                fired.append(at)
                last = at
        if last is not None:
            state.update((pd.Timestamp(last).to_pydatetime(),))
        yield pd.DataFrame({"name": [key[0]] * len(fired), "at": fired})

    return hits.groupBy("name").applyInPandasWithState(step, "name string, at timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)
