"""State changes as pure functions of the old state and a delta, and the writer of new versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.dedup import first_by


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, *order) -> DataFrame:
    """Old rows and the first new one of each key that is not there; columns that one side lacks are null."""
    fresh = first_by(new, key, *order).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn", "__new")


def upsert_quarantine(old: DataFrame, new: DataFrame, key: str = "source_url") -> DataFrame:
    """New rows replace old ones but keep their attempts and first time; reasons are cut at 300."""
    kept = old.select(key, F.col("attempts").alias("old_attempts"), F.col("quarantined_at").alias("old_at"))
    merged = new.join(kept, key, "left").select(key, F.substring("reason", 1, 300).alias("reason"), F.coalesce("old_attempts", "attempts", F.lit(0)).alias("attempts"), F.coalesce("old_at", "quarantined_at").alias("quarantined_at"))
    return old.join(new.select(key), key, "left_anti").select(*merged.columns).union(merged)


def upsert_max(old: DataFrame, new: DataFrame, keys: list[str], maxima: list[str], last: str, seq: str) -> DataFrame:
    """Per key the maxima of some columns and the last value of another; one aggregation with map-side combine."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in maxima], F.max_by(last, seq).alias(last))


def bump(state: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """Add summed deltas; a missing count is 0."""
    total = deltas.groupBy(key).agg(F.sum("delta").alias("__d"))
    return state.join(total, key, "left").withColumn(column, F.coalesce(column, F.lit(0)) + F.coalesce("__d", F.lit(0))).drop("__d")


def delete_keys(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Without the rows of these keys."""
    return state.join(keys.select(key), key, "left_anti")


def patch(state: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only the given fields change; null in a patch leaves a field."""
    renamed = patches.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = state.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in state.columns])


def guarded_swap(current: DataFrame, incoming: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """The incoming state without tombstones, or an error where it is less than half of the current one."""
    have, get = current.count(), incoming.count()
    if get < -(-have // 2):
        raise ValueError(f"refused: {get} rows would replace {have}")
    return delete_keys(incoming, tombstones, key)


def retained(rows: DataFrame, today: str, featured_days: int = 30, days: int = 7) -> DataFrame:
    """Keys of archive folders to keep: featured rows for longer."""
    age = F.date_diff(F.lit(today).cast("date"), F.try_to_date("date_key"))
    return rows.where(age <= F.when(F.col("is_featured") == 1, featured_days).otherwise(days)).select(F.substring(F.sha1("source_url"), 1, 16).alias("key")).distinct()


def backup_keepers(backups: DataFrame, newest: int = 14, series: list[str] | None = None) -> DataFrame:
    """The newest backups and the first of each month, of each series; ``backups`` has day (one row per backup)."""
    keys = series or []
    late = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc()))
    first = F.row_number().over(Window.partitionBy(*keys, F.date_trunc("month", "day")).orderBy("day"))
    if not keys:  # no window over all rows
        late_days = backups.orderBy(F.col("day").desc()).limit(newest).select("day")
        return late_days.union(backups.groupBy(F.date_trunc("month", "day")).agg(F.min("day").alias("day")).select("day")).distinct()
    return backups.withColumns({"late": late, "first": first}).where((F.col("late") <= newest) | (F.col("first") == 1)).select(*keys, "day")


def publish(df: DataFrame, root: str, partition: str | None = None) -> str:
    """Write a new immutable version below ``root`` and return its path; readers switch to it when it is complete."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    return path
