"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.bpe import encode_batches
from tidewire.llm.session import materialize, shuffle_width, table


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-two-fit over a histogram of lengths; counts[s] pieces have length s.

    Of some bounds on the gap that a replacement may leave, the one with the fewest bins is taken.
    """
    plans = [_plan(counts, capacity, most_left) for most_left in (capacity, capacity // 64, 0)]
    return min(plans, key=lambda x: x[0])[1]


def _plan(counts: np.ndarray, capacity: int, most_left: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(bins, slots) of one plan.

    A bin is filled greedily with the longest pieces that fit. Then its smallest piece is replaced by two unpacked
    pieces that fit the expanded gap more tightly, as long as that helps. The bin is repeated as often as the
    counts allow. Pieces of one length are alike, so the plan is as good as one made piece by piece, and its size
    depends on the capacity only. Returns (length, first_rank, per_bin, first_bin, offset): from rank first_rank
    on, ``per_bin`` consecutive pieces of that length go to each bin, side by side from offset.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    fits = np.zeros(capacity + 1, np.int64)  # the longest length <= index that is left

    def refresh() -> None:
        fits[:] = np.maximum.accumulate(np.where(left[: capacity + 1] > 0, np.arange(capacity + 1), 0))

    slots = []
    first_bin = 0
    refresh()
    while fits[capacity]:
        taken: dict[int, int] = {}
        gap = capacity

        def longest(room: int, taken: dict[int, int] = taken) -> int:
            size = int(fits[room]) if room > 0 else 0
            while size and taken.get(size, 0) >= left[size]:
                size = int(fits[size - 1])
            return size

        while size := longest(gap):
            many = min(gap // size, int(left[size]) - taken.get(size, 0))
            taken[size] = taken.get(size, 0) + many
            gap -= many * size
        while gap:
            small = min(taken)
            room = gap + small
            free = left[: room + 1] - np.array([taken.get(s, 0) for s in range(room + 1)])
            free[small] += 1
            have = np.maximum.accumulate(np.where(free > 0, np.arange(room + 1), 0))
            one = np.flatnonzero(free > 0)
            one = one[(one > 0) & (one < room)]
            two = have[room - one]
            ok = (two > 0) & ((two != one) | (free[one] > 1))
            if not ok.any():
                break
            total = np.where(ok, one + two, 0)
            best = int(total.argmax())
            if total[best] <= small or room - total[best] > most_left:
                break
            taken[small] -= 1
            if not taken[small]:
                del taken[small]
            for s in (int(one[best]), int(two[best])):
                taken[s] = taken.get(s, 0) + 1
            gap = room - int(total[best])
        times = min(int(left[s]) // m for s, m in taken.items())
        offset = 0
        for s, m in sorted(taken.items(), reverse=True):
            slots.append((s, int(used[s]), m, first_bin, offset))
            offset += s * m
            used[s] += times * m
            left[s] -= times * m
        first_bin += times
        refresh()
    return first_bin, slots


def token_pieces(docs: DataFrame, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents as ids with ``end_id`` behind, longer ones cut at ``capacity``."""

    def run(reader):
        for batch, _, ids, offsets in encode_batches(reader, "text", vocabulary):
            n = batch.num_rows
            whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
            first = offsets + np.arange(n + 1)
            sizes = np.diff(first)
            per = -(-sizes // capacity)
            doc = np.repeat(np.arange(n), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            raw = memoryview(np.ascontiguousarray(whole).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip((first[doc] + start).tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    Every document ends with id 0, so a null or empty text is a piece of one token. Only the histogram of lengths,
    at most ``capacity`` numbers, comes to the driver; ranks within a length are counted over salted groups, so one
    very common length is shared by many tasks. Repeated rows are packed as often as they stand; a null id stays null.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    salts = shuffle_width(spark)
    pieces = token_pieces(docs, capacity, 0, id_col, text_col, vocabulary).withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), salts).cast("int"))
    pieces = materialize(pieces, "pieces")
    groups = pieces.groupBy("length", "salt").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("count")).collect():  # one row a length at most
        counts[row[0]] = row[1]
    slots = plan_bins(counts, capacity)
    columns = np.array(sorted(slots), np.int64).reshape(-1, 5).T
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(reader):
        size, first, per, first_bin, offset = columns
        keys = size << 44 | first
        for batch in reader:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            step = rank - first[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(first_bin[k] + step // per[k]), pa.array(offset[k] + step % per[k] * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: packs all documents into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
