"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import kernels
from tidewire.llm.session import shuffle_width, table

#: Hashes in a sketch; the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 128
#: Words in a shingle.
WIDTH = 5
#: Ranges of ids at most.
RANGES = 4096
_TOP = 0xFFFFFFFF


def sketches(column: pa.Array, k: int = K, width: int = WIDTH) -> np.ndarray:
    """(documents, k) matrix of the k smallest distinct 32-bit shingle hashes, ascending, padded with int64 -1."""
    words = kernels.split_words(column)
    start, length, first = kernels.shingles(words, width)
    hashes = (kernels.xxh64(words.buffer, start, length) >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(first) - 1, k), -1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            part = hashes[a:b]
            low = np.unique(np.partition(part, 4 * k)[: 4 * k]) if b - a > 8 * k else np.unique(part)
            if len(low) < k:  # the smallest ones repeat
                low = np.unique(part)
            out[i, : min(k, len(low))] = low[:k]
    return out


def to_text(row: np.ndarray) -> str:
    """A sketch as base64 of its big-endian hashes."""
    return base64.b64encode(row[row >= 0].astype(">u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    """The hashes of a sketch, ascending."""
    return np.frombuffer(base64.b64decode(text or ""), ">u4").astype(np.int64)


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the rows of two sketch matrices; two empty sketches are alike (1)."""
    k = a.shape[1]
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both >= 0
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    rank = np.cumsum(new, axis=1)
    inside = real & (rank <= k)
    union = (new & inside).sum(axis=1)
    shared = (inside & ~new).sum(axis=1)
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / (_TOP + 1.0))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    pad = lambda x: np.concatenate([x, np.full(k - len(x), -1)])[None, :]
    j = float(resemblance(pad(a), pad(b))[0])
    shared = j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + j)
    return min(1.0, shared / distinct_shingles(a, k))


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the documents or parts that ``parts`` are sketches of."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))[:k]


def merge_by_key(sketched: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """(key, sketch) for all rows of a key; merged in each partition before the shuffle, so a hot key stays small."""

    def partial(frames):
        kept: dict = {}
        for frame in frames:
            for name, texts in frame.groupby("key", dropna=False)["sketch"]:
                name = None if pd.isna(name) else name
                kept[name] = merge([kept.get(name, np.zeros(0, np.int64)), *map(from_text, texts)], k)
            if len(kept) > 20_000:  # bounded memory: hand over what there is
                yield pd.DataFrame({"key": list(kept), "sketch": [to_text(v) for v in kept.values()]})
                kept = {}
        yield pd.DataFrame({"key": list(kept), "sketch": [to_text(v) for v in kept.values()]})

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": frame.key[:1], "sketch": [to_text(merge([from_text(t) for t in frame.sketch], k))]})

    kind = sketched.schema[key].dataType.simpleString()
    parts = sketched.select(F.col(key).alias("key"), F.col(column).alias("sketch")).mapInPandas(partial, f"key {kind}, sketch string")
    return parts.groupBy("key").applyInPandas(final, f"key {kind}, sketch string").withColumnsRenamed({"key": key, "sketch": column})


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into id ranges, sorted by descending id, each range closed by a copy of the next range's first row.

    Columns: part, copy (1: only closes the range), id, tie, void, text; sorted by part, copy, id descending, tie.
    Ranges come from at most ``RANGES`` percentiles of the ids. A null id is the smallest.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).isNull().alias("void"), F.col(text_col).alias("text"))
    parts = min(4 * width, RANGES)
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 50 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    # one literal; a row is looked up in blocks of it first
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda values: F.array_size(F.filter(F.lit(values).cast("array<long>"), lambda c: c < F.col("id")))
    inside = F.filter(F.slice(F.lit(cuts).cast("array<long>"), below(cuts[step - 1 :: step]) * step + 1, step), lambda c: c < F.col("id")) if cuts else None
    part = F.lit(len(cuts)) - below(cuts[step - 1 :: step]) * step - F.array_size(inside) if cuts else F.lit(0)
    rows = rows.withColumn("part", part.cast("int")).withColumn("tie", F.xxhash64("text"))
    # the first id of each range closes the range before; the last one is closed by the first. A row for each range.
    order = Window.orderBy("part")
    last = F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    closes = rows.groupBy("part").agg(F.max("id").alias("id")).select("id", F.coalesce(F.lag("part").over(order), last).alias("closes"))
    heads = rows.join(F.broadcast(closes), "id").groupBy("id", "closes").agg(F.min(F.struct("tie", "void", "text")).alias("m"))
    heads = heads.select("id", "m.void", "m.text", F.col("closes").alias("part"), "m.tie")
    both = rows.withColumn("copy", F.lit(0)).unionByName(heads.withColumn("copy", F.lit(1)))
    return both.repartition(width, "part").sortWithinPartitions("part", "copy", F.col("id").desc(), "tie")


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, with estimated likenesses.

    Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, in descending order of id; the smallest id is followed by the largest. Null is the empty text; texts
    with fewer than ``width`` words are one shingle, texts without words have an empty fingerprint. Rows that
    repeat an id stay, ordered by a hash of the text. A null id sorts as the smallest and stays null. A single row
    is its own next. An empty table gives no rows; other columns are ignored.
    Texts are shuffled once; the next text is at hand because ranges of ids are sorted.
    """
    dealt = with_next(docs, id_col, text_col)

    def rows_of(texts: list[str], sk: np.ndarray, ids: list, voids: list, parts: np.ndarray, copies: np.ndarray):
        """The output for each row that is followed by another one of its range."""
        at = np.flatnonzero((copies[:-1] == 0) & (parts[1:] == parts[:-1]))
        edited = []
        for i in at.tolist():
            own, n = texts[i], len(texts[i])
            edited.append(own[: n - n // 2] + texts[i + 1][: n // 2])
        column = pa.array(edited, pa.string())
        other = np.concatenate([sketches(column.slice(a, 512), k, width) for a in range(0, len(column), 512)] or [np.zeros((0, k), np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if voids[i] else ids[i] for i in at.tolist()], pa.int64()),
                pa.array([len(texts[i]) for i in at.tolist()], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(r) for r in sk[at]], pa.string()),
                pa.array([to_text(r) for r in other], pa.string()),
                pa.array(resemblance(sk[at], other)),
                pa.array(resemblance(sk[at], sk[at + 1])),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(reader):
        held = None  # the row that waits for its next one
        for batch in kernels.batches(reader, "text", 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sk = sketches(batch.column("text"), k, width)
            now = (texts, sk, batch.column("id").to_pylist(), batch.column("void").to_pylist(), batch.column("part").to_numpy(), batch.column("copy").to_numpy())
            if held is not None:
                now = tuple(np.concatenate([a, b]) if isinstance(b, np.ndarray) else a + b for a, b in zip(held, now, strict=True))
            yield rows_of(*now)
            held = tuple(x[-1:] for x in now)

    out = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints all documents and their edited texts."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
