"""Embedding near-duplicates by random-hyperplane sign hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.components import connected_components, min_labels
from tidewire.llm.grouping import runs
from tidewire.llm.session import materialize, shuffle_width, table

#: Vectors that a bucket should hold on average; fewer bits for smaller tables.
BUCKET = 256
#: Chance at most that a pair at the threshold itself shares no bucket; closer pairs are missed far less.
MISS = 1e-5
#: A bucket with more vectors is cut into chunks of this size, and chunk pairs are compared by different tasks.
CHUNK = 1024


def hash_plan(n: int, threshold: float, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors: buckets of about ``bucket`` vectors and a chance of ``miss`` at the threshold."""
    bits = min(30, max(1, math.ceil(math.log2(max(2, n / bucket)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    positive = vectors @ _planes(vectors.shape[1], bits, tables, seed) >= 0
    return (positive.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(_sig_type(bits))


def _sig_type(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.int32


def _packed(v: np.ndarray) -> bytes:
    """The components, as 4-byte floats where that loses nothing."""
    with np.errstate(over="ignore"):
        small = v.astype(np.float32)
    return b"f" + small.tobytes() if (small.astype(np.float64) == v).all() else b"d" + v.tobytes()


def _length(packed: bytes) -> int:
    return (len(packed) - 1) // (4 if packed[:1] == b"f" else 8)


def _matrix(packed: list[bytes]) -> np.ndarray:
    """Vectors of one length, in double precision."""
    return np.stack([np.frombuffer(p, np.float32 if p[:1] == b"f" else np.float64, offset=1).astype(np.float64) for p in packed])


def _usable(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, vec): vec holds the components as bytes; null where a vector links with nothing."""
    column = batch.column("embedding").cast(pa.large_list(pa.float64()))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    present = column.is_valid().to_numpy(zero_copy_only=False)
    vecs: list[bytes | None] = []
    for i, ok in enumerate(present.tolist()):
        v = values[offsets[i] : offsets[i + 1]] if ok else None
        vecs.append(_packed(v) if ok and len(v) and np.isfinite(v).all() and v.any() else None)
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vecs, pa.binary())], ["id", "vec"])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares stay finite
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """Per vector: id, n_links (other vectors at cosine >= threshold), component_id and kept.

    Equal vectors are one class with a weight and are compared once. A class has one signature in each of several
    tables; classes that share a bucket are verified with exact cosines in double precision, in the first table in
    which they meet. Buckets above ``CHUNK`` are cut into chunks that are compared pairwise in different tasks, so
    no bucket is capped. Tasks return link counts and spanning edges, never the pairs.
    A null, empty or zero vector, or one with null or non-finite components, has no links and is its own component;
    vectors of different length never link. Ids should be unique; of rows with a null id nothing is linked to others
    by id, they keep a null component. Empty tables give no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    usable = materialize(rows.mapInArrow(lambda it: (_usable(b) for b in it if b.num_rows), "id long, vec binary"), "vectors")
    classes = materialize(usable.where("vec is not null").groupBy("vec").agg(F.min("id").alias("class"), F.count("*").alias("weight")), "classes")
    n = classes.count()
    bits, tables = hash_plan(n, threshold)

    def place(reader):
        for batch in reader:
            if not batch.num_rows:
                continue
            sizes = np.array([_length(v) for v in batch.column("vec").to_pylist()])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                sig = _signatures(_scaled(_matrix(part.column("vec").to_pylist())), bits, tables, seed)
                at = np.repeat(np.arange(len(part)), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(sig.reshape(-1).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), *(part.column(c).take(pa.array(at)) for c in ("class", "weight", "vec")), pa.array([s.tobytes() for s in sig], pa.binary()).take(pa.array(at))],
                    ["tab", "bucket", "size", "class", "weight", "vec", "sigs"],
                )

    key = ["tab", "bucket", "size"]
    placed = classes.mapInArrow(place, "tab int, bucket int, size int, class long, weight long, vec binary, sigs binary")
    sizes = placed.groupBy(*key).count().where(F.col("count") > CHUNK).select(*key, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    sizes = materialize(sizes, "buckets")  # mostly empty; its written size tells the planner whether to broadcast it
    chunked = placed.join(sizes, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class"), "chunks").cast("int"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("chunks", "other")
    group = [*key, "a", "b"]
    dealt = dealt.repartition(shuffle_width(spark), *group).sortWithinPartitions(*group)

    def verify(reader):
        for t in runs(reader, group):
            if len(t) < 2:
                continue
            tab, a, b = (t.column(c)[0].as_py() for c in ("tab", "a", "b"))
            v = _scaled(_matrix(t.column("vec").to_pylist()))
            sig = np.frombuffer(b"".join(t.column("sigs").to_pylist()), _sig_type(bits)).reshape(len(t), -1)[:, :tab]
            ids, weight, own = (t.column(c).to_numpy() for c in ("class", "weight", "own"))
            left = np.arange(len(t)) if a == b else np.flatnonzero(own == a)
            right = left if a == b else np.flatnonzero(own == b)
            links, us, vs = np.zeros(len(t), np.int64), [], []
            for k in range(0, len(left), 256):
                part = left[k : k + 256]
                i, j = np.nonzero(v[part] @ v[right].T >= threshold)
                i, j = part[i], right[j]
                new = i < j if a == b else np.ones(len(i), bool)
                i, j = i[new], j[new]
                if tab and len(i):
                    met = np.zeros(len(i), bool)
                    for c in range(tab):
                        met |= sig[i, c] == sig[j, c]
                    i, j = i[~met], j[~met]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                if len(i):
                    node, low = min_labels(ids[i], ids[j])
                    us.append(node[node != low])
                    vs.append(low[node != low])
            on = np.flatnonzero(links)
            if len(on):
                node, low = min_labels(np.concatenate(us), np.concatenate(vs))
                far = dict(zip(node.tolist(), low.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array([far[x] for x in ids[on].tolist()], pa.int64()), pa.array(links[on])], ["u", "v", "n"])

    found = materialize(dealt.mapInArrow(verify, "u long, v long, n long"), "links")
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select("u", "v"))
    facts = classes.join(counts, F.col("class") == F.col("u"), "left").join(groups, F.col("class") == F.col("node"), "left").select("vec", "class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "class").alias("component"))
    out = usable.join(facts, "vec", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: links and components of all embeddings."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY 1), c AS (SELECT u, min(w) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
