"""SimHash near-duplicates found through vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels
from tidewire.llm.components import connected_components, min_labels
from tidewire.llm.grouping import runs
from tidewire.llm.session import discard, materialize, shuffle_width, table

#: Distinct fingerprints that a shard should hold on average; more than HOT are compared in chunks.
SHARD, HOT = 4096, 16_384
#: Levels of the top trees. Each one copies over half of the fingerprints to a boundary, so there are few.
DEPTH = 2
#: Fingerprints from which vantage points and radii are taken; any sample gives the same links.
SAMPLE = 20_000
#: A node of a shard's tree with at most so many fingerprints on a side is compared directly.
LEAF = 512


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: bit i is set if bit i is set in over half of a document's hashes."""
    n = len(first) - 1
    ones = np.zeros((n, 64), dtype=np.int32)
    count = np.diff(first)
    a = 0
    while a < n:  # documents in blocks, so that the unpacked bits stay small
        b = int(np.searchsorted(first, first[a] + (1 << 17), side="right")) - 1
        b = min(max(b, a + 1), n)
        full = np.flatnonzero(count[a:b]) + a
        if len(full):
            h = hashes[first[a] : first[b]]
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[full] = np.add.reduceat(bits, first[full] - first[a], axis=0, dtype=np.int32)
        a = b
    flags = ones * 2 > count[:, None]
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def simhash64(column: pa.Array, width: int = 3) -> np.ndarray:
    """Fingerprints over the XXH64 (seed 42) of the ``width``-word shingles, repeats included."""
    words = kernels.split_words(column)
    start, length, first = kernels.shingles(words, width)
    return majority(kernels.xxh64(words.buffer, start, length), first)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long. Null text is the empty text, with fingerprint 0."""

    def run(reader):
        for batch in kernels.batches(reader, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(simhash64(batch.column("text"), width).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def plan_tree(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int]]:
    """(vantage point, radius) of each level of the top tree: the sampled points that split the sample best."""
    rng = np.random.default_rng(seed)
    levels: list[tuple[int, int]] = []
    for _ in range(depth):
        best = None
        for point in rng.choice(sample, min(16, len(sample)), replace=False):
            d = _distance(sample, point)
            radius = int(np.median(d))
            inner = np.mean(d <= radius)
            cost = np.mean(np.abs(d - radius - 0.5) <= 3) + 2 * abs(inner - 0.5)
            if all(int(point) != p for p, _ in levels) and (best is None or cost < best[0]):
                best = (cost, int(point), radius)
        if best is None:
            break
        levels.append(best[1:])
    return levels


def assign(fp: np.ndarray, levels: list[tuple[int, int]], near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, side) of every copy that a fingerprint needs.

    Side 0 rows of a shard are compared with each other. Where a level's ball boundary lies within ``near`` of a
    fingerprint (triangle bound), a copy goes to a boundary shard: side 1 from inside, side 2 from outside, and
    only these sides are compared. Boundary shards are split by the later levels in the same way.
    """
    row, side = np.arange(len(fp)), np.zeros(len(fp), np.int8)
    shard = np.ones(len(fp), np.uint64)
    six = np.uint64(6)
    for point, radius in levels:
        d = _distance(fp[row], np.uint64(point)).astype(np.int16)
        inner = d <= radius
        # 0, 1: this side's own shard. 2: boundary of a whole shard. 3, 4: the two boundaries of a boundary shard.
        edge = np.where(inner, d > radius - near, d <= radius + near)
        moved = np.where(side[edge] == 0, 2, np.where((side[edge] == 1) == inner[edge], 3, 4)).astype(np.uint64)
        edge_side = np.where(side[edge] == 0, np.where(inner[edge], 1, 2), side[edge]).astype(np.int8)
        own = shard * six + (~inner).astype(np.uint64)
        row, shard, side = np.concatenate([row, row[edge]]), np.concatenate([own, shard[edge] * six + moved]), np.concatenate([side, edge_side])
    return row, shard, side


def _forest(fp: np.ndarray, side: np.ndarray, near: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of one shard, found with a vantage-point tree in memory.

    ``own`` (0 or 1) tells the two chunks of a shard that is too large for one task: then only pairs of different
    chunks are compared.
    """
    label = np.arange(len(fp))
    found_u: list[np.ndarray] = []
    found_v: list[np.ndarray] = []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), 1024):
            part = a[k : k + 1024]
            i, j = np.nonzero(_distance(fp[part][:, None], fp[b][None, :]) <= near)
            keep = label[part[i]] != label[b[j]]
            if keep.any():
                u, v = label[part[i[keep]]], label[b[j[keep]]]
                node, low = min_labels(u, v)
                moved = node != low
                found_u.append(node[moved])
                found_v.append(low[moved])
                change = np.arange(len(fp))
                change[node] = low
                np.copyto(label, change[label])

    if own is None:
        stack = [(np.flatnonzero(side == 0), None), (np.flatnonzero(side == 1), np.flatnonzero(side == 2))]
    else:
        stack = [(np.flatnonzero((side == x) & (own == 0)), np.flatnonzero((side == y) & (own == 1))) for x, y in ((0, 0), (1, 2), (2, 1))]
    while stack:
        a, b = stack.pop()
        if b is None:
            if len(a) < 2:
                continue
            pool = a
        else:
            if not len(a) or not len(b):
                continue
            pool = b if len(b) >= len(a) else a
        if len(a) <= LEAF or (b is not None and len(b) <= LEAF):
            compare(a, a if b is None else b)
            continue
        probe = pool[:: max(1, len(pool) // 64)]
        point = fp[probe[len(probe) // 2]]
        da = _distance(fp[a], point).astype(np.int16)
        db = None if b is None else _distance(fp[b], point).astype(np.int16)
        radius = np.median(da if db is None or len(a) > len(b) else db)
        ain, aout, aedge_in, aedge_out = _cut(a, da, radius, near)
        if b is None:
            if max(len(ain), len(aout)) > 0.95 * len(a):  # copies so close together that no ball parts them
                compare(a, a)
                continue
            stack += [(ain, None), (aout, None), (aedge_in, aedge_out)]
        else:
            bin_, bout, bedge_in, bedge_out = _cut(b, db, radius, near)
            if max(len(ain) * len(bin_), len(aout) * len(bout)) > 0.9 * len(a) * len(b):
                compare(a, b)
                continue
            stack += [(ain, bin_), (aout, bout), (aedge_in, bedge_out), (aedge_out, bedge_in)]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_u) if found_u else empty), (np.concatenate(found_v) if found_v else empty)


def _cut(at: np.ndarray, d: np.ndarray, radius: float, near: int):
    inner = d <= radius
    return at[inner], at[~inner], at[inner & (d > radius - near)], at[~inner & (d <= radius + near)]


def near_links(nodes: DataFrame, near: int = 3) -> DataFrame:
    """(u, v): links that span the groups of fingerprints within ``near`` bits.

    ``nodes`` is a written table with a distinct long ``fp`` and an ``id`` each. A fingerprint is cut into near + 1
    parts, of which two fingerprints within ``near`` bits share one; each part makes a forest of vantage-point
    trees, one for each value of as many of its bits as the number of fingerprints asks for. So the top trees
    have two levels at any size, and a fingerprint has a bounded number of copies. Where it lies within ``near`` of
    a ball's boundary, it is also sent to the shard of that boundary. Shards beyond ``HOT`` (fingerprints that
    lie so close together that no ball parts them) are cut into chunks, and chunk pairs go to different tasks.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    want = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    depth = min(want, DEPTH)
    parts = near + 1 if want > depth else 1
    bits = min(want - depth, 64 // parts)
    levels: list[tuple[int, int]] = []
    if depth:
        sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()
        levels = plan_tree(sample.fp.to_numpy().view(np.uint64), depth)

    def place(reader):
        for batch in kernels.lean(reader):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            row, ball, side = assign(fp, levels, near)
            for p in range(parts):
                tree = (fp[row] >> np.uint64(p * (64 // parts))) & np.uint64((1 << bits) - 1)
                shard = ((tree * np.uint64(parts) + np.uint64(p)) << np.uint64(8)) | ball
                yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(side), pa.array(fp[row].view(np.int64)), batch.column("id").take(pa.array(row))], ["shard", "side", "fp", "id"])

    def links(reader):
        for t in runs(reader, ["shard", "a", "b"]):
            if len(t) < 2:
                continue
            a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
            ids = t.column("id").to_numpy()
            own = None if a == b else (t.column("own").to_numpy() == b).astype(np.int8)
            u, v = _forest(t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy(), near, own)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    placed = nodes.select("fp", "id").mapInArrow(place, "shard long, side byte, fp long, id long")
    hot = materialize(placed.groupBy("shard").count().where(F.col("count") > HOT).select("shard", F.ceil(F.col("count") / (HOT // 2)).cast("int").alias("chunks")), "simhash-hot", rows=n)
    chunked = placed.join(hot, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    dealt = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    dealt = dealt.select("shard", "a", "b", "own", "side", "fp", "id").repartition(shuffle_width(spark), "shard", "a", "b").sortWithinPartitions("shard", "a", "b")
    out = materialize(dealt.mapInArrow(links, "u long, v long"), "simhash-links")
    discard(hot)
    return out


def near_groups(prints: DataFrame, near: int = 3) -> DataFrame:
    """(fp, component) for each distinct fingerprint; component is the smallest id reachable over links.

    ``prints`` has id and fp. Documents with equal fingerprints are one node, represented by their smallest id;
    rows without id are nodes among themselves, with a component only where an id is near.
    """
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = materialize(nodes.select("fp", "least", F.monotonically_increasing_id().alias("id")), "simhash-nodes")
    groups = connected_components(near_links(nodes, near))
    whole = materialize(nodes.join(groups, nodes.id == groups.node, "left").select("fp", "least", F.coalesce("component", "id").alias("group")), "simhash-groups")
    least = whole.groupBy("group").agg(F.min("least").alias("component"))
    return whole.join(least, "group").select("fp", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, near: int = 3) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    A link joins fingerprints that differ in at most ``near`` bits. Null and empty texts have fingerprint zero and
    are linked like others. Repeated ids keep one row each; a null id stays a row with its own fingerprint and the
    component of the non-null ids near it. An empty table gives no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    out = prints.join(near_groups(prints, near), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprints and near-duplicate groups of all documents."""
    return simhash_dedup(table(spark, sf_dir, "documents"))
