"""Near-duplicate documents: five-word fingerprints in vantage-point trees, completed by min-hash bands, verified exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels, simhash
from tidewire.llm.components import connected_components
from tidewire.llm.grouping import runs
from tidewire.llm.session import discard, free_names, materialize, row_key, shuffle_width

#: Min-hashes of a band, and bands: a pair at 0.8 shares no band with a chance of (1 - 0.8**4)**20 = 2.6e-5.
ROWS, BANDS = 4, 20
#: A bucket is cut into chunks of about so many texts and shingles, and chunk pairs are compared by different tasks.
CHUNK, CHUNK_SHINGLES = 512, 1 << 17
_GROUP = ["band", "bucket", "a", "b"]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hashes, first, sets): XXH64 of all shingles of a batch, and the distinct ones of each text, ascending."""
    words = kernels.split_words(column)
    start, length, first = kernels.shingles(words, width)
    hashes = kernels.xxh64(words.buffer, start, length)
    return hashes, first, [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, BANDS) buckets: each is 16 bits of ROWS min-hashes side by side; 0 if there is no shingle."""
    g = np.random.default_rng(17)
    out = np.zeros((len(first) - 1, ROWS * BANDS), np.uint16)
    full = np.flatnonzero(np.diff(first))
    for k in range(ROWS * BANDS):
        flip, factor = g.integers(0, 1 << 63, 2, dtype=np.uint64)
        if len(full):
            mixed = (hashes ^ flip) * (factor * np.uint64(2) + np.uint64(1))
            least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), first[full])
            out[full, k] = (least * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    return out.view(np.int64)


def _marks(texts: DataFrame, width: int) -> DataFrame:
    """(k1, k2, key, n, fp, bands): key is a digest of the set of shingles, n their number, fp their fingerprint."""

    def run(reader):
        for batch in kernels.batches(reader, "text", 2 << 20):
            hashes, first, sets = shingle_sets(batch.column("text"), width)
            bands = [b if len(s) else [] for b, s in zip(band_keys(hashes, first), sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(simhash.majority(hashes, first).view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["k1", "k2", "key", "n", "fp", "bands"],
            )

    return texts.mapInArrow(run, "k1 long, k2 long, key binary, n int, fp long, bands array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct shingles as bytes of ascending hashes."""

    def run(reader):
        for batch in kernels.batches(reader, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), width)[2]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of ``least`` or more; exact."""

    def run(reader):
        for batch in kernels.lean(reader):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(x) + len(y)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    good.append(False)
                    continue
                z = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((z[1:] == z[:-1]).sum())
                good.append(shared >= least * (both - shared))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    # v is nearly unique; many v may have the same u, whose partitions the planner splits
    wide = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
    return materialize(wide.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "similar-links")


def spanning_links(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links between ``left`` and ``right`` (positions in ``sets``) that join the components in ``label``.

    Each pair of different components is compared exactly, by counting the marked shingles of all candidates at
    once. Of several links between two components one is returned.
    """
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    vocabulary, term = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    marked = np.zeros(len(vocabulary), bool)
    label = np.unique(label, return_inverse=True)[1]
    us, vs = [], []
    for i in left.tolist():
        j = right[(label[right] != label[i]) & (np.minimum(size[right], size[i]) >= least * np.maximum(size[right], size[i]))]
        if not len(j):
            continue
        at = np.cumsum(size[j]) - size[j]
        own = term[first[i] : first[i + 1]]
        marked[own] = True
        shared = np.add.reduceat(marked[term[np.arange(size[j].sum()) + np.repeat(first[j] - at, size[j])]], at, dtype=np.int64)
        marked[own] = False
        for k in j[shared >= least * (size[i] + size[j] - shared)].tolist():
            if label[k] != label[i]:
                us.append(i)
                vs.append(k)
                label[label == label[k]] = label[i]
    return us, vs


def _mixed_links(rows: DataFrame, least: float) -> DataFrame:
    """Links in buckets that hold several components; never more than one for each text and chunk pair."""
    spark = rows.sparkSession
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    dealt = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    dealt = dealt.select(*_GROUP, "own", "node", "component", "shingles").repartition(shuffle_width(spark), *_GROUP).sortWithinPartitions(*_GROUP)

    def run(reader):
        for t in runs(reader, _GROUP):
            if len(t) < 2:
                continue
            a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
            nodes, component, own = (t.column(c).to_numpy() for c in ("node", "component", "own"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles")]
            left = np.arange(len(t)) if a == b else np.flatnonzero(own == a)
            u, v = spanning_links(sets, component, left, left if a == b else np.flatnonzero(own == b), least)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

    return materialize(dealt.mapInArrow(run, "u long, v long"), "similar-mixed")


def _grouped(docs: DataFrame, least: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, component): one row for each id and text; component numbers the group."""
    k1, k2 = row_key(id_col, text_col)
    texts = docs.where(F.col(id_col).isNotNull()).select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    marks = materialize(_marks(texts, width), "similar-marks")
    nodes = marks.groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("of"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "of.*", "n", "fp", "bands"), "similar-nodes")
    n = nodes.count()
    # candidates: neighbours by fingerprint, and each text with the first one of its buckets
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("id")), "similar-prints", rows=n)
    near = simhash.near_links(prints)
    same = nodes.select("fp", "node").join(prints, "fp").select(F.col("id").alias("u"), F.col("node").alias("v"))
    bands = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    heads = materialize(bands.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").select("band", "bucket", "head"), "similar-heads", rows=BANDS * n // 2)
    shared = materialize(bands.join(heads, ["band", "bucket"]), "similar-bands", rows=BANDS * n)
    stars = shared.select(F.col("head").alias("u"), F.col("node").alias("v"))
    pairs = materialize(near.union(same).union(stars).where("u <> v").distinct(), "similar-pairs", rows=BANDS * n)
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", "k1", "k2")
    sets = materialize(_sets(texts.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("node", "text"), width), "similar-sets")
    links = _verified(pairs, sets, least)
    # buckets that still hold several components are compared whole
    parts = connected_components(links)
    placed = materialize(shared.join(parts, "node", "left").select("band", "bucket", "node", "n", F.coalesce("component", "node").alias("component")), "similar-placed", rows=BANDS * n)
    mixed = placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.sum("n").alias("weight")).where("low <> high").select("band", "bucket", "size", "weight")
    mixed = materialize(mixed, "similar-buckets", rows=BANDS * n // 2)
    rest = _mixed_links(placed.join(mixed, ["band", "bucket"]).join(sets, "node"), least)
    groups = connected_components(links.union(rest))
    named = nodes.join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    out = materialize(marks.select("k1", "k2", "key").distinct().join(named, "key").select("k1", "k2", "component"), "similar-groups")
    discard(marks, nodes, prints, heads, shared, pairs, sets, links, placed, mixed, rest)
    return out


def similar_groups(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of each different id and text; component_id is the smallest id reachable over links.

    A link joins texts whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more; texts
    without words are alike. Candidates are neighbours in the vantage-point trees of the fingerprints, and texts
    that share a band of min-hashes, because a pair at 0.8 differs by about ten bits, where balls prune nothing.
    Every link is verified on the whole sets. Rows without id are left out.
    """
    groups = _grouped(docs, least, width, id_col, text_col)
    least_id = groups.groupBy("component").agg(F.min("k1").alias("component_id"))
    return groups.join(least_id, "component").select(F.col("k1").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each group of near-duplicates (see ``similar_groups``).

    The one with the smallest id stays; of several texts under that id one. Rows with the same id and text are one
    document, of which one row stays. Other documents under an id that goes stay if they are not near. Rows
    without id stay. An empty table gives no rows; all columns stay, whatever their names.
    """
    groups = _grouped(docs, least, width, id_col, text_col)
    kept = groups.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("of")).select("of.*")
    a, b = free_names(docs, "k1", "k2")
    k1, k2 = row_key(id_col, text_col)
    once = docs.where(F.col(id_col).isNotNull()).withColumns({a: k1, b: k2}).dropDuplicates([a, b])
    stay = once.join(kept.withColumnsRenamed({"k1": a, "k2": b}), [a, b], "left_semi").select(*docs.columns)
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
