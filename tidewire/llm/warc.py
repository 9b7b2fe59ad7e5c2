"""Merkle fixity audit of WARC replicas; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.session import discard, materialize, table

#: Records that a leaf's range should hold at most on average.
LEAF = 32
_HEX = "0123456789abcdef"
_RECORD = ["leaf", "name", "digest"]


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, record): each page as the bytes of a WARC resource record; null url or html is empty."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def depth_for(records: int) -> int:
    """Levels below the root, each with 16 children a node; the first replica fixes them for all replicas."""
    depth = 1
    while LEAF * 16**depth < records:
        depth += 1
    return depth


def _leaf(depth: int) -> Column:
    """The range that a record belongs to: leading hex digits of a hash of its name and bytes.

    So neither a common host nor a lost or added record shifts others into another leaf.
    """
    return F.substring(F.md5(F.concat_ws("|", _name(), F.sha2("record", 256))), 1, depth)


def _name() -> Column:
    return F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url")


def stored(records: DataFrame, depth: int) -> DataFrame:
    """The records with the segment file that they are stored in: one for each leaf."""
    return records.withColumn("segment", _leaf(depth))


def manifest(replica: DataFrame, depth: int) -> DataFrame:
    """(leaf, name, digest, page_id, url, length, copies, segment, start) of a replica with page_id, url, record and segment.

    Rows with the same name and bytes are one row with a number of copies, so that a page that is stored very
    often loads no task. ``start`` is the offset in the leaf's range, in order of page_id (nulls first), url and
    digest; further copies follow the first one.
    """
    facts = replica.select(_leaf(depth).alias("leaf"), _name().alias("name"), F.sha2("record", 256).alias("digest"), "page_id", "url", F.octet_length("record").cast("long").alias("length"), "segment")
    once = facts.groupBy(*_RECORD, "page_id", "url", "length").agg(F.count("*").alias("copies"), F.min("segment").alias("segment"))
    order = Window.partitionBy("leaf").orderBy(F.col("page_id").asc_nulls_first(), "url", "digest").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("length") * F.col("copies")
    return once.withColumn("start", F.sum(size).over(order) - size)


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of a manifest's Merkle tree, the root first: (node, size, digest), each written once.

    A leaf hashes its records with their offset ranges and segments; a node hashes the sizes and digests of its up to 16
    children in order, from which their ranges follow. The root's node is the empty string.
    """
    facts = F.sort_array(F.collect_list(F.struct("start", "length", "copies", "digest", "name", "segment")))
    level = records.groupBy(F.col("leaf").alias("node")).agg(F.sum(F.col("length") * F.col("copies")).alias("size"), F.sha2(F.to_json(facts), 256).alias("digest"))
    levels = [materialize(level, "leaves")]
    for d in range(depth - 1, -1, -1):
        below = F.sort_array(F.collect_list(F.struct("node", "size", "digest")))
        level = levels[0].groupBy(F.substring("node", 1, d).alias("node")).agg(F.sum("size").alias("size"), F.sha2(F.to_json(below), 256).alias("digest"))
        levels.insert(0, materialize(level, "nodes", rows=16**d))
    return levels


def bad_leaves(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """Leaves that differ between two trees: from the roots down, only below nodes that differ."""
    bad = None
    for d, (a, b) in enumerate(zip(left, right, strict=True)):
        a, b = (x.select("node", F.col("digest").alias(n)) for x, n in ((a, "a"), (b, "b")))
        if bad is not None:
            up = bad.withColumnRenamed("node", "up")
            a, b = (x.withColumn("up", F.substring("node", 1, d - 1)).join(up, "up", "left_semi").drop("up") for x in (a, b))
        found = materialize(a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "bad-nodes", rows=2 * 16**d)
        if bad is not None:
            discard(bad)
        bad = found
    return bad.withColumnRenamed("node", "leaf")


def audit(left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """Records of two manifests that differ: (leaf, name, digest, copy, page_id, url, length, status).

    corrupt: other bytes under the same name; moved: the same bytes in another segment; missing or added: on one
    side only. A corrupt record has the digest that it has in ``left``, an added one that in ``right``. Of several
    copies, those that the other side has too are sound and the later ones differ.
    """
    trees = tree(left, depth), tree(right, depth)
    bad = bad_leaves(*trees)
    discard(*trees[0], *trees[1])
    facts = ["page_id", "url", "length"]
    a, b = (x.join(bad, "leaf", "left_semi").select(*_RECORD, *(F.col(c).alias(f"{n}_{c}") for c in (*facts, "copies", "segment"))) for x, n in ((left, "a"), (right, "b")))
    both = materialize(a.join(b, _RECORD, "full"), "pairs")
    n_a, n_b = F.coalesce("a_copies", F.lit(0)), F.coalesce("b_copies", F.lit(0))
    moved = both.where("a_segment <> b_segment").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(n_a, n_b))))
    moved = moved.select(*_RECORD, "copy", *(F.col(f"a_{c}").alias(c) for c in facts), F.lit("moved").alias("status"))
    place = Window.partitionBy("name").orderBy("digest", "copy")

    def alone(own: str, n: Column, other: Column) -> DataFrame:
        more = both.where(n > other).withColumn("copy", F.explode(F.sequence(other + 1, n)))
        return more.select(*_RECORD, "copy", *(F.col(f"{own}_{c}").alias(c) for c in facts), F.row_number().over(place).alias("nth"))

    lost, new = alone("a", n_a, n_b), alone("b", n_b, n_a)
    keys = new.select("name", "nth", F.lit(True).alias("there"))
    lost = lost.join(keys, ["name", "nth"], "left").select(*_RECORD, "copy", *facts, F.when(F.col("there"), "corrupt").otherwise("missing").alias("status"))
    keys = alone("a", n_a, n_b).select("name", "nth")
    new = new.join(keys, ["name", "nth"], "left_anti").select(*_RECORD, "copy", *facts, F.lit("added").alias("status"))
    return moved.union(lost).union(new)


def damaged(replica: DataFrame) -> DataFrame:
    """A replica that has suffered; the record's MD5 decides.

    It begins with 00: a byte is changed; 01: the end is lost; 02: the record is lost; 03: there is a copy under
    another url; 04: it stands in another segment.
    """
    mark = F.substring(F.md5("record"), 1, 2)
    size = F.octet_length("record")
    flipped = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit(b"?"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    cut = F.expr("substring(record, 1, octet_length(record) - 3)")
    marked = replica.withColumn("mark", mark)
    kept = marked.where("mark <> '02'").withColumns({"record": F.when((mark == "00") & (size > 5), flipped).when(mark == "01", cut).otherwise(F.col("record")), "segment": F.when(mark == "04", F.translate("segment", _HEX, _HEX[1:] + _HEX[0])).otherwise(F.col("segment"))})
    copies = marked.where("mark = '03'").withColumn("url", F.concat("url", F.lit("#copy")))
    return kept.unionByName(copies).drop("mark")


def audit_pages(pages: DataFrame) -> DataFrame:
    """Per record of the first replica, and per added one: page_id, url, leaf, start, length, digest and status.

    The second replica is written to the shared folder with damage and read again. ``start`` is the offset in the
    leaf's range; an added record has none. Repeated rows are copies with places of their own; null page_id and url
    are a name too. An empty table gives no rows; other columns are ignored.
    """
    records = warc_records(pages)
    depth = depth_for(pages.count())
    replica = stored(records, depth)
    first = materialize(manifest(replica, depth), "manifest")
    copy = materialize(damaged(replica), "replica")
    second = materialize(manifest(copy, depth), "manifest")
    discard(copy)
    found = materialize(audit(first, second, depth), "audit")
    discard(second)
    units = first.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    known = units.join(found.where("status <> 'added'").select(*_RECORD, "copy", "status"), [*_RECORD, "copy"], "left")
    out = known.select("page_id", "url", "leaf", (F.col("start") + (F.col("copy") - 1) * F.col("length")).alias("start"), "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    return out.union(found.where("status = 'added'").select("page_id", "url", "leaf", F.lit(None).cast("long"), "length", "digest", "status"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: audit of all pages against a damaged replica."""
    return audit_pages(table(spark, sf_dir, "pages"))


_BYTES = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
_DEPTH = "CASE " + " ".join(f"WHEN count(*) <= {LEAF * 16**d} THEN {d}" for d in range(1, 9)) + " END"
SQL = f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, {_BYTES} AS record FROM pages),
s AS (SELECT page_id, url, sha256(record) AS digest, substr(md5(record), 1, 2) AS mark, CAST(strlen(record) AS BIGINT) AS length,
             (SELECT {_DEPTH} FROM pages) AS depth FROM r),
n AS (SELECT *, substr(md5(page_id || '|' || url || '|' || digest), 1, depth) AS leaf FROM s)
SELECT page_id, url, leaf, CAST(sum(length) OVER (PARTITION BY leaf ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - length AS start, length, digest,
       CASE WHEN mark IN ('00', '01') THEN 'corrupt' WHEN mark = '02' THEN 'missing' WHEN mark = '04' THEN 'moved' ELSE 'ok' END AS status FROM n
UNION ALL
SELECT page_id, url || '#copy', substr(md5(page_id || '|' || url || '#copy|' || digest), 1, depth), NULL, length, digest, 'added' FROM s WHERE mark = '03'
"""
