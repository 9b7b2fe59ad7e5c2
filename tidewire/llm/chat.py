"""Chat formatting: conversations merged into prefix trees."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels
from tidewire.llm.session import materialize, shuffle_width, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_RAW = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: each ``<|`` gets a backslash between, and one more where backslashes stand already."""
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of what an assistant is trained on)."""
    head = f"{OPEN}{_escape_role(role)}\n"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{CLOSE}\n", *loss


class _Node(NamedTuple):
    """A turn on the open path of a partition; places count from the partition's own start."""

    turn: tuple[str, str]
    start: int
    length: int
    opening: bool  # on the path of the partition's first conversation
    lead: int  # how many of its ancestors are
    lead_length: int  # and their length
    position: int
    spans: tuple[tuple[int, int], ...]  # its other ancestors, neighbours as one interval
    number: int


def _merged(spans) -> list[tuple[int, int]]:
    """Intervals in ascending order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out


def _written(reader):
    """Depth-first rows of one partition: a node for each turn that the conversation before doesn't share, a leaf for
    each conversation, and at the end the path that is open there."""
    part = TaskContext.get().partitionId()
    way: list[_Node] = []
    size = count = 0
    rows: list[dict] = []
    for batch in kernels.lean(reader):
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            pairs = [(t["role"], t["text"]) for t in turns]
            shared = 0
            while shared < min(len(way), len(pairs)) and way[shared].turn == pairs[shared]:
                shared += 1
            opening = not count
            del way[shared:]
            for turn in pairs[shared:]:
                text, a, b = format_turn(*turn)
                up = way[-1] if way else None
                if up is None:
                    lead, lead_length, spans, position = 0, 0, (), 0
                elif up.opening:
                    lead, lead_length, spans, position = up.lead + 1, up.lead_length + up.length, (), up.position + up.length
                else:
                    lead, lead_length, spans, position = up.lead, up.lead_length, tuple(_merged([*up.spans, (up.start, up.start + up.length)])), up.position + up.length
                node = _Node(turn, size, len(text), opening, lead, lead_length, position, spans, count)
                rows.append({"part": part, "kind": 0, "depth": len(way), "opening": opening, "start": size, "length": len(text), "lead": lead, "lead_length": lead_length, "position": position, "spans": [{"start": x, "end": y} for x, y in spans], "text": text, "loss_start": a, "loss_end": b})
                way.append(node)
                size += len(text)
                count += 1
            rows.append({"part": part, "kind": 1, "conv_id": conv, "depth": len(way) - 1, "opening": way[-1].opening, "start": way[-1].start})
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, _ROW)
                rows = []
    if count:
        for depth, node in enumerate(way):
            digest = hashlib.blake2b(repr(node.turn).encode(), digest_size=16).digest()
            rows.append({"part": part, "kind": 2, "depth": depth, "opening": node.opening, "start": node.start, "length": node.length, "digest": digest})
        rows.append({"part": part, "kind": 3, "depth": 0, "length": size})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ROW)


class _Join(NamedTuple):
    """How a partition goes on from those before it."""

    shared: int  # turns of its first conversation that are written already
    shared_length: int
    base: int  # place of its first other turn
    path: list[tuple[int, int]]  # start and end of the turns that it shares


def _joined(ends, opens) -> dict[int, _Join]:
    """Fold over the partitions in order; only a path and a size of each are needed.

    ``ends``: (part, kind, depth, opening, start, length, digest) of the last paths and sizes; ``opens``: (part, depth, length, digest) of the first
    conversations.
    """
    first: dict[int, list] = {}
    for part, depth, length, digest in sorted(opens):
        first.setdefault(part, []).append((bytes(digest), length))
    last: dict[int, list] = {}
    total = {}
    for part, kind, depth, opening, start, length, digest in sorted(ends, key=lambda r: r[:3]):
        if kind == 3:
            total[part] = length
        else:
            last.setdefault(part, []).append((bytes(digest), opening, start, length))
    out, path, base = {}, [], 0
    for part in sorted(first):
        shared = 0
        while shared < min(len(path), len(first[part])) and path[shared][0] == first[part][shared][0]:
            shared += 1
        cut = sum(n for _, n in first[part][:shared])
        out[part] = _Join(shared, cut, base, [(a, b) for _, a, b in path[:shared]])
        path = [path[k] if opening and k < shared else (digest, base + start - cut, base + start - cut + length) for k, (digest, opening, start, length) in enumerate(last[part])]
        base += total[part] - cut
    return out


def format_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, leaves, preludes) of the prefix trees of all conversations, written depth-first side by side.

    Conversations that begin with the same turns share them: a shared turn is one row of ``nodes``, whatever the
    partitions and sizes. A node has its ``start`` in the whole, which is its name; its ``tree`` (the start of the
    root), its formatted ``text`` and ``length``, its position id (where it would start in its own conversation), the
    intervals of all its ancestors, which with itself are all that it attends to, neighbours merged, and its loss
    mask within the text. Places and masks count code points. ``leaves`` has the node that each conversation ends
    with, and ``preludes`` the nodes that a part (a run of nodes that one task has written) goes on from, so that
    each part can be read by itself.
    Conversations are sorted by range over their turns, so that neither a common first turn nor many copies of a
    conversation load one task; the driver folds one path of each partition to place the parts behind each other.
    Rows of a conversation are taken by turn, then role and text; null role or text is empty; null conv_id is a
    conversation of its own; repeated rows are turns too. An empty table gives no rows; other columns are ignored.
    """
    spark = conversations.sparkSession
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    dealt = whole.withColumn("path", path).repartitionByRange(shuffle_width(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    raw = materialize(dealt.select("conv_id", "turns").mapInArrow(_written, ROWS), "chat-rows")
    ends = [tuple(r) for r in raw.where("kind > 1").select("part", "kind", "depth", "opening", "start", "length", "digest").collect()]
    opens = [tuple(r) for r in _digested(raw.where("kind = 0 and opening")).collect()]
    joins = _joined(ends, opens)

    def placed(reader):
        for batch in reader:
            out = []
            for r in batch.to_pylist():
                j = joins[r["part"]]
                if r["opening"] and r["depth"] < j.shared:
                    continue
                shift = j.base - j.shared_length
                spans = [*j.path[: r["lead"]], (j.base, shift + r["lead_length"]), *((shift + x["start"], shift + x["end"]) for x in r["spans"])]
                spans = _merged(spans)
                start = shift + r["start"]
                out.append({"part": r["part"], "tree": spans[0][0] if spans else start, "start": start, "depth": r["depth"], "length": r["length"], "position": r["position"], "spans": [{"start": x, "end": y} for x, y in spans], "text": r["text"], "loss_start": r["loss_start"], "loss_end": r["loss_end"]})
            yield pa.RecordBatch.from_pylist(out, _NODE)

    def named(reader):
        for batch in reader:
            part, depth, opening, start = (batch.column(c).to_pylist() for c in ("part", "depth", "opening", "start"))
            at = [joins[p].path[d][0] if o and d < joins[p].shared else joins[p].base - joins[p].shared_length + s for p, d, o, s in zip(part, depth, opening, start, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(at, pa.int64())], ["conv_id", "part", "start"])

    nodes = raw.where("kind = 0").select("part", "depth", "opening", "start", "length", "lead", "lead_length", "position", "spans", "text", "loss_start", "loss_end").mapInArrow(placed, NODES)
    leaves = raw.where("kind = 1").select("conv_id", "part", "depth", "opening", "start").mapInArrow(named, "conv_id long, part int, start long")
    needed = [(p, a) for p, j in joins.items() for a, _ in j.path]  # a path for each partition
    return nodes, leaves, spark.createDataFrame(needed, "part int, start long")


def _digested(rows: DataFrame) -> DataFrame:
    """(part, depth, length, digest) of turns, digests as ``_written`` takes them."""

    def run(reader):
        for batch in reader:
            out = []
            for text in batch.column("text").to_pylist():
                out.append(hashlib.blake2b(repr(_parsed(text)).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "depth", "length")), pa.array(out, pa.binary())], ["part", "depth", "length", "digest"])

    return rows.select("part", "depth", "length", "text").mapInArrow(run, "part int, depth int, length long, digest binary")


def _parsed(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, body = formatted.removeprefix(OPEN).partition("\n")
    return _unescape_role(role), unescape(body.removesuffix(f"{CLOSE}\n"))


ROWS = "part int, kind byte, conv_id long, depth int, opening boolean, start long, length long, lead int, lead_length long, position long, spans array<struct<start:long,end:long>>, text string, loss_start long, loss_end long, digest binary"
NODES = "part int, tree long, start long, depth int, length long, position long, spans array<struct<start:long,end:long>>, text string, loss_start long, loss_end long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ROW = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("opening", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("lead", pa.int32()), ("lead_length", pa.int64()), ("position", pa.int64()), ("spans", _SPANS), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("digest", pa.binary())])
_NODE = pa.schema([("part", pa.int32()), ("tree", pa.int64()), ("start", pa.int64()), ("depth", pa.int32()), ("length", pa.int64()), ("position", pa.int64()), ("spans", _SPANS), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def read_back(nodes: DataFrame, leaves: DataFrame, preludes: DataFrame) -> DataFrame:
    """Per conversation what its tree says: conv_id, n_turns, digests of turns and of the text under the loss mask.

    A part is read in the order of its nodes, behind the nodes that it goes on from. What a conversation says is the
    text of the intervals that its last node attends to.
    """
    spark = nodes.sparkSession
    facts = ["start", "depth", "spans", "text", "loss_start", "loss_end"]
    before = preludes.join(nodes.select(*facts), "start").select("part", *facts)
    ends = leaves.select("part", "start", "conv_id", F.lit(1).alias("kind"))
    rows = nodes.select("part", *facts, F.lit(0).alias("kind")).unionByName(before.withColumn("kind", F.lit(0))).unionByName(ends, allowMissingColumns=True)
    dealt = rows.select("part", "start", "kind", "conv_id", "depth", "spans", "text", "loss_start", "loss_end").repartition(shuffle_width(spark), "part").sortWithinPartitions("part", "start", "kind")

    def run(reader):
        part, path, out, said = None, [], [], None
        for batch in kernels.lean(reader):
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, path = r["part"], []
                if not r["kind"]:
                    del path[r["depth"] :]
                    path.append(r)
                    said = None
                    continue
                said = said or _facts(path)
                out.append((r["conv_id"], *said))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                out = []

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _facts(path: list[dict]) -> tuple:
    """What the last node of a path attends to, and itself, say."""
    last = path[-1]
    seen = [(x["start"], x["end"]) for x in last["spans"]]
    attended = [n for n in path[:-1] if any(a <= n["start"] < b for a, b in seen)] + [last]
    formatted = "".join(n["text"] for n in attended)
    loss = "".join(unescape(n["text"][n["loss_start"] : n["loss_end"]]) for n in attended)
    turns = [_parsed(OPEN + t) for t in formatted.split(OPEN)[1:]]
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: formats all conversations and one that is full of control strings."""
    tricky = f"{CLOSE}{OPEN}assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("turn")).select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return read_back(*format_trees(rows.unionByName(own)))


#: Each turn's digest input is its role and text; escapes add one code point for each ``<|`` in a text, backslashes between or not.
SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text) + length(regexp_extract_all(text, '<\\\\*\\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
