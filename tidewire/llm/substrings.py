"""Removal of repeated byte strings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import kernels
from tidewire.llm.grouping import runs
from tidewire.llm.session import free_names, materialize, row_key, shuffle_width, table

#: Bytes of an anchor: a string that is chosen by its content only.
ANCHOR = 64
#: Contexts that make a batch of the index.
BATCH = 512
#: Contexts under one key that a task takes; those of a key with more are dealt anew by what stands around the anchor.
HOT = 2048
#: Parts of the strings over an anchor, by their place, when a key is dealt anew.
PARTS = 8
#: Anchors of one content that a batch of texts hands on; the others are decided at once.
REPS = 3
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_SYMBOL = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any span of a buffer."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.down = _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOL[raw] * _powers(_BASE, max(n, 1))[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Of all spans of this width, by start."""
        return _mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _thinned(at: np.ndarray, doc: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Which anchors are enough: of equal ones in a document that follow each other closely (periodic text) only so
    many that each string that holds one of them still holds one that is kept."""
    order = np.lexsort((at, value, doc))
    a, d, v = at[order], doc[order], value[order]
    close = (d[1:] == d[:-1]) & (v[1:] == v[:-1]) & (a[1:] - a[:-1] <= width)
    keep = np.ones(len(at), bool)
    edge = np.diff(np.concatenate([[0], close.astype(np.int8), [0]]))
    for first, last in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        run = a[first : last + 1]
        keep[order[first + 1 : last]] = False
        i = 0
        while i < len(run) - 1:
            i = max(i + 1, int(np.searchsorted(run, run[i] + width, side="right")) - 1)
            keep[order[first + i]] = True
    return keep


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(position, document, anchor hash, context start, context end, context hash) of the anchors of all texts.

    Each string of ``length`` bytes holds its smallest ``ANCHOR``-byte string by hash, so equal strings hold an
    equal anchor at an equal place; in periodic text, one of a few. The context of an anchor is all that such strings
    around it can cover.
    """
    none = tuple(np.zeros(0, np.uint64 if c in (2, 5) else np.int64) for c in range(6))
    if len(raw) < length:
        return none
    width = length - ANCHOR + 1
    rolling = Rolling(raw)
    exact = rolling.every(ANCHOR)
    order = np.maximum((exact >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    low = _sliding(np.minimum, order, width)  # by start of the string of ``length`` bytes
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(raw))  # bytes up to the end of the document
    low = np.where(left[: len(low)] >= length, low, np.uint32(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint32), low, np.zeros(width - 1, np.uint32)])
    most = _sliding(np.maximum, padded, width)[: len(order)]
    at = np.flatnonzero(most == order)
    if not len(at):
        return none
    doc = np.searchsorted(offsets, at, side="right") - 1
    thin = _thinned(at, doc, exact[at], width)
    at, doc = at[thin], doc[thin]
    start = np.maximum(offsets[doc], at - (length - ANCHOR))
    end = np.minimum(offsets[doc + 1], at + length)
    context = _mix(rolling.spans(start, end) ^ _mix((at - start).astype(np.uint64) << np.uint64(20) ^ (end - at).astype(np.uint64)))
    return at, doc, exact[at], start, end, context


def suffix_array(raw: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the strings of ``length`` bytes at ``start`` in lexicographic order, and which of them, in this
    order, differ from the one before.

    By prefix doubling: the rank of 8 bytes is that of a number, and the ranks of twice as many bytes follow from
    two ranks side by side, up to ``length``. Ranks are exact, so equal strings, and no others, have equal ranks.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(length + 8, np.uint8)])
    key = np.ndarray((n + length,), ">u8", padded, 0, (1,)).astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key)
        there = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], there[1:] != there[:-1]]), dtype=np.uint64)
        if 2 * width > length:
            break
        rank = np.concatenate([rank, np.zeros(width, np.uint64)])
        key = rank[: n + length] << np.uint64(32) | rank[width : width + n + length]
        width *= 2
    whole = rank[start] << np.uint64(32) | rank[start + (length - width)]
    order = np.argsort(whole, kind="stable")
    return order, np.concatenate([np.ones(min(1, len(order)), bool), whole[order][1:] != whole[order][:-1]])


class SuffixLevels:
    """Suffix arrays of geometrically growing sizes over the strings around one or more anchors.

    A suffix array holds the strings of ``length`` bytes of its contexts, one of equal ones, in lexicographic
    order; beyond ``length`` nothing has to be found. A new batch gets a suffix array of its own and is
    merge-scanned against each level, bytes against bytes. Levels of equal size are merged.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.levels: list[np.ndarray] = []  # strings in order
        self.start = np.zeros(0, np.int64)  # of each string in ``raw``
        self.repeated = np.zeros(0, bool)
        self.raw = np.zeros(0, np.uint8)

    def _bytes(self, refs: np.ndarray) -> np.ndarray:
        if not len(refs):
            return np.zeros(0, f"S{self.length}")
        return self.raw[self.start[refs][:, None] + np.arange(self.length)].view(f"S{self.length}").reshape(-1)

    def add(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Add contexts; returns the index of the first string of each, and one more."""
        base, strings = len(self.raw), len(self.start)
        per = np.maximum(np.diff(offsets) - self.length + 1, 0)
        first = np.concatenate([[0], np.cumsum(per)])
        start = np.arange(first[-1]) + np.repeat(offsets[:-1] - first[:-1], per)
        self.raw = np.concatenate([self.raw, raw])
        self.start = np.concatenate([self.start, start + base])
        self.repeated = np.concatenate([self.repeated, np.zeros(len(start), bool)])
        order, new = suffix_array(raw, start, self.length)
        refs = order + strings
        self.repeated[refs[1:][~new[1:]]] = True
        self.repeated[refs[:-1][~new[1:]]] = True
        refs = refs[new]
        if self.levels:
            own = self._bytes(refs)
            for level in self.levels:
                there = self._bytes(level)
                k = np.minimum(np.searchsorted(there, own), len(there) - 1)
                hit = there[k] == own
                self.repeated[level[k[hit]]] = True
                self.repeated[refs[hit]] = True
        if len(refs):
            self.levels.append(refs)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            small, large = sorted([self.levels.pop(), self.levels.pop()], key=len)
            a, b = self._bytes(large), self._bytes(small)
            k = np.searchsorted(a, b)
            more = a[np.minimum(k, len(a) - 1)] != b
            self.levels.append(np.insert(large, k[more], small[more]))
        return first + strings


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(k1, k2, spans) of the rows that hold a string of ``length`` bytes that starts elsewhere too.

    ``docs`` has a text, a long k1 and an int k2 that are equal for the same row only. Steps: anchors of each text, chosen by
    content, are shuffled as hashes; where an anchor has company, the same whole context elsewhere (128 bits in
    hashes of the anchor and of the context) decides for all its strings, and other contexts are sent to the
    anchor's task, which compares all their strings in the suffix arrays. A batch of texts decides for anchors that
    it holds several times and hands on ``REPS`` of them, so one passage in very many documents does not load one
    task. Contexts of an anchor with more than ``HOT`` are dealt anew by what stands around it.
    """
    spark = docs.sparkSession
    wide = shuffle_width(spark)
    texts = docs.select("k1", "k2", "text")

    def find(reader):
        for batch in kernels.batches(reader, "text", 2 << 20):
            raw, offsets = kernels.as_bytes(batch.column("text"))
            at, doc, h, start, _, g = anchors(raw, offsets, length)
            order = np.lexsort((g, h))
            at, doc, h, g = at[order], doc[order], h[order], g[order]
            n = len(at)
            new_h = np.concatenate([[True], h[1:] != h[:-1]]) if n else np.zeros(0, bool)
            new_g = new_h | np.concatenate([[True], g[1:] != g[:-1]]) if n else new_h
            count = lambda new: np.diff(np.concatenate([np.flatnonzero(new), [n]]))[np.cumsum(new) - 1]
            full = count(new_g) > 1 if n else new_h
            several = np.add.reduceat(new_g.astype(int), np.flatnonzero(new_h))[np.cumsum(new_h) - 1] > 1 if n else new_h  # contexts of the anchor
            rank = np.cumsum(new_g)  # of the context within its anchor
            rank = rank - rank[np.maximum.accumulate(np.where(new_h, np.arange(n), 0))] if n else rank
            sent = new_g & (rank < REPS)
            k1, k2 = batch.column("k1").to_numpy()[doc], batch.column("k2").to_numpy()[doc].astype(np.int64)
            state = (2 * full + (several & new_g)).astype(np.int64)
            deal = np.where(sent, h, _mix(k1.view(np.uint64))).view(np.int64)
            place = _packed(k2, at - offsets[doc], state)
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(g.view(np.int64)), pa.array(sent), pa.array(k1), pa.array(place)], ["deal", "g", "sent", "k1", "place"])

    found = texts.mapInArrow(find, "deal long, g long, sent boolean, k1 long, place long")
    found = found.repartition(wide, "deal").sortWithinPartitions("sent", "deal", "g")

    def decide(reader):
        """Rows with company; state tells ``full`` (2) if the same context is elsewhere, ``ship`` (1) for one row of each of several contexts."""
        held = last = None  # the row that waits for its next one; the first row of its anchor and the row before it
        for batch in kernels.lean(reader):
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "g", "sent", "k1", "place")]
            cols = cols if held is None else [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            out, last = _decided(cols, last, False)
            yield out
            held = [c[-1:] for c in cols]
        if held is not None:
            yield _decided(held, last, True)[0]

    candidates = found.mapInArrow(decide, "k1 long, k2 int, place long")
    places = candidates.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))

    def cut(reader):
        for batch in kernels.batches(reader, "text", 4 << 20):
            raw, offsets = kernels.as_bytes(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            lists = batch.column("places")
            pos, state = _unpacked(lists.flatten().to_numpy())[1:]
            doc = np.repeat(np.arange(len(k1)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((pos, doc))
            doc, pos, state = doc[order], pos[order], state[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])) if len(doc) else np.zeros(0, int)
            doc, pos, state = doc[new], pos[new], np.bitwise_or.reduceat(state, new) if len(new) else state
            full, ship = state >= 2, state % 2 == 1
            start = np.maximum(offsets[doc], offsets[doc] + pos - (length - ANCHOR))
            end = np.minimum(offsets[doc + 1], offsets[doc] + pos + length)
            covered = np.zeros(len(raw) + 1, np.int32)
            np.add.at(covered, start[full], 1)
            np.add.at(covered, end[full], -1)
            covered = np.cumsum(covered[:-1]) > 0
            part = np.flatnonzero(ship)
            edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            inner = np.isin(np.arange(1, len(raw)), offsets) & covered[1:] & covered[:-1] if len(raw) > 1 else np.zeros(0, bool)
            breaks = np.flatnonzero(inner) + 1  # a run doesn't go on in the next document
            a, b = np.sort(np.concatenate([np.flatnonzero(edge == 1), breaks])), np.sort(np.concatenate([np.flatnonzero(edge == -1), breaks]))
            owner = np.searchsorted(offsets, a, side="right") - 1
            exact = Rolling(raw).spans(offsets[doc[part]] + pos[part], offsets[doc[part]] + pos[part] + ANCHOR) if len(part) else np.zeros(0, np.uint64)
            text = raw.tobytes()
            both = np.concatenate([owner, doc[part]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k1[both]),
                    pa.array(k2[both]),
                    pa.array(np.concatenate([a - offsets[owner], start[part] - offsets[doc[part]]])),
                    pa.array(np.concatenate([b - offsets[owner], end[part] - offsets[doc[part]]])),
                    pa.array(np.concatenate([np.zeros(len(a), np.int64), exact.view(np.int64)])),
                    pa.array(np.concatenate([np.zeros(len(a), np.int32), (offsets[doc[part]] + pos[part] - start[part]).astype(np.int32)])),
                    pa.array([None] * len(a) + [text[x:y] for x, y in zip(start[part].tolist(), end[part].tolist(), strict=True)], pa.binary()),
                ],
                ["k1", "k2", "start", "end", "anchor", "inset", "context"],
            )

    cuts = materialize(texts.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInArrow(cut, "k1 long, k2 int, start long, end long, anchor long, inset int, context binary"), "contexts")
    contexts = cuts.where("context is not null").select("anchor", "k1", "k2", "start", "inset", "context")
    matched = _matched(contexts, length)
    spans = cuts.where("context is null").select("k1", "k2", "start", "end").union(matched)
    return spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _matched(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, end) of what repeats within the contexts of an anchor."""
    wide = shuffle_width(contexts.sparkSession)

    def match(reader):
        for group in _batched(runs(reader, ["anchor"])):
            group, begins = _once(group, length)
            levels = SuffixLevels(length)
            firsts = []
            for k in range(0, len(group), BATCH):
                raw, offsets = kernels.as_bytes(group.column("context").slice(k, BATCH))
                firsts.append(levels.add(raw, offsets))
            starts = np.concatenate([f[:-1] for f in firsts])
            hits = np.flatnonzero(levels.repeated)
            if not len(hits):
                continue
            owner = np.searchsorted(starts, hits, side="right") - 1
            new = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(owner) != 0)])
            close = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hits) - 1]])
            own = owner[new]
            a = begins[own] + hits[new] - starts[own]
            b = begins[own] + hits[close] - starts[own] + length
            yield pa.RecordBatch.from_arrays([*(pa.array(group.column(c).to_numpy()[own]) for c in ("k1", "k2")), pa.array(a), pa.array(b)], ["k1", "k2", "start", "end"])

    def part(reader):
        """The strings over an anchor in ``PARTS``; the key of a part is all that its strings have in common."""
        step = -(-(length - ANCHOR + 1) // PARTS)
        for batch in kernels.lean(reader):
            inset = batch.column("inset").to_numpy()
            rows, keys, starts, texts = [], [], [], []
            for i, (text, at, anchor) in enumerate(zip(batch.column("context").to_pylist(), inset.tolist(), batch.column("anchor").to_pylist(), strict=True)):
                for p in range(PARTS):
                    # strings that begin from ``most`` to ``least`` bytes before the anchor
                    least, most = p * step, min((p + 1) * step, length - ANCHOR + 1) - 1
                    least_at, most_at = at - min(most, at), min(at - least, len(text) - length)
                    if most_at < least_at:
                        continue  # no such string in this context
                    core = text[at - least : at - most + length]
                    keys.append(hashlib.blake2b(core, digest_size=8, key=anchor.to_bytes(8, "little", signed=True), person=bytes([p])).digest())
                    rows.append(i)
                    starts.append(least_at)
                    texts.append(text[least_at : most_at + length])
            chosen = pa.array(rows, pa.int64())
            k = np.frombuffer(b"".join(keys), np.int64)
            start = batch.column("start").to_numpy()[rows] + np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), *(batch.column(c).take(chosen) for c in ("k1", "k2")), pa.array(start), pa.array(texts, pa.binary())], ["anchor", "k1", "k2", "start", "context"])

    def single(reader):
        """Each string of ``length`` bytes by itself, as a digest."""
        for batch in kernels.lean(reader):
            rows, keys, starts = [], [], []
            for i, text in enumerate(batch.column("context").to_pylist()):
                for k in range(len(text) - length + 1):
                    rows.append(i)
                    starts.append(k)
                    keys.append(hashlib.blake2b(text[k : k + length], digest_size=16).digest())
            chosen = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(batch.column(c).take(chosen) for c in ("k1", "k2")), pa.array(batch.column("start").to_numpy()[rows] + np.array(starts, np.int64))], ["digest", "k1", "k2", "start"])

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.select("anchor", "k1", "k2", "start", "context")
        return rows.repartition(wide, "anchor").sortWithinPartitions("anchor").mapInArrow(match, "k1 long, k2 int, start long, end long")

    crowd = lambda rows, least, name: materialize(rows.groupBy("anchor").count().where(F.col("count") >= least).select("anchor", (F.col("count") > HOT).alias("hot")), name, rows=rows.count() // least)
    hot = crowd(contexts, HOT + 1, "hot-anchors").select("anchor")
    out = dealt(contexts.join(hot, "anchor", "left_anti"))
    if hot.isEmpty():
        return out
    anew = materialize(contexts.join(hot, "anchor").mapInArrow(part, "anchor long, k1 long, k2 int, start long, context binary"), "parts")
    again = crowd(anew, 2, "hot-parts")
    with_company = anew.join(again, "anchor")
    ones = with_company.where("hot").select("k1", "k2", "start", "context").mapInArrow(single, "digest binary, k1 long, k2 int, start long")
    ones = materialize(ones, "single-strings")
    # written, so that the planner can split the rows of a very common one
    twice = materialize(ones.distinct().groupBy("digest").count().where("count > 1").select("digest"), "repeated-strings")
    alone = ones.join(twice, "digest", "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    return out.union(dealt(with_company.where("not hot"))).union(alone)


def _packed(k2: np.ndarray, pos: np.ndarray, state: np.ndarray) -> np.ndarray:
    """30 bits of the key, the place of the anchor in its text, and its state, in one number."""
    return k2 << 33 | pos << 2 | state


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 33, place >> 2 & ((1 << 31) - 1), place & 3


def _decided(cols: list[np.ndarray], last: tuple | None, final: bool) -> tuple[pa.RecordBatch, tuple]:
    """Candidates among all rows but the last, which waits for its next one unless ``final``.

    ``last`` is (row before the first one here, first row of its anchor).
    """
    deal, g, sent, key, place = cols
    second, pos, state = _unpacked(place)
    n = len(deal)
    same, twin = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # as the row before
    same[1:n] = (deal[1:] == deal[:-1]) & sent[1:] & sent[:-1]
    twin[1:n] = same[1:n] & (g[1:] == g[:-1])
    if last is not None:
        before, _ = last
        same[0] = before[0] == deal[0] and before[2] and sent[0]
        twin[0] = same[0] and before[1] == g[0]
    full = (state >= 2) | twin[:-1] | twin[1:]
    other = same[:-1] & ~twin[:-1]  # another context of the same anchor begins
    ship = (sent & other) | (state % 2 == 1)
    # rows that aren't sent are decided by their batch
    keep = full | ship
    first = np.maximum.accumulate(np.where(~same[:-1], np.arange(n), -1))
    lead = first[other]  # -1: before this batch
    leads = [(key[i], place[i]) if i >= 0 else last[1][3:] for i in lead.tolist()]
    if not final:
        keep[-1] = False
    head = tuple(c[first[-2]] if first[-2] >= 0 else last[1][k] for k, c in enumerate(cols)) if n > 1 else (last[1] if last is not None else None)
    after = (tuple(c[-2] for c in cols), head) if n > 1 else last
    lead_second, lead_pos, _ = _unpacked(np.array([x[1] for x in leads], np.int64))
    now = 2 * full + ship
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key[keep], np.array([x[0] for x in leads], np.int64)])),
            pa.array(np.concatenate([second[keep], lead_second]).astype(np.int32)),
            pa.array(np.concatenate([_packed(second[keep], pos[keep], now[keep]), _packed(lead_second, lead_pos, 1)])),
        ],
        ["k1", "k2", "place"],
    ), after


def _once(group: pa.Table, length: int) -> tuple[pa.Table, np.ndarray]:
    """Contexts in the order of texts and places, without strings that the context before holds at the same place."""
    size = np.diff(kernels.as_bytes(group.column("context"))[1])
    order = np.lexsort((size, *(group.column(c).to_numpy() for c in ("start", "k2", "k1"))))
    group = group.take(pa.array(order)).combine_chunks()
    k1, k2, start = (group.column(c).to_numpy() for c in ("k1", "k2", "start"))
    last = start + size[order] - length
    # the furthest string of this text so far
    text = np.cumsum(np.concatenate([[False], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    reach = np.maximum.accumulate(last + text * (1 << 32)) - text * (1 << 32)
    begin = start.copy()
    begin[1:] = np.where(text[1:] == text[:-1], np.maximum(start[1:], reach[:-1] + 1), start[1:])
    keep = begin <= last
    if keep.all() and (begin == start).all():
        return group, begin
    cut = [c[x:] for c, x in zip(group.column("context").to_pylist(), (begin - start).tolist(), strict=True)]
    group = group.set_column(group.schema.get_field_index("context"), "context", pa.array(cut, pa.binary()))
    return group.filter(pa.array(keep)).combine_chunks(), begin[keep]


def _batched(groups):
    """Small groups together, so that a suffix array is worth its overhead; a large group stays alone."""
    held: list[pa.Table] = []
    size = 0
    for group in groups:
        if len(group) < 2:
            continue
        if size + len(group) > BATCH and held:
            yield pa.concat_tables(held).combine_chunks()
            held, size = [], 0
        held.append(group)
        size += len(group)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = s["start"], s["end"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with one more column, the spans that go (null: none), and its name."""
    a, b, spans = free_names(docs, "k1", "k2", "spans")
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.withColumns({a: k1, b: F.shiftrightunsigned(k2, 34).cast("int")})
    found = repeated_spans(keyed.select(F.col(a).alias("k1"), F.col(b).alias("k2"), F.col(text_col).alias("text")), length)
    return keyed.join(found.withColumnsRenamed({"k1": a, "k2": b, "spans": spans}), [a, b], "left").drop(a, b), spans


def digest_kept(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that are left.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in the rows, the same text
    included. Null is the empty text; texts below ``length`` bytes keep all. Repeated rows are copies of each
    other; a null id stays null. An empty table gives no rows; other columns are ignored.
    """
    rows, column = _with_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), length, "id", "text")

    def run(reader):
        for batch in kernels.batches(reader, "text", 4 << 20):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = _merged(spans or [])
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c)) for c in zip(*out, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = rows.select("id", "text", F.col(column).alias("spans")).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of the text; a cut character is kept whole.

    Texts without repeats, nulls among them, and all other columns stay as they are.
    """
    rows, spans = _with_spans(docs, length, id_col, text_col)

    @F.pandas_udf(T.StringType())
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            if t is None or found is None:
                out.append(t)
                continue
            raw, at, parts = t.encode(), 0, []
            for a, b in _merged(list(found)):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out)

    text = F.col(text_col)
    return rows.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(kept(text, F.col(spans)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: repeated 200-byte strings of all documents."""
    return digest_kept(table(spark, sf_dir, "documents"))
