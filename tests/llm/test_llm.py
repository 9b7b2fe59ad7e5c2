"""The corpus operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import bpe, chat, components, embedding, kernels, lines, packing, simhash, sketch, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " ", "one", "one two", "A b C", "a\x0bb\x1cc", "é" * 300, "x" * 5000, "　全角 spaces", "same text here again", "same text here again", "<|endoftext|> <|x|>"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(text, fold=True):
    raw = (text or "").encode()
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw) if fold else raw
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def shingle_hashes(text, width):
    w = words(text)
    return [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []


def prose(r, n, vocabulary=400):
    return " ".join("".join(r.choice("abcdeéf") for _ in range(3 + (k * 7) % 6)) for k in [r.randrange(vocabulary) for _ in range(n)])


def union_find(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


def test_kernels_match_the_library():
    r = random.Random(1)
    texts = EDGE + [prose(r, r.randrange(60)) for _ in range(100)] + ["y" * 700 + " b c d"]
    for width in (1, 3, 5):
        w = kernels.split_words(pa.array(texts))
        start, length, first = kernels.shingles(w, width)
        h = kernels.xxh64(w.buffer, start, length)
        for i, t in enumerate(texts):
            assert h[first[i] : first[i + 1]].tolist() == shingle_hashes(t, width)


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)]
    df = spark.createDataFrame(pairs + pairs[:3] + [(5, 5)], "u long, v long")
    got = {x.node: x.component for x in components.connected_components(df.repartition(7)).collect()}
    want = union_find(400, pairs)
    assert all(got.get(i, i) == want[i] for i in range(400))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_against_brute_force(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal((60, 16))
    rows = [base[i % 60] + g.standard_normal(16) * g.choice([0.05, 0.2, 0.5]) for i in range(400)]
    rows = np.array(rows, np.float32).tolist() + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0] * 8, rows[0].astype(np.float32).tolist(), rows[0].astype(np.float32).tolist()]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, class int")
    got = {r.vec_id: r for r in embedding.embedding_dedup(df).collect()}
    ok = [i for i, v in enumerate(rows) if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    m = np.array([rows[i] for i in ok], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    comp = union_find(len(rows), [(ok[i], ok[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    links = dict(zip(ok, (near.sum(1) - 1).tolist(), strict=True))
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links.get(i, 0), comp[i], comp[i] == i)


def test_pairs_at_the_threshold_are_missed_once_in_a_hundred_thousand():
    for n in (100, 10_000, 1_000_000):
        bits, tables = embedding.hash_plan(n, 0.9)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 1e-5


def test_big_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CHUNK", 16)
    g = np.random.default_rng(4)
    rows = (g.standard_normal(8) + g.standard_normal((90, 8)) * 0.01).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in embedding.embedding_dedup(df).collect()} == {(89, 0)}


@pytest.mark.parametrize("hot", [16_384, 6])
def test_simhash_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(5)
    texts = list(EDGE)
    for _ in range(120):
        t = prose(r, r.randrange(1, 150)).split(" ")
        texts.append(" ".join(t))
        for _ in range(r.randrange(3)):
            u = list(t)
            u[r.randrange(len(u))] = "zz"
            texts.append(" ".join(u))
    prints = []
    for t in texts:
        h = shingle_hashes(t, 3)
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    got = {x.doc_id: x for x in simhash.simhash_dedup(frame(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == comp


def test_vantage_trees_find_all_links():
    g = np.random.default_rng(6)
    base = g.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << g.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 300).astype(np.uint64)) for _ in range(4)]]))
    levels = simhash.plan_tree(fp, 5)
    row, shard, side = simhash.assign(fp, levels, 3)
    found = []
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        u, v = simhash._forest(fp[row[at]], side[at], 3)
        found += list(zip(row[at][u].tolist(), row[at][v].tolist(), strict=True))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert union_find(len(fp), found) == union_find(len(fp), list(zip(i.tolist(), j.tolist(), strict=True)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_vocabulary())


def test_bpe_matches_the_library(spark, library):
    r = random.Random(7)
    texts = EDGE + ["it's I'LL 12ab!!?", "ΑΣ İ Å", "<|endoftext|>ab<|startoftext|>"] + ["".join(r.choice("aeinrsth'É ü.1") for _ in range(r.randrange(80))) for _ in range(300)]
    got = {x.doc_id: x for x in bpe.digest_documents(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_keeps_exact_when_its_tables_turn_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    e = bpe.TrieBpe(bpe.public_vocabulary())
    r = random.Random(8)
    for _ in range(20):
        texts = [prose(r, 20) for _ in range(5)]
        ids, offsets = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark, library):
    r = random.Random(9)
    texts = EDGE + [prose(r, r.randrange(1, 1500)) for _ in range(80)]
    got = packing.pack_documents(frame(spark, texts)).collect()
    total = 0
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.piece)
        assert [(x.piece, x.start, x.length) for x in own] == [(k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(-(-len(ids) // 2048))]
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own)
    bins = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spans in bins.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048
    gaps = []  # best fit decreasing is no better
    for n in sorted((x.length for x in got), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps[gaps.index(min(fit))] -= n
        else:
            gaps.append(2048 - n)
    assert -(-total // 2048) <= len(bins) <= len(gaps)


def test_best_two_fit_beats_greedy():
    counts = np.zeros(11, int)
    for s in (6, 3, 2, 2):
        counts[s] += 1
    slots = packing.plan_bins(counts, 10)  # greedy 6 + 3 leaves 1; 6 + 2 + 2 is full
    first = sorted(s for s, _, m, b, _ in slots for _ in range(m) if b == 0)
    assert first == [2, 2, 6]


def test_sketches(spark):
    r = random.Random(10)
    texts = EDGE + [prose(r, r.randrange(1, 900), 5000) for _ in range(60)]
    got = {x.doc_id: x for x in sketch.fingerprint_documents(frame(spark, texts)).collect()}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sets = [set(shingle_hashes(t, 5)) for t in texts]
    for i, t in enumerate(texts):
        own, nxt = t or "", texts[i - 1] or ""
        n = len(own)
        edited = own[: n - n // 2] + nxt[: n // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(got[i].near_edited - jac(sets[i], set(shingle_hashes(edited, 5)))) < 0.16
        assert abs(got[i].near_next - jac(sets[i], sets[i - 1])) < 0.16
    assert got[10].fingerprint == got[11].fingerprint


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_each_document_meets_the_next_one(spark, parts):
    r = random.Random(61)
    ids = r.sample(range(-500, 500), 150)
    rows = [(i, f"text of {i} " * 3) for i in ids] + [(None, "no id")]
    want, order = {}, sorted(ids, reverse=True) + [None]
    text = dict(rows)
    for i, k in enumerate(order):
        own, nxt = text[k], text[order[(i + 1) % len(order)]]
        n = len(own)
        want[k] = hashlib.sha256((own[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x.doc_id: x.edited_sha256 for x in sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want


def test_sketches_merge(spark):
    r = random.Random(11)
    texts = [prose(r, 500, 9000) for _ in range(6)]
    sk = sketch.sketches(pa.array(texts))
    df = spark.createDataFrame([("k", sketch.to_text(x)) for x in sk], "key string, sketch string").repartition(3)
    merged = sketch.from_text(sketch.merge_by_key(df, "key", "sketch").first().sketch)
    union = set().union(*(shingle_hashes(t, 5) for t in texts))
    assert merged.tolist() == sorted({h >> 32 for h in union})[: sketch.K]
    assert abs(sketch.distinct_shingles(merged) / len(union) - 1) < 0.3
    one = sketch.from_text(sketch.to_text(sk[0]))
    assert sketch.containment(one, merged) > 0.6


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((b, bytes(gone)))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(12, 2048), (13, 2048), (14, 12), (15, 3)])
def test_repeated_strings_against_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH", 8)
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(seed)
    passages = [prose(r, 60, 9000) for _ in range(4)]
    texts = list(EDGE) + ["ab" * 300, "é" * 150, "x" * 900, "abc" * 400, f"{passages[0][:90]}{'abc' * 150}", "y" * 200]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts.append(r.choice([prose(r, r.randrange(40), 9000), p[a : a + r.randrange(150, 420)]]))
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21]]
    got = {x.doc_id: x for x in substrings.digest_kept(frame(spark, texts).repartition(5)).collect()}
    for i, (raw, gone) in enumerate(brute_removed(texts, 200)):
        runs = len(re.findall(b"\1+", gone))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i


def test_suffix_levels_grow_geometrically():
    r = random.Random(14)
    levels = substrings.SuffixLevels(200)
    common = bytes(r.randrange(256) for _ in range(200))
    for k in range(40):
        raw = np.frombuffer(bytes(r.randrange(256) for _ in range(100)) + (common if k in (3, 17) else bytes(r.randrange(256) for _ in range(200))), np.uint8)
        levels.add(raw, np.array([0, len(raw)]))
    assert levels.repeated.sum() == 2
    sizes = [len(x) for x in levels.levels]
    assert len(sizes) <= 7 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    strings = [levels.raw[s : s + 200].tobytes() for s in levels.start[levels.levels[0]].tolist()]
    assert strings == sorted(strings)


def test_suffix_array_is_lexicographic():
    r = random.Random(16)
    for alphabet in (b"ab", bytes(range(256))):
        raw = bytes(r.choice(alphabet) for _ in range(700)) + b"\0" * 30 + b"ab" * 60
        start = np.arange(len(raw) - 39)
        order, new = substrings.suffix_array(np.frombuffer(raw, np.uint8), start, 40)
        strings = [raw[i : i + 40] for i in order.tolist()]
        assert strings == sorted(strings)
        assert [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))] == new.tolist()


def test_periodic_text_has_few_anchors(spark):
    for unit in ("a", "ab", "abcdefg", "line\n" * 15):
        raw = np.frombuffer((unit * (1_000_000 // len(unit))).encode(), np.uint8)
        assert len(substrings.anchors(raw, np.array([0, len(raw)]), 200)[0]) < len(raw) / 30
    out = {x.doc_id: x for x in substrings.digest_kept(frame(spark, ["z" * 3_000_000, "ab" * 100, "short"])).collect()}
    assert (out[0].n_removed, out[1].n_removed, out[2].n_removed) == (3_000_000, 0, 0)


def test_repeated_ids_are_told_apart(spark):
    p = "".join(random.Random(17).choice("abcdefgh") for _ in range(300))
    rows = [(1, f"{p} one"), (1, "nothing here"), (None, f"two {p}"), (None, None), (2, ""), (2, None)]
    got = {(x.doc_id, x.text) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, " one"), (1, "nothing here"), (None, "two "), (None, None), (2, ""), (2, None)}


def test_removed_text_stays_text(spark):
    p = "é" * 140
    out = {x.doc_id: x for x in substrings.remove_repeats(frame(spark, ["a" + p + "b", "cc" + p, None, "short"])).collect()}
    assert out[0].text == "ab" and out[1].text == "cc" and out[2].text is None and out[3].text == "short"


def test_lines(spark):
    block = "\n".join(f"line {i} of the licence" for i in range(12))
    texts = [None, "", "a\nb", f"own first\n{block}\nown last", f"x\ny\n{block}", block, block, "one line only"]
    out = {x.doc_id: x.text for x in lines.dedup_lines(frame(spark, texts)).collect()}
    assert out[0] is None and out[1] == "" and out[2] == "a\nb" and out[3] == texts[3] and out[7] == "one line only"
    assert len(out[4]) < len(texts[4]) - 100 and out[4].startswith("x")
    assert len(out[6]) < 60
    report = {x.doc_id: x for x in lines.report_lines(frame(spark, texts)).collect()}
    assert all(report[i].kept_sha256 == hashlib.sha256((out[i] or "").encode()).hexdigest() for i in range(len(texts)))


def _block_lines_gone(texts):
    """Per text the numbers of lines in a later copy of two adjacent lines, by brute force."""
    first, gone = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        split = (t or "").split("\n")
        for i in range(len(split) - 1):
            at = first.setdefault((split[i], split[i + 1]), (d, i))
            if at != (d, i):
                gone[d] |= {i + 1} if at == (d, i - 1) else {i, i + 1}
    return gone


def test_runs_of_one_line_go(spark):
    texts = ["\n".join(["own", *["By To."] * 91, "end"]), "\n".join(["other", *["By To."] * 5])]
    out = {x.doc_id: x.text for x in lines.dedup_lines(frame(spark, texts)).collect()}
    assert out == {0: "own\nBy To.\nBy To.\nend", 1: "other"}


def test_short_blocks_and_edges_go(spark):
    r = random.Random(41)
    texts = [None, "", "solo"]
    blocks = [[prose(r, 6, 9000) for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 7, 15)]
    for i in range(60):
        own = [prose(r, 6, 9000) for _ in range(r.randrange(1, 6))]
        at = r.randrange(len(own) + 1)
        texts.append("\n".join(own[:at] + r.choice(blocks) + own[at:]))
    want = _block_lines_gone(texts)
    kept = ["\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in g) for t, g in zip(texts, want, strict=True)]
    out = {x.doc_id: x.text for x in lines.dedup_lines(frame(spark, texts)).collect()}
    assert all((out[i] or "") == kept[i] for i in range(len(texts)))
    report = {x.doc_id: x for x in lines.report_lines(frame(spark, texts)).collect()}
    assert [report[i].n_removed for i in range(len(texts))] == [len(g) for g in want]


def test_chat_round_trip(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant x <\\|im_end|> <\\\\| <|"
    convs = {
        1: [("system", "s"), ("user", "hello"), ("assistant", tricky)],
        2: [("system", "s"), ("user", "hello"), ("assistant", "other"), ("user", ""), ("assistant", None)],
        3: [("system", "s"), ("user", "hello"), ("assistant", tricky)],
        4: [("user", tricky)],
        5: [("assistant", "é全"), ("assistant", "b")],
    }
    rows = [(c, t, role, text, 0) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position long")
    for parts in (1, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            nodes, leaves, preludes = chat.format_trees(df)
            got = {x.conv_id: x for x in chat.read_back(nodes, leaves, preludes).collect()}
            rows = sorted(nodes.collect(), key=lambda n: n.start)
            ends = {x.conv_id: x.start for x in leaves.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        for c, turns in convs.items():
            said = "".join(f"{r}\n{t or ''}\n" for r, t in turns)
            loss = "".join(t or "" for r, t in turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c].formatted_chars == sum(len(chat.format_turn(r, t or "")[0]) for r, t in turns)
        whole = "".join(n.text for n in rows)
        assert whole.count("hello") == 1 and [n.start for n in rows] == [sum(m.length for m in rows[:i]) for i in range(len(rows))]
        for n in rows:
            assert n.position == sum(x.end - x.start for x in n.spans) and n.tree == (n.spans[0].start if n.spans else n.start)
        assert ends[1] == ends[3]
        last = next(n for n in rows if n.start == ends[2])
        formatted = "".join(chat.format_turn(r, t or "")[0] for r, t in convs[2])
        assert "".join(whole[x.start : x.end] for x in last.spans) + last.text == formatted


@pytest.mark.parametrize("seed", [51, 52, 53])
def test_shared_turns_are_written_once_whatever_the_partitions(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in range(120):
        turns = [("system", "x" * 10_000)] + [(r.choice(["user", "assistant"]), f"say {r.randrange(2)}") for _ in range(r.randrange(0, 9))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    prefixes = {tuple((x[2], x[3]) for x in rows if x[0] == c)[: k + 1] for c in range(120) for k in range(sum(x[0] == c for x in rows))}
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        nodes, leaves, preludes = chat.format_trees(df)
        got = nodes.collect()
        read = {x.conv_id: x for x in chat.read_back(nodes, leaves, preludes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(prefixes) and sum("xxx" in n.text for n in got) == 1
    assert len({n.part for n in got}) > 3
    for c in range(120):
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in rows if x[0] == c)
        assert read[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_long_conversations_have_few_intervals(spark):
    rows = [(c, t, "user", f"{t} {c if t > 1500 else ''}") for c in (1, 2) for t in range(3000)]
    nodes, leaves, preludes = chat.format_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 4499 and max(len(n.spans) for n in nodes.collect()) == 2
    assert {x.n_turns for x in chat.read_back(nodes, leaves, preludes).collect()} == {3000}


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string, start int, part int"
    rows = [(None, 0, "user", None, 1, 1), (None, 1, None, "x", 1, 1), (3, 0, "user", "a", 1, 1), (3, 0, "user", "a", 1, 1), (4, None, "assistant", "", 1, 1), (5, 0, "as\nsist\\ant", "\n<|", 1, 1)]
    got = {x.conv_id: x for x in chat.read_back(*chat.format_trees(spark.createDataFrame(rows, kind))).collect()}
    assert {c: x.n_turns for c, x in got.items()} == {None: 2, 3: 2, 4: 1, 5: 1}
    assert got[5].turns_sha256 == hashlib.sha256(b"as\nsist\\ant\n\n<|\n").hexdigest()
    assert chat.read_back(*chat.format_trees(spark.createDataFrame([], kind))).count() == 0


def test_escapes():
    for t in ["<|", "<\\|", "<\\\\|x", "<<|", "plain", "<|im_end|>"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def _audited(pages, change, depth=2):
    """Statuses of an audit of ``pages`` against a replica that ``change`` makes of the stored records."""
    replica = warc.stored(warc.warc_records(pages), depth)
    found = warc.audit(warc.manifest(replica, depth), warc.manifest(change(replica), depth), depth)
    return sorted(((x.page_id, x.url, x.status) for x in found.collect()), key=str)


def test_audit_names_what_differs_and_nothing_else(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 5) for i in range(300)] + [(None, None, None), (7, "http://h/7", "<p>7</p>" * 5), (7, "http://h/7", "other bytes")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert _audited(pages, lambda r: r) == []
    assert _audited(pages, lambda r: r.where("page_id <> 120 or page_id is null")) == [(120, "http://h/120", "missing")]
    extra = warc.stored(warc.warc_records(spark.createDataFrame([(500, "http://h/500", "new"), (7, "http://h/7", "new")], pages.schema)), 2)
    assert _audited(pages, lambda r: r.union(extra)) == [(500, "http://h/500", "added"), (7, "http://h/7", "added")]
    bad = lambda r: r.withColumn("record", F.when(F.col("page_id").isin(5, 77), F.concat(F.lit(b"W"), F.expr("substring(record, 2, octet_length(record) - 2)"), F.lit(b"?"))).otherwise(F.col("record")))
    assert _audited(pages, bad) == [(5, "http://h/5", "corrupt"), (77, "http://h/77", "corrupt")]
    moved = lambda r: r.withColumn("segment", F.when(F.col("page_id").isin(9, 10), "zz").otherwise(F.col("segment")))
    assert _audited(pages, moved) == [(10, "http://h/10", "moved"), (9, "http://h/9", "moved")]
    # of two copies one is lost; of three records under a name another one is changed
    assert _audited(pages, lambda r: r.dropDuplicates()) == [(7, "http://h/7", "missing")]
    both = lambda r: bad(moved(r.where("page_id <> 120 or page_id is null"))).union(extra)
    assert [x[2] for x in _audited(pages, both)] == ["moved", "missing", "corrupt", "added", "added", "corrupt", "moved"]


def test_audit_compares_roots_and_descends(spark):
    pages = spark.range(400).selectExpr("id as page_id", "concat('u', id) as url", "repeat('x', 50) as html")
    replica = warc.stored(warc.warc_records(pages), 3)
    one, other = (warc.tree(warc.manifest(r, 3), 3) for r in (replica, replica.where("page_id <> 33")))
    assert [t.count() for t in one][:2] == [1, 16]
    differ = [a.join(b, "node", "full").where(~a.digest.eqNullSafe(b.digest)).count() for a, b in zip(one, other, strict=True)]
    assert differ == [1, 1, 1, 1]
    assert warc.bad_leaves(one, other).count() == 1 and warc.bad_leaves(one, one).count() == 0


def test_audit_edges(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(600)] + [(None, None, None)] * 3 + [(1, "http://h/1", None), (2, "", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, copies int")
    out = warc.audit_pages(pages).collect()
    assert sum(x.status != "added" for x in out) == len(rows)
    assert {x.status for x in out} <= {"ok", "corrupt", "missing", "moved", "added"}
    assert warc.audit_pages(pages.limit(0)).count() == 0
    assert warc.depth_for(0) == 1 and warc.depth_for(513) == 2


def test_toxicity_held_out(spark):
    spark_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{spark_dir}/documents.parquet"), spark.read.parquet(f"{spark_dir}/labels.parquet")
    got = toxicity.predict(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    pos, neg = got[got.toxic == 1], got[got.toxic == 0]
    assert (pos.predicted == 1).mean() > 0.9 and (neg.predicted == 1).mean() < 0.01
    assert np.mean([(s > neg.score).mean() + 0.5 * (s == neg.score).mean() for s in pos.score]) > 0.95


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.predict(frame(spark, EDGE), labels).collect()
    assert len(out) == len(EDGE) and all(0 <= x.score < 0.5 and x.predicted == 0 for x in out)
    assert toxicity.predict(frame(spark, []), labels).count() == 0


def test_maximal_segments():
    def brute(tokens):
        best, at = 0, None
        for i in range(len(tokens)):
            for j in range(i + 1, len(tokens) + 1):
                if sum(tokens[i:j]) > best + 1e-12:
                    best, at = sum(tokens[i:j]), (i, j)
        return [] if at is None else brute(tokens[: at[0]]) + [round(best, 6)] + brute(tokens[at[1] :])

    r = random.Random(15)
    for _ in range(200):
        tokens = [r.uniform(-2, 2) for _ in range(r.randrange(12))]  # no ties
        before = np.concatenate([[0], np.cumsum(tokens)]).tolist()
        got = toxicity.maximal_segments([t for t in tokens if t > 0], [before[i] for i, t in enumerate(tokens) if t > 0])
        assert sorted(round(x, 6) for x in got) == sorted(brute(tokens))


OPERATORS = [simhash.simhash_dedup, packing.pack_documents, sketch.fingerprint_documents, bpe.digest_documents, lines.report_lines, substrings.digest_kept]


@pytest.mark.parametrize("operator", OPERATORS)
def test_edge_tables(spark, operator):
    odd = spark.createDataFrame([(None, "a b c", 1, 2), (1, None, 1, 2), (1, None, 1, 2), (2, "a b c", None, None), (2, "a b c", 0, 0)], "doc_id long, text string, key long, id long")
    out = operator(odd)
    assert out.count() >= odd.count() and "doc_id" in out.columns
    assert operator(odd.limit(0)).count() == 0


def test_extra_columns_with_clashing_names_stay(spark):
    wide = frame(spark, ["a b", "é" * 210, "é" * 210, None]).selectExpr("*", "1 AS key", "2 AS spans", "3 AS gone", "4 AS chunks", "5 AS score", "6 AS id")
    for out in (substrings.remove_repeats(wide), lines.dedup_lines(wide)):
        assert out.columns == wide.columns
        assert {tuple(r[5:]) for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, (-3.0, 0.5, 0.5))
    assert toxicity.score_documents(wide, model, score_col="__toxicity").columns == [*wide.columns, "__toxicity"]


def test_passages_score_every_token(spark):
    texts = ["alpha beta gamma alpha", "delta Delta beta", None, "", "alpha alpha beta beta beta beta alpha alpha alpha"]
    weight = {"alpha": 1.5, "beta": -0.7}
    forms, first = toxicity.token_forms(pa.array(["alpha beta"]))
    keys = forms[:, 0]
    order = np.argsort(keys)
    n, found = toxicity.passages(pa.array(texts), keys[order], np.array([1.5, -0.7])[order])

    def brute(tokens):
        best, at = 0, None
        for i in range(len(tokens)):
            for j in range(i + 1, len(tokens) + 1):
                if sum(tokens[i:j]) > best + 1e-12:
                    best, at = sum(tokens[i:j]), (i, j)
        return [] if at is None else brute(tokens[: at[0]]) + [best] + brute(tokens[at[1] :])

    for i, t in enumerate(texts):
        tokens = [weight.get(w, -toxicity.GAP) for w in (t or "").lower().split()]
        assert n[i] == len(tokens) and sorted(found[i]) == pytest.approx(sorted(brute(tokens)))


def test_copies_of_a_fingerprint_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 64)
    g = np.random.default_rng(71)
    copies = []
    for n in (2_000, 20_000):
        fp = np.unique(g.integers(0, 1 << 63, n, dtype=np.uint64))
        want = int(np.ceil(np.log2(n / 64)))
        levels = simhash.plan_tree(fp[:2_000], min(want, simhash.DEPTH))
        copies.append(4 * len(simhash.assign(fp, levels, 3)[0]) / len(fp))
    assert max(copies) < 12 and copies[1] < 1.1 * copies[0]


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(None, [1.0, 0.0]), (None, None), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, []), (6, [1.0, None]), (7, [1.0]), (8, [1e300, 1e300]), (9, [1e-300, 1e-300])]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, class int, weight int, tab int")
    out = embedding.embedding_dedup(df).collect()
    assert len(out) == len(rows)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out if x.vec_id is not None}
    assert got[2] == (3, 1, False) and got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7))
    assert embedding.embedding_dedup(df.limit(0)).count() == 0


def test_toxicity_repeated_rows_and_odd_columns(spark):
    r = random.Random(72)
    texts = [f"{prose(r, 30, 300)} {'vile grubby muck vile' if i % 8 == 0 else ''}" for i in range(400)]
    kind = "doc_id long, text string, score double, toxic int, fold int"
    docs = spark.createDataFrame([(i, t, 0.5, 7, 7) for i, t in enumerate(texts)] + [(None, texts[8], 0.5, 7, 7), (8, texts[8], 0.5, 7, 7), (500, None, None, None, None), (501, "", None, None, None), (502, "vile " * 100_000, None, None, None)], kind)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)] + [(None, 1), (3, None), (8, 1)], "doc_id long, toxic int")
    out = toxicity.predict(docs, labels).collect()
    assert len(out) == docs.count()
    by = {x.doc_id: x for x in out}
    assert all(by[i].predicted == int(i % 8 == 0) for i in range(400)) and by[502].predicted == 1
    assert by[500].score == by[501].score < 0.5 and by[None].held_out is False
    assert len({x.score for x in out if x.doc_id in (None, 8)}) == 1
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out if x.doc_id is not None)
