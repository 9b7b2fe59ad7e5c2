"""The pipeline's stages against brute-force versions."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm import test_llm as base
from tidewire.llm import similar


def test_stages_against_brute_force(spark):
    import random

    r = random.Random(21)
    shared = base.prose(r, 80, 9000)
    block = "\n".join(base.prose(r, 8, 900) for _ in range(9))
    texts = [None, "", "short"] + [base.prose(r, 120, 9000) for _ in range(20)]
    texts += [texts[5], texts[6] + " tail", f"{texts[7][:300]} {shared}", f"{base.prose(r, 70, 9000)} {shared}", f"first\n{block}", f"other\n{block}"]
    docs = base.frame(spark, texts)
    lined = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    got = {x.doc_id: x for x in lined.collect()}
    assert lined.columns == docs.columns and all(x.n_chars == (len(x.text) if x.text is not None else None) for x in got.values())
    assert got[len(texts) - 2].text == texts[-2] and len(got[len(texts) - 1].text) < len(texts[-1])

    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    sets = [set(base.shingle_hashes(t, 5)) for t in texts]
    comp = base.union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert kept == {i for i in range(len(texts)) if comp[i] == i}

    cut = {x.doc_id: x.text for x in corpus_pipeline.cut_repeated_strings(spark, docs, "").collect()}
    for i, (raw, gone) in enumerate(base.brute_removed(texts, 200)):
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (cut[i] or "").encode().isascii() is False or (cut[i] or "").encode() == left
        assert abs(len((cut[i] or "").encode()) - len(left)) <= 6


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "suffix_array_dedup", "best_fit_packing"]


@pytest.mark.parametrize("chunk", [512, 3])
def test_edited_copies_go_at_any_fingerprint_distance(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(similar, "CHUNK", chunk)
    r = random.Random(31)
    texts = [None, "", "two words"]
    for _ in range(40):
        t = base.prose(r, r.randrange(60, 160), 9000).split(" ")
        texts.append(" ".join(t))
        for _ in range(r.randrange(3)):
            u = list(t)
            for _ in range(r.randrange(1, 5)):
                u[r.randrange(len(u))] = "zz"
            texts.append(" ".join(u))
    sets = [set(base.shingle_hashes(t, 5)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = base.union_find(len(texts), near)
    docs = base.frame(spark, texts)
    kept = {x.doc_id for x in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()}
    assert kept == {i for i in range(len(texts)) if comp[i] == i}


def test_other_documents_under_a_repeated_id_stay(spark):
    import random

    r = random.Random(32)
    a, b = base.prose(r, 50, 9000), base.prose(r, 50, 9000)
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (None, a, 4), (None, None, 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(x.k1 for x in out.collect()) == [1, 3, 4, 5, 6]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_links_never_grow_with_the_square_of_a_group():
    import numpy as np

    g = np.random.default_rng(33)
    core = g.integers(0, 1 << 60, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[: int(k)], g.integers(0, 1 << 60, 10, dtype=np.uint64)])) for k in g.integers(40, 91, 200)]
    u, v = similar.spanning_links(sets, np.arange(200), np.arange(200), np.arange(200), 0.8)
    near = [(i, j) for i in range(200) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert len(u) < 200 and set(zip(np.maximum(u, v).tolist(), np.minimum(u, v).tolist(), strict=True)) <= set(near)
    assert base.union_find(200, list(zip(u, v, strict=True))) == base.union_find(200, near)


def test_stages_keep_columns_of_any_name(spark):
    docs = base.frame(spark, ["a b\nc d", "é" * 210, "é" * 210, None]).selectExpr("*", "1 AS k1", "2 AS K2", "3 AS spans", "4 AS gone", "5 AS score", "6 AS void", "7 AS __key", "8 AS __gone")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    import unittest.mock

    with unittest.mock.patch.object(corpus_pipeline, "table", lambda *_: labels):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert {tuple(r[5:]) for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7, 8)}


def test_toxicity_stage_against_a_score_by_hand(spark):
    import math
    import random
    import unittest.mock

    import numpy as np
    import pyarrow as pa

    from tidewire.llm import toxicity

    r = random.Random(73)
    texts = [f"{base.prose(r, 30, 300)} {'vile grubby muck vile' if i % 8 == 0 else ''}" for i in range(300)] + [None, "", "grubby vile one", "muck"]
    docs = base.frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def score(text):
        forms = toxicity.token_forms(pa.array([text or ""]))[0]
        tokens = []
        for f in forms.tolist():  # the whole word, then its longest beginning with evidence
            known = [weights[x] for x in (f[0], *reversed(f[1:])) if x and x in weights]
            tokens.append(known[0] if known else -toxicity.GAP)
        segments, left = [], [tokens]
        while left:
            part = left.pop()
            best, at = 1e-12, None
            for i in range(len(part)):
                for j in range(i + 1, len(part) + 1):
                    if sum(part[i:j]) > best:
                        best, at = sum(part[i:j]), (i, j)
            if at:
                segments.append(best)
                left += [part[: at[0]], part[at[1] :]]
        level = math.log(max(model.size * max(len(tokens), 1), 1e-12))
        best = max(min(model.scale * max(segments, default=0.0) - level, 50), -10)
        strong = sum(x for x in (model.scale * y - level for y in segments) if x > -math.log(toxicity.E_VALUE))
        z = float(np.dot(model.fit, [1, best, math.log1p(strong)]))
        return 1 / (1 + math.exp(-max(min(z, 35), -35)))

    with unittest.mock.patch.object(corpus_pipeline, "table", lambda *_: labels):
        kept = {x.doc_id for x in corpus_pipeline.drop_toxic(spark, docs, "").collect()}
    assert kept == {i for i, t in enumerate(texts) if score(t) < 0.5}
    assert not kept & {i for i in range(0, 300, 8)} and {300, 301} <= kept


def test_line_and_packing_stages_against_brute_force(spark):
    import random
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tidewire.llm import bpe

    r = random.Random(74)
    lines = [base.prose(r, 5, 9000) for _ in range(40)]
    texts = [None, "", "x"] + ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 12))) for _ in range(60)] + [base.prose(r, 3000, 9000)]
    docs = base.frame(spark, texts)
    gone = base._block_lines_gone(texts)
    want = [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, gone, strict=True)]
    lined = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert [x.text for x in lined.orderBy("doc_id").collect()] == want
    library = Tokenizer.from_file(bpe.public_vocabulary())
    out = corpus_pipeline.pack(spark, docs, "").collect()
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((x for x in out if x.doc_id == i), key=lambda x: x.piece)
        assert [(x.start, x.length, x.ids_crc32) for x in own] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]
    for seq in {x.sequence_id for x in out}:
        spans = sorted((x.offset, x.length) for x in out if x.sequence_id == seq)
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
