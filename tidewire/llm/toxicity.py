"""Toxic passages as maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import kernels
from tidewire.llm.session import discard, materialize, table

#: Labelled rows that the model is fitted on at most, chosen by a hash of their id.
MAX_LABELLED = 60_000
#: A token form counts as evidence if at least so many toxic training texts hold it.
MIN_TOXIC = 3
#: Cost of each token without evidence inside a passage: scores of clean text have to fall on average.
GAP = 0.25
#: Token scores are counted in steps of this for the extreme-value law.
STEP = 0.05
#: Standard errors by which log-odds are taken nearer to 0, and the least log-odds that then count for the toxic side:
#: very many forms are looked at, and chance favours some a little.
ERRORS, LEAST = 1.0, 1.5
#: Weight of the informative Dirichlet prior, in tokens, and its flat part.
PRIOR, FLAT = 500.0, 0.5
#: Passages whose expected number in clean text of that length is above this are not significant.
E_VALUE = 0.05
#: Byte lengths of word beginnings that are token forms besides the whole word.
PREFIXES = (4, 5, 6)
_SEPARATORS = kernels.letters_only()
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """Weights of token forms by hash (sorted), extreme-value parameters and calibration."""

    keys: np.ndarray
    weights: np.ndarray
    scale: float  # lambda of the extreme-value law
    size: float  # its K
    fit: tuple[float, float, float]  # logistic: constant, normalised best passage, log of the significant sum


def token_forms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(forms, first): a row of hashes per token, the whole word and its beginnings; 0 where a word is no longer."""
    words = kernels.split_words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), _SEPARATORS)
    length = words.end - words.start
    whole = kernels.xxh64(words.buffer, words.start, length, 1)
    padded = np.concatenate([words.buffer, np.zeros(8, np.uint8)])
    lane = np.ndarray((len(padded) - 7,), np.uint64, padded, 0, (1,))[words.start]
    forms = [whole | np.uint64(1)]
    for n in PREFIXES:
        cut = (lane & np.uint64((1 << 8 * n) - 1)) ^ np.uint64(n << 56)
        mixed = (cut * _MIX) ^ ((cut * _MIX) >> np.uint64(29))
        forms.append(np.where(length > n, mixed | np.uint64(1), np.uint64(0)))
    return np.stack(forms, axis=1), words.first


def _lookup(forms: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each token's log-odds: of its longest form with evidence for either side; 0 if none has any."""
    if not len(keys):
        return np.zeros(len(forms))
    # a small bitmap spares most tokens the search
    seen = np.zeros(1 << 20, bool)
    seen[keys >> np.uint64(44)] = True
    out = np.zeros(len(forms))
    for c in [*range(1, forms.shape[1]), 0]:
        at = np.flatnonzero(seen[forms[:, c] >> np.uint64(44)])
        k = np.minimum(np.searchsorted(keys, forms[at, c]), len(keys) - 1)
        hit = keys[k] == forms[at, c]
        out[at[hit]] = weights[k[hit]]
    return out


def maximal_segments(scores: list[float], before: list[float]) -> list[float]:
    """Scores of all maximal-scoring segments, in linear time.

    ``scores`` are the positive tokens in order, ``before[i]`` is the running sum of all tokens ahead of the i-th.
    Segments are kept on a stack of (sum on the left, sum on the right); a new one is joined to the nearest earlier
    one with a smaller left sum, if that one's right sum is smaller too.
    """
    stack: list[tuple[float, float, int]] = []  # left sum, right sum, nearest earlier segment with a smaller left sum
    for s, left in zip(scores, before, strict=True):
        right = left + s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][2]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, j))
                break
            left = stack[j][0]
            del stack[j:]
    return [right - left for left, right, _ in stack]


def token_scores(column: pa.Array, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, first): the log-odds of each token, or -GAP without evidence."""
    forms, first = token_forms(column)
    weight = _lookup(forms, keys, weights)
    return np.where(weight != 0, weight, -GAP), first


def passages(column: pa.Array, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
    """(tokens, scores of the maximal passages) of each text."""
    score, first = token_scores(column, keys, weights)
    total = np.concatenate([[0.0], np.cumsum(score)])
    hits = np.flatnonzero(score > 0)
    doc = np.searchsorted(first, hits, side="right") - 1
    out: list[list[float]] = [[] for _ in range(len(first) - 1)]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(hits)]]) if len(hits) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        d = int(doc[a])
        out[d] = maximal_segments(score[hits[a:b]].tolist(), (total[hits[a:b]] - total[first[d]]).tolist())
    return np.diff(first), out


def _features(tokens: np.ndarray, segments: list[list[float]], scale: float, size: float) -> np.ndarray:
    """Per text: 1, the best passage as -ln of its expected number, and the log of what significant ones sum up to."""
    out = np.ones((len(segments), 3))
    floor = math.log(E_VALUE)
    for i, (n, found) in enumerate(zip(tokens.tolist(), segments, strict=True)):
        level = math.log(max(size * max(n, 1), 1e-12))
        best = scale * max(found, default=0.0) - level
        out[i, 1] = max(min(best, 50.0), -10.0)
        out[i, 2] = math.log1p(sum(x for s in found if (x := scale * s - level) > -floor))
    return out


def _log_odds(n_toxic: float, n_clean: float):
    """Signed log-odds ratio under an informative Dirichlet prior, ``ERRORS`` standard errors nearer to 0; 0 if it is less.

    An expression over the columns toxic and clean, the numbers of texts that hold a form.
    """
    toxic, clean = F.col("toxic"), F.col("clean")
    prior = F.lit(FLAT) + PRIOR * (toxic + clean) / (n_toxic + n_clean)
    total = PRIOR + FLAT
    a, b = toxic + prior, clean + prior
    ratio = F.log(a / (n_toxic + total - a)) - F.log(b / (n_clean + total - b))
    return F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - ERRORS * F.sqrt(1 / a + 1 / b))


def _decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """lambda of the extreme-value law: the positive solution of E(exp(lambda * score)) = 1 over tokens of clean text."""
    share = counts / max(1, counts.sum())
    low, high = 1e-6, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        grown = float(np.sum(share * np.exp(np.minimum(mid * scores, 500))))
        low, high = (low, mid) if grown > 1 else (mid, high)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; the slopes are kept from going below 0."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) + ridge * w * [0.01, 1, 1]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([0.01, 1, 1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[0], max(w[1], 0.0), max(w[2], 0.0)


def _fold(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0.

    Folds 1 to 3 give the token log-odds, fold 4 the extreme-value parameters and the calibration. At most
    ``max_labelled`` rows, those with the smallest hash of their id, are used; equal texts count once. Rows with a
    null id or label are not used; of several labels of an id the largest holds.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", _fold("id")).where("fold <> 0")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    train = materialize(rows.join(F.broadcast(chosen), "id").select("fold", "toxic", "text"), "labelled", rows=50 * max_labelled)  # max_labelled rows bound it; whole texts, so more tasks than for small rows

    def count(reader):
        for batch in kernels.batches(reader, "text", 1 << 20):
            forms, first = token_forms(batch.column("text"))
            tox = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            doc = np.repeat(np.arange(len(tox)), np.diff(first))
            keys = np.concatenate([forms[:, c] for c in range(forms.shape[1])])
            docs_ = np.tile(doc, forms.shape[1])
            real = keys > 0
            keys, docs_ = keys[real], docs_[real]
            order = np.lexsort((docs_, keys))
            keys, docs_ = keys[order], docs_[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (docs_[1:] != docs_[:-1])  # each text counts once
            keys, hot = keys[once], tox[docs_[once]]
            first_of = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            t = np.add.reduceat(hot.astype(np.int64), first_of) if len(keys) else first_of
            n = np.diff(np.concatenate([first_of, [len(keys)]]))
            size = np.array([np.diff(first)[tox].sum(), np.diff(first)[~tox].sum()])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], keys[first_of].view(np.int64)])), pa.array(np.concatenate([[size[0]], t])), pa.array(np.concatenate([[size[1]], n - t]))], ["key", "toxic", "clean"])

    texts = train.where("fold <> 4").dropDuplicates(["text", "toxic"]).select("text", "toxic")
    counts = materialize(texts.mapInArrow(count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "forms", rows=50 * max_labelled)
    sizes = counts.where("key = 0").first()  # the tokens of both sides
    n_toxic, n_clean = (float(sizes[c]) + 1 if sizes else 1.0 for c in ("toxic", "clean"))
    # evidence for a side: few enough forms have some for max_labelled texts
    found = counts.where("key <> 0").withColumn("weight", _log_odds(n_toxic, n_clean)).where((F.col("weight") < 0) | (F.col("weight") > LEAST) & (F.col("toxic") >= MIN_TOXIC))
    found = found.select("key", "weight").toPandas()
    discard(counts)
    keys, weights = found.key.to_numpy().view(np.uint64), found.weight.to_numpy()
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]

    def spread(reader):
        for batch in kernels.batches(reader, "text", 1 << 20):
            step, n = np.unique(np.round(token_scores(batch.column("text"), keys, weights)[0] / STEP).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    steps = texts.where("toxic = 0").select("text").mapInArrow(spread, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()  # as many rows as there are scores
    scale = _decay(steps.step.to_numpy() * STEP, steps.n.to_numpy().astype(float))

    def score(reader):
        for batch in kernels.batches(reader, "text", 1 << 20):
            n, segments = passages(batch.column("text"), keys, weights)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n), pa.array(segments, pa.list_(pa.float64()))], ["toxic", "n", "segments"])

    held = train.where("fold = 4").select("text", "toxic").mapInArrow(score, "toxic int, n long, segments array<double>").toPandas()
    if not len(held):
        return Model(keys, weights, scale, 1.0, (-3.0, 0.5, 0.5))
    toxic, n = held.toxic.to_numpy(), held.n.to_numpy()
    segments = [list(s) for s in held.segments]
    # E(lambda * best - ln n) = ln K + Euler's constant over clean texts in which a passage was found
    best = np.array([scale * max(s) - math.log(max(m, 1)) for s, m, t in zip(segments, n.tolist(), toxic.tolist(), strict=True) if s and not t])
    share = len(best) / max(1, int((toxic == 0).sum()))
    size = math.exp(float(best.mean()) - 0.5772) * share if len(best) else 1e-4
    return Model(keys, weights, scale, size, _logistic(_features(n, segments, scale, size), (toxic > 0).astype(float)))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``score_col``; only whole texts are read, null as the empty text."""
    names = [c for c in docs.columns if c != score_col]

    def run(reader):
        for batch in kernels.batches(reader, text_col, 1 << 20):
            n, segments = passages(batch.column(text_col), model.keys, model.weights)
            z = _features(n, segments, model.scale, model.size) @ np.array(model.fit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], [*batch.schema.names, score_col])

    kept = docs.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row: id, held_out, score and predicted.

    Null and empty texts get the score of a text without passages. Without usable labels scores are near 0.
    Repeated rows get equal scores; a null id is never held out. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, max_labelled)
    out = score_documents(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model)
    held = F.coalesce(_fold("id") == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: toxicity of all documents."""
    return predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
