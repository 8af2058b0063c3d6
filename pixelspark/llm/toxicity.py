"""Toxicity: non-negative positive-unlabelled learning with a class-prior-corrected risk.

A linear numpy classifier over the presence of words (hashed to 2**22 buckets).  Training sees confirmed toxic
texts (P) and unlabelled texts (U, drawn from everything, labels unread); features are chosen by counts over all texts.  With prior ``pi`` the
risk is ``pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)])``; where the bracket
is negative its gradient is followed backwards, as in non-negative PU learning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import MARKS, joined_bytes, pieces, runs, word_hashes
from .workers import release, trim

BITS = 22


@dataclass(frozen=True)
class Model:
    """A logistic model over word buckets."""

    buckets: np.ndarray  # sorted bucket numbers of the features
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.int32)
        out[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return out


def _presence(texts: pa.Array, table: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature or bucket) occurrences, in pieces; with a table only chosen features."""
    data, firsts = joined_bytes(texts)
    for a, b in pieces(data, MARKS):
        starts, hashes = word_hashes(data[a:b], MARKS)
        buckets = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        if table is not None:
            features = table[buckets]
            found = np.flatnonzero(features)
            starts, buckets = starts[found], features[found] - 1
        yield np.searchsorted(firsts, starts + a, side="right") - 1, buckets


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of P and of U that hold each bucket: one row for each task and class."""
    release()
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    seen = [0, 0]
    for batch in batches:
        for i, positive in enumerate(batch.column(1).to_pylist()):
            present = [h for _, h in _presence(batch.column(0).slice(i, 1), None)]
            counts[int(positive)][np.unique(np.concatenate(present)) if present else []] += 1
            seen[int(positive)] += 1
    for c in (0, 1):
        if seen[c]:
            at = np.flatnonzero(counts[c])
            yield pa.record_batch(
                [pa.array([c], pa.int32()), pa.array([seen[c]], pa.int64()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[c][at]], pa.list_(pa.int32()))], names=["c", "n", "at", "k"]
            )


def _counted(table):
    """How many texts hold each feature of ``table``: one row for each task and feature, and their number as feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        features = table.value
        model = Model(features, np.zeros(len(features)), 0.0)
        places, width, n = model.table(), len(features) + 1, 0
        counts = np.zeros(width, np.int64)
        for batch in batches:
            for part in runs(batch.column(0), 4 << 20):
                pairs = [np.unique(rows * width + hit) for rows, hit in _presence(part, places)]
                pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
                counts += np.bincount(pairs % width, minlength=width)
                n += len(part)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(features[at], -1).astype(np.int32)), pa.array(np.append(counts[at], n))], names=["bucket", "k"])

    return run


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            pairs = [np.zeros(0, dtype=np.int64)]
            width = len(model.buckets) + 1
            for rows, hit in _presence(batch.column(0), table):
                pairs.append(np.unique(rows * width + hit))
            pairs = np.unique(np.concatenate(pairs))
            rows = pairs // width
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs % width).astype(np.int32)))
            yield pa.record_batch([batch.column(1), lists], names=["positive", "features"])

    return run


def choose_features(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int, prior: float, most: int, least: float) -> np.ndarray:
    """Buckets more frequent in P than in what of U is not P: largest likelihood ratios first.

    The share among U that is not P is corrected by the prior.  ``least`` is a bound on the
    likelihood-ratio statistic, so chance findings among a million buckets stay out.
    """
    in_p, in_u = p / max(n_p, 1), u / max(n_u, 1)
    in_n = np.maximum(0, (in_u - prior * in_p) / (1 - prior))
    in_n = (in_n * n_u + 1) / (n_u + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * n_p * (np.where(in_p > 0, in_p * np.log(in_p / in_n), 0) + np.where(in_p < 1, (1 - in_p) * np.log((1 - in_p) / (1 - in_n)), 0))
    score = np.where(in_p > in_n, ratio, 0)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] >= least])


def train_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, rounds: int = 800, step: float = 0.1, decay: float = 2e-5, floor: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative PU risk (logistic loss)."""
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = -2.0
    sides = []
    for rows in (positive, unlabelled):
        index = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sides.append((index, np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), len(rows)))

    def score(side):
        index, feature, n = side
        return np.bincount(index, w[feature], minlength=n) + w[-1]

    def back(side, slope):
        index, feature, n = side
        g = np.bincount(feature, slope[index], minlength=n_features + 1) / max(n, 1)
        g[-1] = slope.sum() / max(n, 1)
        return g

    soft = lambda x: np.logaddexp(0, x)
    sig = lambda x: 0.5 * (1 + np.tanh(x / 2))
    for t in range(1, rounds + 1):
        gp, gu = score(sides[0]), score(sides[1])
        negative_risk = soft(gu).mean() - prior * soft(gp).mean()
        down = back(sides[1], sig(gu)) - prior * back(sides[0], sig(gp))
        grad = (prior * back(sides[0], -sig(-gp)) + down) if negative_risk >= floor else -down
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(texts: DataFrame, prior: float, positives: int = 3000, unlabelled: int = 9000, features: int = 4096, significance: float = 16.0, tasks: int = 8) -> Model:
    """Trains on ``texts(id, text, positive)``: at most so many confirmed positives and other rows.

    The rows are those of the smallest hashes of their ids, so the choice is the same in every
    run.  ``positive`` false means unlabelled: such rows may well be toxic.  Only the optimiser works on
    this bounded sample.  Features are chosen by document counts over all ``texts``: of the words that two
    confirmed positives or more hold, counted on the executors.  The driver gets a count for each of
    them, at most ``tasks`` count vectors of the positives and the sample's feature lists.
    """
    spark = texts.sparkSession
    # ids first: they are small to sort; then the texts of the chosen ids, a bounded broadcast
    ids = texts.select("id", "positive")
    p = ids.where("positive").select("id").orderBy(F.xxhash64("id"), "id").limit(positives).withColumn("positive", F.lit(True))
    u = ids.select("id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(p.unionByName(u).distinct())
    sample = texts.select("id", "text").join(chosen, "id").select("text", "positive").repartition(tasks).persist()
    try:
        in_p, n_p = np.zeros(1 << BITS), 0
        for r in sample.where("positive").mapInArrow(_document_counts, "c int, n long, at array<int>, k array<int>").toArrow().to_batches():
            for n, at, k in zip(*(r.column(i) for i in range(1, 4)), strict=True):
                in_p[at.values.to_numpy()] += k.values.to_numpy()
                n_p += n.as_py()
        if not n_p:
            return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
        held = np.flatnonzero(in_p >= 2)
        # only words of the confirmed positives can become features; these are counted in all texts
        wanted = spark.sparkContext.broadcast(held)
        seen = texts.select("text").mapInArrow(_counted(wanted), "bucket int, k long").groupBy("bucket").agg(F.sum("k").alias("k")).toArrow()
        in_u, n_u = np.zeros(1 << BITS), 0
        for bucket, k in zip(seen.column(0).to_pylist(), seen.column(1).to_pylist(), strict=True):
            if bucket < 0:
                n_u = k
            else:
                in_u[bucket] = k
        chosen = choose_features(in_p, n_p, in_u, n_u, prior, features, significance)
        del in_p, in_u
        got = sample.mapInArrow(_features(Model(chosen, np.zeros(len(chosen)), 0.0)), "positive boolean, features array<int>").toArrow()
    finally:
        sample.unpersist()
    rows = {True: [], False: []}
    for batch in got.to_batches():
        lists = batch.column(1)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, positive in enumerate(batch.column(0).to_pylist()):
            rows[positive].append(flat[ends[i] : ends[i + 1]])
    for side in rows.values():  # the order in which rows arrive must not matter to sums of floats
        side.sort(key=lambda r: r.tobytes())
    weights, bias = train_pu(rows[True], rows[False], len(chosen), prior)
    return Model(chosen, weights, bias)


def _scorer(model, text_col: str, at_once: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = Model(*model.value)
        table, width = m.table(), len(m.buckets) + 1
        weights = np.append(m.weights, 0.0)

        def scores(texts: pa.Array) -> np.ndarray:
            pairs = [np.unique(rows * width + hit) for rows, hit in _presence(texts, table)]
            pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *pairs]))
            g = np.bincount(pairs // width, weights[pairs % width], minlength=len(texts)) + m.bias
            return 0.5 * (1 + np.tanh(g / 2))

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            parts = [scores(part) for part in runs(texts, at_once)]
            score = pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())
            yield pa.record_batch([*batch.columns, score], names=[*batch.schema.names, "score"])
            del texts, parts, score, batch
            trim()

    return run


def score(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` and ``score`` (0 to 1) for every whole text; null counts as empty.

    A column named ``score`` is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.bias))  # at most 4096 features by default
    slim = rows.drop("score")
    return slim.mapInArrow(_scorer(shared, text_col), T.StructType([*slim.schema.fields, T.StructField("score", T.DoubleType())]))


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_labelled(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 3000) -> Model:
    """Trains on documents and labels whose crc32(id as text) mod 3 is not 1.

    The prior is the share of toxic ones among the labelled ids that may be read (0.1 if there
    are none).  A document with several labels counts as toxic if any says so; null labels and
    labels of unknown ids are ignored.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where(~_held_out("id") & F.col("id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(0.5, max(0.01, toxic / n)) if n and toxic else 0.1
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~_held_out("id") & F.col("id").isNotNull())
    # at most ``positives`` ids, so they can be sent to every task
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(positives).select("id", F.lit(True).alias("positive"))
    texts = texts.join(F.broadcast(chosen), "id", "left").select("id", "text", F.coalesce("positive", F.lit(False)).alias("positive"))
    return fit(texts, prior, positives=positives)


def toxicity(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """Scores every document; labels are read only where crc32(id as text) mod 3 is not 1.

    Scores come from the text alone.  Returns id, ``held_out``, ``score``, ``predicted``.
    Null and empty texts get the score of no evidence; without any toxic label every score is
    below one half.  Repeated rows and null ids (held out: false) stay, empty tables give an
    empty result, other columns are ignored.
    """
    model = fit_labelled(documents, labels, id_col, text_col, label_col)
    scored = score(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select("id", "score")
    return scored.select(F.col("id").alias(id_col), _held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
