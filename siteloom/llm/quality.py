"""Quality classifier: a factorisation machine over hashed words and structure.

A document is a sparse vector of hashed lower-cased words (weights fall with
repetition and are scaled to the document), the bins of its structure
statistics (shares of punctuation, capitals, digits and line breaks, word and
line lengths, repetition) and of its length as metadata. The machine adds a
weight for every feature and, for every pair, the product of two
``FACTORS``-vectors; by the identity ``sum of pairs = (square of sum - sum of
squares) / 2`` a score takes time linear in the features.

It is fitted on at most ``TRAIN_ROWS`` labelled rows that are not held out,
taken in the order of a hash: that bound is the model's only sample, and every
document is scored over its whole text. Null labels teach nothing; a document
with several labels counts once for each. With no labels every score is 0.5.
Null and empty texts have the statistics of an empty text and get a score like
any other. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import encoded_words, id_crc, rebatched, split_words, struct_of

TRAIN_ROWS = 6000
WORD_BUCKETS = 1 << 15
BINS = 16
FACTORS = 8
MOST_EPOCHS = 400
STEP_ROWS = 32
LEAST_LOSS = 0.02  # of the training rows, at which fitting ends
LEAST_GAIN = 0.002  # or an epoch that lowers it by less than this share
RATE = 0.05
DECAY = 2e-4
BATCH = 8 << 20

#: Characters whose share of the text is a statistic of its own.
MARKS = "!#$%&*|{}[]<>=_/@\"',.;:-"
STATS = len(MARKS) + 11


def held_out(id_column: str) -> Column:
    return F.pmod(id_crc(id_column), F.lit(3)) == 1


def _classes() -> np.ndarray:
    """A class for every byte: each mark, then capitals, digits, line breaks, other white space, bytes beyond ASCII, the rest."""
    out = np.full(256, len(MARKS) + 5, np.uint8)
    out[ord("A") : ord("Z") + 1] = len(MARKS)
    out[ord("0") : ord("9") + 1] = len(MARKS) + 1
    out[[10, 11, 12, 13]] = len(MARKS) + 2
    out[[9, 32]] = len(MARKS) + 3
    out[128:] = len(MARKS) + 4
    for i, c in enumerate(MARKS):
        out[ord(c)] = i
    return out


CLASSES = _classes()


def statistics(text: pa.Array, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Rows of STATS numbers: shares of byte classes, log lengths, repetition."""
    n = len(text)
    data = pa.concat_arrays([text.cast(pa.binary())]) if text.offset else text.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32)[: n + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if data.buffers()[2] else np.zeros(0, np.uint8)
    lengths = np.diff(ends)
    width = len(MARKS) + 6
    owner = np.repeat(np.arange(n) * width, lengths)
    counts = np.bincount(owner + CLASSES[raw], minlength=n * width).reshape(n, width)
    size = np.maximum(lengths, 1)
    words = np.diff(offsets)
    doc = np.repeat(np.arange(n), words)
    pairs = np.unique(doc * (int(index.max()) + 1) + index) if len(index) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // (int(index.max()) + 1), minlength=n) if len(index) else np.zeros(n, np.int64)
    same_next = np.bincount(doc[1:], weights=(index[1:] == index[:-1]) & (doc[1:] == doc[:-1]), minlength=n)[:n] if len(index) > 1 else np.zeros(n)
    lines = counts[:, len(MARKS) + 2] + 1
    more = [np.log1p(lengths) / 14, np.log1p(words) / 12, np.log1p(lengths / np.maximum(words, 1)) / 4, distinct / np.maximum(words, 1), same_next / np.maximum(words, 1)]
    shares = np.sqrt(counts / size[:, None])
    return np.concatenate([shares, np.stack(more, axis=1)], axis=1)[:, :STATS]


def features(text: pa.Array, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, ids, weights) of the hashed words of each text, and its statistics with log ``chars`` last."""
    offsets, flat = split_words(text)
    index, words = encoded_words(flat)
    hashed = np.fromiter((zlib.crc32(w.lower().encode()) % WORD_BUCKETS for w in words), np.int64, len(words))
    n = len(text)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    key, count = np.unique(doc * WORD_BUCKETS + hashed[index], return_counts=True) if len(index) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner, ids = key // WORD_BUCKETS, key % WORD_BUCKETS
    weight = 1 + np.log(np.maximum(count, 1))
    norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=n))
    weight = weight / np.maximum(norm[owner], 1e-9)
    at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    stats = np.concatenate([statistics(text, offsets, index), (np.log1p(np.maximum(chars, 0)) / 14)[:, None]], axis=1)
    return at, ids, weight, stats


def _with_bins(at: np.ndarray, ids: np.ndarray, weight: np.ndarray, stats: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each document followed by its statistics' bins, each bin a feature of its own."""
    n, m = stats.shape
    bins = np.stack([np.searchsorted(cuts[j], stats[:, j], side="right") for j in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
    extra = WORD_BUCKETS + np.arange(m) * BINS + bins
    place = np.repeat(at[1:], m)
    return at + np.arange(n + 1) * m, np.insert(ids, place, extra.ravel()), np.insert(weight, place, 1 / np.sqrt(m))


def _segments(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of each document; every document has at least its bins."""
    return np.add.reduceat(values, at[:-1], axis=0) if len(at) > 1 else np.zeros((0, *values.shape[1:]))


def raw_scores(model: dict, at: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds, and each document's sum of weighted factors."""
    scaled = model["v"][ids] * weight[:, None].astype(np.float32)
    sums = _segments(scaled, at)
    squares = _segments(scaled * scaled, at)
    return model["b"] + _segments(model["w"][ids] * weight, at) + 0.5 * (sums * sums - squares).sum(axis=1), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> dict:
    """Adagrad on the logistic loss over (ids, weights, statistics) of each labelled document, until the loss is small or falls no more."""
    rng = np.random.default_rng(seed)
    stats = np.stack([r[2] for r in rows])
    cuts = np.stack([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) for j in range(stats.shape[1])])
    at = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    at, ids, weight = _with_bins(at, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), stats, cuts)
    size = WORD_BUCKETS + stats.shape[1] * BINS
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    model = {"b": np.log(mean / (1 - mean)), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), "cuts": cuts}
    gw, gv = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3, np.float32)
    last = np.inf
    for _ in range(MOST_EPOCHS):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // STEP_ROWS)):
            lengths = at[part + 1] - at[part]
            own = np.repeat(at[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            i, x, a = ids[own], weight[own], np.concatenate(([0], np.cumsum(lengths)))
            z, sums = raw_scores(model, a, i, x)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            each = np.repeat(slope, lengths)
            held, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, weights=each * x) + DECAY * model["w"][held]
            scaled = model["v"][i] * x[:, None]
            step = (each * x)[:, None] * (np.repeat(sums, lengths, axis=0) - scaled)
            dv = np.stack([np.bincount(back, weights=step[:, k]) for k in range(FACTORS)], axis=1) + DECAY * model["v"][held]
            gw[held] += dw**2
            gv[held] += dv**2
            model["w"][held] -= RATE * dw / np.sqrt(gw[held])
            model["v"][held] -= RATE * dv / np.sqrt(gv[held])
            model["b"] -= RATE * slope.sum()
        z = raw_scores(model, at, ids, weight)[0]
        loss = float(np.logaddexp(0, np.where(labels > 0, -z, z)).mean())
        if loss < LEAST_LOSS or loss > last * (1 - LEAST_GAIN):
            break
        last = loss
    return model


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", chars: str | None = "n_chars", label: str = "quality", train_rows: int = TRAIN_ROWS) -> dict | None:
    """The model, from at most ``train_rows`` labelled rows that are not held out."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(id_column)).select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("label"))
    chosen = marked.orderBy(F.xxhash64(F.lit(11), "id"), "label").limit(train_rows)
    size = F.col(chars).cast("double") if chars else F.length(text).cast("double")
    wanted = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(size, F.lit(0.0)).alias("chars"))
    sample = wanted.join(F.broadcast(chosen), "id").select("label", "text", "chars", F.xxhash64(F.lit(11), "id", "text").alias("h"))
    schema = struct_of(label=T.DoubleType(), h=T.LongType(), ids=T.ArrayType(T.IntegerType()), weights=T.ArrayType(T.FloatType()), stats=T.ArrayType(T.DoubleType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH):
            at, ids, weight, stats = features(batch.column("text"), batch.column("chars").to_numpy())
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), lists(ids.astype(np.int32), pa.int32()), lists(weight.astype(np.float32), pa.float32()), pa.array(list(stats), pa.list_(pa.float64()))], names=schema.names)

    # One sample's features: train_rows documents of at most WORD_BUCKETS words each, however large the tables and long the texts.
    found = sample.mapInArrow(encode, schema).orderBy("h", "label").limit(train_rows).toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    if not found.num_rows:
        return None
    rows = list(zip(*[[np.asarray(x.values, d) for x in found.column(c)] for c, d in (("ids", np.int64), ("weights", float), ("stats", float))], strict=True))
    return fit(rows, (found.column("label").to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: dict | None, id_column: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """id and score of every row of ``docs``."""
    schema = T.StructType([docs.select(id_column).schema[0], T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # WORD_BUCKETS + bins rows of FACTORS + 1 numbers
    size = F.col(chars).cast("double") if chars else F.length(text).cast("double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH):
            own = held.value
            if own is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                at, ids, weight = _with_bins(*features(batch.column("text"), batch.column("chars").to_numpy()), own["cuts"])
                z, _ = raw_scores(own, at, ids, weight)
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=schema.names)

    return docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(size, F.lit(0.0)).alias("chars")).mapInArrow(apply, schema)
