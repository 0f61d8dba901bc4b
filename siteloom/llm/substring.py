"""Removing repeated passages: seed by winnowed anchors, extend, keep maximal repeats.

A window is ``length`` consecutive words. Every window picks an anchor, the
first of its smallest ``gram``-word hashes, so equal windows pick the same
anchor at the same place, and a run of neighbouring windows shares one. The
words around an anchor that its windows cover are its context.

Seed: anchors are joined by their hash. Extend: places of an anchor with equal
contexts agree both ways as far as its windows reach. Only where an anchor
has several contexts, and one of them stands alone, are the contexts' windows
compared one by one; a class of equal contexts sends one representative, so
the work grows with the different contexts and never with the pairs of places.
Keep: the words under repeated windows, joined into maximal spans.

Texts are told apart by two 64-bit hashes, contexts and windows by two others.

A null or empty text has no words. Texts shorter than ``length`` words lose
none. Repeated rows count one by one, so a text that stands twice loses every
word that a window covers. Null and repeated ids do no harm, for nothing is
joined by id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import drop_staged, encoded_words, rebatched, split_words, staged, struct_of, text_key

LENGTH = 35
GRAM = 8
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd multipliers of the two rolling hashes
BATCH = 6 << 20

_held_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
LONG = T.LongType()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if base not in _held_powers or len(_held_powers[base][0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(base, -1, 1 << 64)
        steps = [np.full(size, b, np.uint64) for b in (base, inverse)]
        for s in steps:
            s[0] = 1
        _held_powers[base] = tuple(np.multiply.accumulate(s) for s in steps)
    return _held_powers[base][0][:n], _held_powers[base][1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result looks random."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a batch of texts, with rolling hashes of any run of them."""

    def __init__(self, text: pa.Array):
        import xxhash

        self.offsets, flat = split_words(text)
        index, distinct = encoded_words(flat)
        self.n = len(index)
        self.sums = []
        for seed, base in enumerate(BASES):
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))
            power, _ = powers(base, self.n + 1)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[index] * power[: self.n], dtype=np.uint64))))

    def run(self, which: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hash of the ``length`` words from ``start``; it depends on those words alone."""
        _, inverse = powers(BASES[which], self.n + 1)
        return mixed((self.sums[which][start + length] - self.sums[which][start]) * inverse[start])


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its first smallest one."""
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


def anchors_of(words: Words, length: int, gram: int) -> dict[str, np.ndarray]:
    """Each anchor: its text, first window, number of windows, anchor hash and context hash."""
    sizes = np.diff(words.offsets)
    ends = np.repeat(words.offsets[1:], sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "first", "windows", "anchor", "context")}
    if words.n < length:
        return empty
    starts = np.arange(words.n - length + 1)
    valid = starts + length <= ends[: len(starts)]
    if not valid.any():
        return empty
    grams = words.run(0, np.arange(words.n - gram + 1), gram)
    at = first_least(grams, length - gram + 1)[: len(starts)]
    starts, at, owner = starts[valid], at[valid], doc[: len(valid)][valid]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    head = np.flatnonzero(new)
    windows = np.diff(np.concatenate((head, [len(at)])))
    first, place, owner = starts[head], at[head], owner[head]
    context = words.run(1, first, windows + length - 1) ^ mixed(((place - first) * 64 + windows).astype(np.uint64))
    return {"doc": owner, "first": first - words.offsets[owner], "windows": windows, "anchor": grams[place].view(np.int64), "context": context.view(np.int64)}


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind)


def spans(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """k1, k2 of a text with its repeated windows as ``spans``: an array of (first word, number of words)."""
    if not 1 <= gram <= length <= 64:
        raise ValueError("gram must be within length, and length at most 64")
    keyed = docs.select(*text_key(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchor_schema = struct_of(k1=LONG, k2=LONG, first=T.IntegerType(), windows=T.ShortType(), anchor=LONG, context=LONG)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH):
            found = anchors_of(Words(batch.column("text")), length, gram)
            own = pa.array(found["doc"])
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(own), batch.column("k2").take(own), _array(found["first"], pa.int32()), _array(found["windows"], pa.int16()), _array(found["anchor"], pa.int64()), _array(found["context"], pa.int64())], names=anchor_schema.names)

    anchors = staged(keyed.mapInArrow(seed, anchor_schema))
    place = F.struct("k1", "k2", "first", "windows")
    contexts = staged(anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("place")))
    seeds = contexts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
    # Equal contexts: all their windows are repeated.
    repeated = contexts.where("n > 1").select("anchor", "context")
    whole = anchors.join(repeated, ["anchor", "context"]).select("k1", "k2", "first", (F.col("windows") + F.lit(length - 1)).cast("int").alias("words")).distinct()
    # Anchors with several contexts of which one stands alone: their windows decide.
    open_ones = contexts.join(seeds.where("contexts > 1 AND least = 1").select("anchor"), "anchor")
    todo = open_ones.select("place.k1", "place.k2", F.struct(F.col("place.first").alias("first"), F.col("place.windows").cast("int").alias("windows"), (F.col("n") == 1).alias("alone")).alias("at"))
    todo = staged(todo.groupBy("k1", "k2").agg(F.collect_set("at").alias("todo")))  # at most a row's own anchors
    whole = staged(whole)
    drop_staged(anchors, contexts)
    window_schema = struct_of(w1=LONG, w2=LONG, k1=LONG, k2=LONG, first=T.IntegerType(), alone=T.BooleanType())

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in rebatched(batches, BATCH):
            # A task extends a text once, however many copies of it the join, which Spark may split, brings.
            fresh = []
            for i, key in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            words = Words(batch.column("text"))
            lists = batch.column("todo")
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()).astype(np.int64))
            at = lists.flatten()
            first, windows, alone = (np.asarray(at.field(i)) for i in range(3))
            windows = windows.astype(np.int64)
            doc, alone = np.repeat(doc, windows), np.repeat(alone, windows)
            before = np.cumsum(windows) - windows
            first = np.repeat(first - before, windows) + np.arange(len(doc))
            start = first + words.offsets[doc]
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([_array(words.run(0, start, length).view(np.int64), pa.int64()), _array(words.run(1, start, length).view(np.int64), pa.int64()), batch.column("k1").take(own), batch.column("k2").take(own), _array(first, pa.int32()), pa.array(alone, pa.bool_())], names=window_schema.names)

    windows = staged(keyed.join(todo, ["k1", "k2"]).select("k1", "k2", "text", "todo").mapInArrow(extend, window_schema))
    drop_staged(todo)
    at = F.struct("k1", "k2", "first")
    shared = windows.groupBy("w1", "w2").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("w1", "w2")
    single = windows.where("alone").join(shared, ["w1", "w2"]).select("k1", "k2", "first", F.lit(length).alias("words")).distinct()
    found = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "words")).alias("spans"))
    out = staged(found)
    drop_staged(whole, windows)
    return out


def kept_mask(n: int, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """True for the words that no span covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(first + words, n), -1)
    return np.cumsum(change[:n]) == 0


def with_spans(docs: DataFrame, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, its text, and ``repeated``: the spans of its repeated windows, null where it has none."""
    found = spans(docs, text, length, gram)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_key(text))
    joined = keyed.join(found, ["k1", "k2"], "left")
    return joined.select("row", F.col("row")[text].alias("text"), F.col("spans").alias("repeated"))


def _mask(n: int, spans_of: pa.Array, i: int) -> np.ndarray:
    own = spans_of[i].values
    return kept_mask(n, np.asarray(own.field(0)), np.asarray(own.field(1)))


def digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    found = with_spans(docs.select(F.col(id_column), F.col(text).alias("text")), "text", length, gram)
    found = found.select(F.col("row")[id_column].alias(id_column), "text", "repeated")
    schema = T.StructType([docs.select(id_column).schema[0], T.StructField("n_words", LONG), T.StructField("n_removed", LONG), T.StructField("kept_sha256", T.StringType())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH):
            total, removed, sha = [], [], []
            spans_of = batch.column("repeated")
            for i, value in enumerate(batch.column("text").to_pylist()):
                words = (value or "").encode().split()
                total.append(len(words))
                if spans_of[i].is_valid:
                    keep = _mask(len(words), spans_of, i)
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(total[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    return found.mapInArrow(summarise, schema)


def cut(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with its repeated words gone; a text without any stays as it is, white space included.

    In a cut text every stretch of kept words keeps its own white space, and
    stretches that a cut parts are joined by a line break.
    """
    found = with_spans(docs, text, length, gram)
    others = [c for c in docs.columns if c != text]
    found = found.select(F.struct(F.lit(0).alias("none"), *(F.col("row")[c].alias(f"c{i}") for i, c in enumerate(others))).alias("row"), "text", "repeated")
    schema = T.StructType([found.schema["row"], T.StructField("text", T.StringType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in rebatched(batches, BATCH):
            spans_of = batch.column("repeated")
            values = batch.column("text").to_pylist()
            for i, value in enumerate(values):
                if not spans_of[i].is_valid:
                    continue
                data = value.encode()
                at = [m.span() for m in word.finditer(data)]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], _mask(len(at), spans_of, i).astype(np.int8), [0]))))
                values[i] = b"\n".join(data[at[a][0] : at[b - 1][1]] for a, b in edges.reshape(-1, 2)).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, batch.column("text").type)], names=schema.names)

    cut_rows = found.mapInArrow(rewrite, schema)
    return cut_rows.select(*(F.col("text").alias(c) if c == text else F.col("row")[f"c{others.index(c)}"].alias(c) for c in docs.columns))
