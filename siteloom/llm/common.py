"""Helpers shared by the training-data operators: Arrow batches, words, and the staging and components of the base engine."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.operators.graph import components
from siteloom.operators.staging import cleaning, drop_staged, shared_dir, staged, staged_alone

__all__ = ["WORD", "cleaning", "components", "drop_staged", "encoded_words", "id_crc", "rebatched", "shared_dir", "split_words", "staged", "staged_alone", "struct_of", "text_key", "trim"]

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def text_key(text: str | Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text in shuffles; null counts as empty."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(value).alias("k1"), F.xxhash64(F.lit(77), value).alias("k2")]


def id_crc(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and keep what they once took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def rebatched(batches: Iterator[pa.RecordBatch], max_bytes: int, max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of about ``max_bytes`` each, however the input came; one huge row stays whole."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            share = batch.nbytes * part.num_rows // batch.num_rows
            if held and (size + share > max_bytes or rows + part.num_rows > max_rows):
                yield pa.concat_batches(held)
                trim()
                held, size, rows = [], 0, 0
            held.append(part)
            size += share
            rows += part.num_rows
    if held:
        yield pa.concat_batches(held)
    held.clear()
    trim()


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and all words of the texts in order; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    return offsets, flat


def encoded_words(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """For each word its place in the list of distinct words, and that list."""
    if not len(flat):
        return np.zeros(0, np.int64), []
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
