"""Token counts of whole texts, without a shuffle of the corpus.

A byte-level tokenizer encodes every pre-token on its own, so a text's count
is the sum of its pre-tokens' lengths. Those of the most frequent pre-tokens
are broadcast as one compact table of at most ``FREQUENT`` entries; what it
lacks is encoded once and kept in a bounded cache of the Python worker. Both
only save work: the counts are the tokenizer's own for every text.

The table is learned from about ``SAMPLE_ROWS`` documents picked by a hash of
their id; only that sample's counts are shuffled.

Texts of Latin letters and common punctuation are cut by the tokenizer's
published pattern; a text with any other character is cut by the tokenizer's own
pre-tokenizer, since the classes of rarer characters differ between versions of
Unicode. Added tokens standing in a text are found first, as the library does.

Null texts count as empty: no bytes, no tokens. Repeated rows are each counted;
ids may be null. Texts are read whole, whatever their length. An empty table
gives no rows; columns that are not named play no part.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import rebatched, struct_of
from siteloom.llm.packing import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
SAMPLE_ROWS = 4096
FREQUENT = 1 << 15
KEPT = 1 << 18  # pre-tokens in a worker's cache
SHORT = 64  # characters of a pre-token that is worth keeping

#: Characters of which every version of Unicode says the same: Latin letters and signs up to U+024F, and common punctuation.
SETTLED = "\x00-ɏ‐-‧‰-⁞€"
#: White space by the Unicode property, spelled out.
SPACE = "\t-\r \x85\xa0  -     　"

_loaded: dict[str, Encoder] = {}
_tables: dict[int, dict[str, int]] = {}


class Encoder:
    """Counts tokens with one tokenizer; its cache lives as long as the worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added) or self.tokenizer.normalizer is not None:
            raise ValueError("only tokenizers without a normalizer, whose added tokens stand for themselves, are counted by parts")
        self.added = re.compile("|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"]))) or r"(?!)")
        self.other = re.compile(f"[^{SETTLED}]")
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        if self.other.search(text) is None:
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, pretokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]

    def count(self, text: str, frequent: dict[str, int]) -> int:
        parts = self.added.split(text)
        total = len(parts) - 1
        for part in parts:
            pretokens = self.pretokens(part)
            found = list(map(frequent.get, pretokens))
            if None not in found:
                total += sum(found)
                continue
            missed = [p for p, n in zip(pretokens, found, strict=True) if n is None]
            total += sum(n for n in found if n is not None)
            new = [p for p in set(missed) if p not in self.cache]
            fresh = dict(zip(new, self.lengths(new), strict=True)) if new else {}
            total += sum(self.cache[p] if p in self.cache else fresh[p] for p in missed)
            if len(self.cache) + len(fresh) > KEPT:
                self.cache.clear()
            self.cache.update((p, n) for p, n in fresh.items() if len(p) <= SHORT)
        return total


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def frequent_pretokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> bytes:
    """The table as an Arrow stream: pre-tokens of up to ``SHORT`` characters and their lengths, the most frequent of about ``rows`` documents."""
    path = path or tokenizer_path(TOKENIZER)
    one_in = max(1, docs.count() // rows)
    sample = docs.where((F.pmod(F.xxhash64(F.lit(13), id_column), F.lit(one_in)) == 0) & F.col(text).isNotNull()).select(F.col(text).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = _encoder(path), Counter()
        for batch in rebatched(batches, 4 << 20):
            for value in batch.column("text").to_pylist():
                seen.update(p for part in own.added.split(value) for p in own.pretokens(part) if len(p) <= SHORT)
            if len(seen) > KEPT:
                yield table(seen)
                seen.clear()
        yield table(seen)

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "n"])

    top = sample.mapInArrow(tally, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "pretoken").limit(most)
    own = _encoder(path)
    chosen = [r["pretoken"] for r in top.collect()]
    found = pa.table({"pretoken": pa.array(chosen, pa.string()), "length": pa.array(own.lengths(chosen) if chosen else [], pa.uint16())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return sink.getvalue().to_pybytes()


def token_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, frequent: bytes | None = None) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of every row; ``frequent`` is learned where none is given."""
    path = path or tokenizer_path(TOKENIZER)
    if frequent is None:
        frequent = frequent_pretokens(docs, id_column, text, path)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.octet_length(value).cast("long").alias("n_bytes"), value.alias("text"))
    schema = T.StructType([rows.schema["id"], *struct_of(n_bytes=T.LongType(), n_tokens=T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = _encoder(path), _opened(shared.value)
        for batch in rebatched(batches, 4 << 20):
            counts = [own.count(v, held) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=schema.names)

    counted = rows.mapInArrow(count, schema)
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _opened(frequent: bytes) -> dict[str, int]:
    """The table as a worker reads it, once."""
    key = hash(frequent)
    if key not in _tables:
        _tables.clear()
        with pa.ipc.open_stream(frequent) as source:
            held = source.read_all()
        _tables[key] = dict(zip(held["pretoken"].to_pylist(), held["length"].to_pylist(), strict=True))
    return _tables[key]
