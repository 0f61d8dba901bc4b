"""Packing documents into training sequences, first-fit decreasing.

Tokens are made once per document inside Spark tasks. A document is cut into
pieces of ``capacity`` ids and one remainder. Every piece is dealt on its own,
by a hash, to one of groups of about ``group_pieces`` pieces, and each group
is packed on its own: longest piece first, into the first sequence with room,
which a tournament tree of the sequences' free space finds in logarithmic
time. So a group is bounded however large the corpus, one source or one
document is, and the result is the same on any cluster.

Null text counts as empty: such a document is its end id alone. Rows alike in
id and tokens are counted before they are dealt, and packed once each, told
apart by ``copy`` (from 1). Very long texts give many full pieces. Ties in
length go by document id, then by tokens, place and copy. An empty table gives
no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import encoded_words, rebatched, split_words, staged

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 2048
SEED = 20240917

#: Words of these shapes are one or two of the tokenizer's units, so that many can be encoded in one call.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKED = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!\"#$%&*+,./:;=?@|\-]+$"

_loaded: dict[str, tuple] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str) -> tuple:
    """The tokenizer, which of its ids end a unit, and an added token for separating words."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        ends = np.zeros(max(vocab.values()) + 1 + 16, bool)
        ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        added = json.loads(tokenizer.to_str())["added_tokens"]
        separator = next(((x["content"], x["id"]) for x in added if x["special"]), None)
        _loaded[path] = tokenizer, ends, separator
    return _loaded[path]


def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def word_ids(path: str, words: list[str], per_call: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of each distinct word.

    The tokenizer never joins text across white space, so a word's ids are the
    same alone as in its text. Words of plain shape are encoded many to a call
    and told apart by the ids that end a unit; if the units of a call do not add
    up, and for all other words, the words are kept apart by an added token, or
    encoded alone where they hold one.
    """
    tokenizer, ends, separator = _tokenizer(path)
    array = pa.array(words, pa.string())
    units = np.asarray(pc.match_substring_regex(array, PLAIN)).astype(np.int64) + 2 * np.asarray(pc.match_substring_regex(array, MARKED)).astype(np.int64)
    alone = np.asarray(pc.match_substring(array, "<|")) | (separator is None)
    lengths = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word numbers in order, their ids)

    def by_separator(which: np.ndarray) -> None:
        token, token_id = separator
        for at in range(0, len(which), per_call):
            own = which[at : at + per_call]
            ids = np.asarray(_ids(tokenizer, [token.join([words[i] for i in own]) + token])[0], np.uint32)
            cuts = np.flatnonzero(ids == token_id)
            if len(cuts) != len(own):
                one_by_one(own)
                continue
            lengths[own] = np.diff(np.concatenate(([-1], cuts))) - 1
            parts.append((own, np.delete(ids, cuts)))

    def one_by_one(which: np.ndarray) -> None:
        for i in which:
            ids = _ids(tokenizer, [words[i]])[0]
            lengths[i] = len(ids)
            parts.append((np.asarray([i]), np.asarray(ids, np.uint32)))

    plain = np.flatnonzero((units > 0) & ~alone)
    odd: list[np.ndarray] = [np.flatnonzero((units == 0) & ~alone)]
    chunks = [plain[at : at + per_call] for at in range(0, len(plain), per_call)]
    for own in chunks:  # an encoding takes far more room than its ids, so one at a time
        ids = np.asarray(_ids(tokenizer, [" ".join([words[i] for i in own])])[0], np.uint32)
        last = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)])
        after = np.cumsum(units[own])
        if len(last) != after[-1] or last[-1] != len(ids) - 1:
            odd.append(own)
            continue
        lengths[own] = np.diff(np.concatenate(([-1], last[after - 1])))
        parts.append((own, ids))
    by_separator(np.concatenate(odd))
    one_by_one(np.flatnonzero(alone))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    out = np.zeros(offsets[-1], np.uint32)
    for own, ids in parts:
        if len(ids):
            out[gather(offsets[own], lengths[own])] = ids
    return offsets, out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def token_batches(batches: Iterator[pa.RecordBatch], text: str, path: str, end_id: int | None, max_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, offsets, ids) of whole texts, each document's ids followed by ``end_id``."""
    for batch in rebatched(batches, max_bytes):
        offsets, flat = split_words(batch.column(text))
        index, words = encoded_words(flat)
        starts, ids = word_ids(path, words)
        if end_id is not None:
            index = np.insert(index, offsets[1:], len(words))
            offsets = offsets + np.arange(len(offsets))
            starts, ids = np.append(starts, starts[-1] + 1), np.append(ids, np.uint32(end_id))
        lengths = starts[index + 1] - starts[index]
        at = np.concatenate(([0], np.cumsum(lengths)))
        yield batch, at[offsets], ids[gather(starts[index], lengths)].astype("<u4")


def pieces(docs: DataFrame, id_column: str, text: str, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Every document cut into pieces: id, document (a hash of all its ids), start, length, ids_crc32, doc_tokens, tokens if asked for."""
    wanted = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([wanted.schema["id"], *(T.StructField(n, T.LongType()) for n in ("document", "start", "length", "ids_crc32", "doc_tokens")), *([T.StructField("tokens", T.BinaryType())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, offsets, ids in token_batches(batches, "text", path, end_id):
            of, whole, start, length, crc, tokens = [], [], [], [], [], []
            for i in range(batch.num_rows):
                whole.append(xxhash.xxh3_64_intdigest(ids[offsets[i] : offsets[i + 1]].tobytes()))
                for at in range(int(offsets[i]), int(offsets[i + 1]), capacity):
                    piece = ids[at : min(at + capacity, offsets[i + 1])].tobytes()
                    of.append(i)
                    start.append(at - int(offsets[i]))
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        tokens.append(piece)
            of = np.asarray(of, np.int64)
            columns = [batch.column("id").take(pa.array(of)), pa.array(np.asarray(whole, np.uint64).view(np.int64)[of]), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.diff(offsets)[of], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(tokens, pa.binary())] if with_ids else []), names=schema.names)

    return wanted.mapInArrow(cut, schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; ``lengths`` must be in falling order.

    A tournament tree holds the free space of every bin at its leaves and the
    larger of its two children at every inner node, so that the first bin with
    room is found from the root down.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - tree[node])
        tree[node] -= length
        node //= 2
        while node:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = SEED, with_ids: bool = False, with_copy: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and offset; ``tokens`` holds its ids if ``with_ids``; ``document`` and ``copy`` tell rows of one id apart if ``with_copy``."""
    cut = pieces(docs, id_column, text, path or tokenizer_path(), capacity, end_id, with_ids)
    key = ["id", "document", "start"]
    alike = staged(cut.groupBy(*key).agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in cut.columns if c not in key)))
    total = alike.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_pieces))
    each = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    dealt = each.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), *key, "copy"), F.lit(groups)))
    kept = [f for f in dealt.schema if f.name != "group" and (with_copy or f.name not in ("document", "copy"))]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in (*key, "copy"))]
        table = table.take(pc.sort_indices(table.select([c for c, _ in order]), sort_keys=order))
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        ids = np.asarray(bins, np.int64) + (table.column("group")[0].as_py() << 32)
        return table.select([f.name for f in kept]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("group").applyInArrow(fit, schema).withColumnRenamed("id", id_column)
