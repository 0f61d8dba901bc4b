"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's 64-bit fingerprint is the majority vote of its shingles' hashes. Two
fingerprints within ``radius`` bits always share some value within half of
``radius`` of both. So every distinct fingerprint emits all values within half
the radius, the values are shuffled, and the fingerprints that meet at one
value are linked to the least of them: all of these are within ``radius`` of
each other, so a star loses no connection that the pairs would make, and the
links stay as many as the meetings. Each link's distance is checked.

The values are 2081 to a fingerprint at radius 4. Each is made once and travels
as 10 bytes, the value and the number of the mask that gives the fingerprint
back, packed into a block for each batch and bucket. They go in ``slices``, a
fixed number, one after another, so that the disk in use is one slice's. So
the shuffle is 20 KB a distinct fingerprint, and grows in proportion. A value
is held by at most 2081 distinct fingerprints, so no bucket can be hot,
however many copies a text has.

Null and empty texts have fingerprint 0 and link like any other. Texts with
fewer words than a shingle hash their words as one. Repeated rows, also with
equal ids, are each returned; null ids never name a component unless all its
ids are null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import components, drop_staged, encoded_words, rebatched, split_words, staged, struct_of, trim
from siteloom.llm.substring import mixed

SHINGLE = 4
RADIUS = 4
SEED = 42
SLICES = 8
BATCH = 8192  # fingerprints whose values share a block
PER_BUCKET = 1 << 20  # values that meet in one task
SPREAD = 0xC2B2AE3D27D4EB4F  # an odd number that tells the hashes of one word apart
PRINTS = 12  # word fingerprints of a text
WIDTH = 48  # bits of each
PRINT_RADIUS = 2
CENTRE_PRINTS = 3  # of them decide which text lies in the middle of a group
CHUNK = 8192  # words whose votes are counted at once
TILE = 256  # texts whose sets of shingles share a block
TILE_BYTES = 8 << 20
COLUMNS = 8192  # shingles that are counted at once
TEXT_PARTS = 4  # in which the texts of candidates are sought, one after another
NODE = "V16"  # a text's 128 bits


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``size`` words, A-Z lower-cased, joined by one space."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.asarray(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and ``fp``, the fingerprint as a signed 64-bit number."""
    schema = T.StructType([docs.select(id_column).schema[0], T.StructField("fp", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 8 << 20):
            found = [majority(shingle_hashes(x, shingle)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(found, np.uint64).view(np.int64))], names=schema.names)

    return docs.select(F.col(id_column), F.col(text).alias("text")).mapInArrow(compute, schema)


def ball(half: int, width: int = 64) -> np.ndarray:
    """All masks of at most ``half`` of the lowest ``width`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(width), k)], np.uint64)


def slice_of(values: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each value: parities of half of its bits, so that slice(a ^ b) = slice(a) ^ slice(b)."""
    planes = mixed(np.arange(1, slices.bit_length(), dtype=np.uint64) * np.uint64(SPREAD))
    out = np.zeros(len(values), np.int64)
    for k, plane in enumerate(planes):
        out |= (np.bitwise_count(values & plane).astype(np.int64) & 1) << k
    return out


def slice_values(prints: np.ndarray, masks: np.ndarray, part: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``prints`` that fall into slice ``part``, and the number of the mask that made each.

    As slices are linear, the masks that lead a fingerprint into a slice are
    known beforehand, and no value is made that another slice holds.
    """
    of_print, of_mask = slice_of(prints, slices), slice_of(masks, slices)
    values, numbers = [], []
    for own in range(slices):
        some, which = prints[of_print == own], np.flatnonzero(of_mask == own ^ part).astype(np.uint16)
        values.append((some[:, None] ^ masks[which][None, :]).ravel())
        numbers.append(np.tile(which, len(some)))
    return np.concatenate(values), np.concatenate(numbers)


def value_blocks(values: np.ndarray, numbers: np.ndarray, bits: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The values dealt into ``2 ** bits`` buckets: a bucket's name, values and mask numbers; 10 bytes a value, however many buckets there are."""
    bucket = (mixed(values) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(values), np.uint16)
    order = np.argsort(bucket, kind="stable")
    values, numbers = values[order], numbers[order]
    names, heads = np.unique(bucket[order], return_index=True)
    ends = np.append(heads[1:], len(values))
    return names.astype(np.int32), *([x[a:b].tobytes() for a, b in zip(heads, ends, strict=True)] for x in (values, numbers))


def links(fps: DataFrame, radius: int = RADIUS, slices: int = SLICES, width: int = 64) -> DataFrame:
    """(fp, to): links among the distinct fingerprints in ``fps`` that connect all within ``radius``.

    Only the lowest ``width`` bits may differ. ``slices`` is a power of two.
    """
    masks = ball((radius + 1) // 2, width)
    count = fps.count()
    bits = min(30, max(0, int(np.ceil(np.log2(max(1, count * len(masks) / slices / PER_BUCKET))))))
    block = struct_of(bucket=T.IntegerType(), values=T.BinaryType(), masks=T.BinaryType())
    edge = struct_of(fp=T.LongType(), to=T.LongType())
    dealt = fps.repartition(max(1, -(-count // BATCH)), "fp")

    def emit_for(part: int):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rebatched(batches, 1 << 30, BATCH):
                for at in range(0, batch.num_rows, BATCH):
                    own = np.asarray(batch.column("fp").slice(at, BATCH)).view(np.uint64)
                    names, values, numbers = value_blocks(*slice_values(own, masks, part, slices), bits)
                    trim()
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.binary()), pa.array(numbers, pa.binary())], names=block.names)

        return emit

    def meet(table: pa.Table) -> pa.Table:
        trim()
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("values")])
        numbers = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("masks")])
        ordered = np.sort(values)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        low = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[mixed(twice) & low] = True
        some = np.flatnonzero(maybe[mixed(values) & low]) if len(twice) else np.zeros(0, np.int64)
        some = some[np.isin(values[some], twice)]
        v, fp = values[some], values[some] ^ masks[numbers[some]]
        order = np.lexsort((fp, v))
        v, fp = v[order], fp[order]
        new = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
        least = fp[np.flatnonzero(new)][np.cumsum(new) - 1] if len(v) else fp
        far = np.bitwise_count(fp ^ least)
        good = (far > 0) & (far <= radius)
        pairs = np.unique(np.stack([fp[good], least[good]], axis=1), axis=0) if good.any() else np.zeros((0, 2), np.uint64)
        return pa.table({name: pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k, name in enumerate(edge.names)})

    met = [staged(dealt.mapInArrow(emit_for(part), block).repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(meet, edge)) for part in range(slices)]
    out = staged(reduce(DataFrame.unionByName, met).distinct())
    drop_staged(*met)
    return out


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, slices: int = SLICES) -> DataFrame:
    """id, ``fp`` and ``component_id``, the least id of all documents reachable by links."""
    own = staged(fingerprints(docs, id_column, text, shingle))
    least = staged(own.groupBy("fp").agg(F.min(id_column).alias("least")))
    edges = links(least.select("fp"), radius, slices)
    found = components(docs.sparkSession, edges, "fp", "to")
    rooted = least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    drop_staged(least, edges, found)
    return own.join(named, "fp").select(id_column, "fp", "component_id")


def text_nodes(texts: list[str | None]) -> list[bytes]:
    """128 bits that stand for each text's lower-cased words in order."""
    import xxhash

    return [xxhash.xxh3_128_digest(b" ".join((x or "").encode().lower().split())) for x in texts]


def word_fingerprints(text: pa.Array, prints: int = PRINTS) -> np.ndarray:
    """``prints`` fingerprints of ``WIDTH`` bits of each text, the number of the fingerprint in the bits above them.

    The votes are those of the distinct words, each with the square root of
    its count: a few changed words move few bits, and common words alone do
    not decide them.
    """
    import xxhash

    offsets, flat = split_words(text)
    index, words = encoded_words(flat)
    base = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in words), np.uint64, len(words))
    n, columns = len(text), prints * WIDTH
    doc = np.repeat(np.arange(n), np.diff(offsets))
    base, same = np.unique(base, return_inverse=True)
    key, count = np.unique(doc * max(1, len(base)) + same[index], return_counts=True) if len(index) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    owner, word = key // max(1, len(base)), key % max(1, len(base))
    weight = np.sqrt(count).astype(np.float32)
    hashes = np.stack([mixed(base + np.uint64(seed * SPREAD & (1 << 64) - 1)) for seed in range(1, -(-columns // 64) + 1)], axis=1)
    signs = np.unpackbits(hashes.byteswap().view(np.uint8), axis=1)[:, :columns].astype(np.int8) * np.int8(2) - np.int8(1)
    votes = np.zeros((n, columns), np.float32)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        for a in range(bounds[i], bounds[i + 1], CHUNK):
            b = min(a + CHUNK, bounds[i + 1])
            votes[i] += weight[a:b] @ signs[word[a:b]].astype(np.float32)
    packed = np.zeros((n, prints, 8), np.uint8)
    packed[:, :, 8 - WIDTH // 8 :] = np.packbits((votes > 0).reshape(n, prints, WIDTH), axis=2)
    return packed.view(">u8").reshape(n, prints).astype(np.uint64) | (np.arange(prints, dtype=np.uint64) << np.uint64(WIDTH))


def jaccard(a: str | None, b: str | None, size: int) -> float:
    """Shared over all distinct shingles of ``size`` words; of two texts without words 1."""
    x, y = set(shingle_hashes(a, size)), set(shingle_hashes(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def alike(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of ``a`` have a Jaccard similarity of ``similarity`` or more to which of ``b`` (None: of ``a``)."""
    every = a if b is None else a + b
    sizes = np.array([len(x) for x in every], np.int64)
    values, place = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_inverse=True)
    often = np.bincount(place, minlength=len(values)) > 1
    owner, column = np.repeat(np.arange(len(every)), sizes)[often[place]], (np.cumsum(often) - 1)[place[often[place]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = np.arange(len(a)), np.arange(len(a)) if b is None else np.arange(len(a), len(every))
    shared = np.zeros((len(left), len(right)))
    for at in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(every), min(COLUMNS, int(often.sum()) - at)), np.float32)
        held[owner[i:j], column[i:j] - at] = 1
        shared += held[left] @ held[right].T
    return shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared)


def stars(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    n = len(near)
    label = np.arange(n)
    while n:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def tile_links(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect all alike texts of each group but those in one component already.

    ``groups`` has node, group, loose and ``of``. Texts go in blocks to the
    other blocks of their group; blocks of one large component (not loose,
    equal ``of``) don't meet each other. A pair of blocks returns a star for
    each component it finds.
    """
    key = ["group", "loose", "of"]
    held = groups.join(sets, "node")
    parts = held.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("shingles")) / TILE_BYTES)).alias("blocks"))
    dealt = held.join(parts, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    block = struct_of(name=T.StringType(), group=T.BinaryType(), loose=T.BooleanType(), of=T.BinaryType(), nodes=T.BinaryType(), sizes=T.BinaryType(), hashes=T.BinaryType())

    def pack(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        name = ":".join(str(x.hex() if isinstance(x, bytes) else x) for x in (first[k] for k in (*key, "block")))
        row = {"name": name, **{k: first[k] for k in key}, "nodes": b"".join(table.column("node").to_pylist()), "sizes": np.array([len(x) for x in found], np.int64).tobytes(), "hashes": np.concatenate(found).tobytes()}
        return pa.table({f: [row[f]] for f in block.names}, schema=pa.schema([("name", pa.string()), ("group", pa.binary()), ("loose", pa.bool_()), ("of", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())]))

    packed = staged(dealt.select("node", *key, "block", "shingles").groupBy(*key, "block").applyInArrow(pack, block))
    a, b = (packed.select("group", F.col("name").alias(f"{x}_name"), F.col("loose").alias(f"{x}_loose"), F.col("of").alias(f"{x}_of")) for x in "ab")
    tiles = staged(a.join(b, "group").where("a_name <= b_name and (a_loose or b_loose or a_of <> b_of)").select("a_name", "b_name"))
    whole = lambda x: packed.select(*(F.col(c).alias(f"{x}_{c}") for c in ("name", "nodes", "sizes", "hashes")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch: pa.RecordBatch, x: str, at: int) -> tuple[np.ndarray, list[np.ndarray]]:
            nodes, sizes = (np.frombuffer(batch.column(f"{x}_{c}")[at].as_buffer(), kind) for c, kind in (("nodes", NODE), ("sizes", np.int64)))
            return nodes, np.split(np.frombuffer(batch.column(f"{x}_hashes")[at].as_buffer(), np.uint64), np.cumsum(sizes)[:-1])

        for batch in batches:
            us, vs = [], []
            for at in range(batch.num_rows):
                nodes, sets_a = side(batch, "a", at)
                if batch.column("a_name")[at] == batch.column("b_name")[at]:
                    near = alike(sets_a, None, similarity)
                else:
                    other, sets_b = side(batch, "b", at)
                    cross = alike(sets_a, sets_b, similarity)
                    n, m = cross.shape
                    near = np.zeros((n + m, n + m), bool)
                    near[:n, n:], near[n:, :n] = cross, cross.T
                    nodes = np.concatenate((nodes, other))
                label = stars(near)
                far = np.flatnonzero(label != np.arange(len(label)))
                us += nodes[far].tolist()
                vs += nodes[label[far]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (us, vs)], names=["u", "v"])
            trim()

    size = packed.select("name", F.length("hashes").alias("size"))
    held_bytes = size.agg(F.sum("size")).first()[0]
    parts = rounds_for(tiles.join(size, tiles["a_name"] == size["name"]).agg(F.sum("size")).first()[0], held_bytes)
    found = []
    for k in range(parts):
        some = tiles.where(F.pmod(F.xxhash64("a_name", "b_name"), F.lit(parts)) == k)
        met = some.join(whole("a"), "a_name").join(whole("b"), "b_name").select("a_name", "b_name", *(f"{x}_{c}" for x in "ab" for c in ("nodes", "sizes", "hashes")))
        found.append(staged(met.mapInArrow(compare, "u binary, v binary")))
    out = staged(reduce(DataFrame.unionByName, found))
    drop_staged(packed, tiles, *found)
    return out


def rounds_for(sent: int | None, held: int | None) -> int:
    """Rounds in which ``sent`` bytes go through a shuffle so that none sends more than is ``held`` anyway: the disk in use follows the texts, not their pairs."""
    return max(1, -(-(sent or 0) // max(1, held or 0)))


def key_blocks(nodes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """``keys``, ``sizes`` of them to a node, dealt into ``2 ** bits`` buckets: a bucket's name, its nodes, how many keys each has there, and the keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(bucket, kind="stable")
    owner, keys = np.repeat(np.arange(len(nodes)), sizes)[order], keys[order]
    names, heads = np.unique(bucket[order], return_index=True)
    for name, a, b in zip(names.tolist(), heads, np.append(heads[1:], len(keys)), strict=True):
        own, counts = np.unique(owner[a:b], return_counts=True)
        yield name, nodes[own].tobytes(), counts.astype(np.uint32).tobytes(), keys[a:b].tobytes()


def rarest(keys: np.ndarray, often: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Of a set of ``size``, some of whose ``keys`` are also in ``often`` sets in all (the others in it alone): those of the rarest that it must share one of with any set alike to it."""
    least = int(np.ceil(similarity * size - 1e-9))
    return keys[np.lexsort((keys, often))][: max(0, size - least + 1 - (size - len(keys)))]


def sharing(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, group) of the texts in ``groups`` (node, group, root) that may be alike to one of another root in their group, in groups of what may be.

    Two sets alike to ``similarity`` share one of the n - ceil(similarity * n) + 1
    rarest shingles of each, whatever order tells what is rare; here it is how many
    texts of the group hold one. Shingles that one text alone holds can't be shared, and
    mostly fill that share of a text that merely has common words with others,
    so it is out. Work and disk grow with the texts, not with their pairs.
    """
    held = staged(groups.join(sets, "node").select("node", "group", "root", "shingles"))
    count = (held.agg(F.sum(F.length("shingles"))).first()[0] or 0) // 8
    bits = min(30, max(0, int(np.ceil(np.log2(max(1, count / PER_BUCKET))))))
    block = struct_of(bucket=T.IntegerType(), nodes=T.BinaryType(), counts=T.BinaryType(), keys=T.BinaryType())
    shared = struct_of(node=T.BinaryType(), keys=T.BinaryType(), often=T.BinaryType())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 32 << 20):
            found = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            sizes = np.array([len(x) for x in found], np.int64)
            own = np.frombuffer(b"".join(x[:8] for x in batch.column("group").to_pylist()), np.uint64)
            keys = mixed(np.concatenate(found) ^ np.repeat(mixed(own), sizes))
            rows = list(key_blocks(np.frombuffer(b"".join(batch.column("node").to_pylist()), NODE), sizes, keys, bits))
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=block.names)

    def meet(table: pa.Table) -> pa.Table:
        trim()
        nodes, counts, keys = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in (("nodes", NODE), ("counts", np.uint32), ("keys", np.uint64)))
        place, times = np.unique(keys, return_inverse=True, return_counts=True)[1:]
        often = times[place].astype(np.uint32)
        kept = often > 1
        owner = np.repeat(np.arange(len(nodes)), counts)[kept]
        own, heads = np.unique(owner, return_index=True)
        ends = np.append(heads[1:], len(owner))
        parts = ([x[a:b].tobytes() for a, b in zip(heads, ends, strict=True)] for x in (keys[kept], often[kept]))
        return pa.table({name: pa.array(x, pa.binary()) for name, x in zip(shared.names, (nodes[own].tolist(), *parts), strict=True)})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 8 << 20):
            own, out = [], []
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                keys, often = (np.concatenate([np.frombuffer(p[c], kind) for p in parts]) for c, kind in (("keys", np.uint64), ("often", np.uint32)))
                out.append(rarest(keys, often, batch.column("size")[i].as_py(), similarity).view(np.int64))
                own += [i] * len(out[-1])
            kept = batch.select(["node", "root"]).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(out))], names=["node", "root", "key"])

    met = staged(held.select("node", "group", "shingles").mapInArrow(emit, block).repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(meet, shared))
    parts = met.groupBy("node").agg(F.collect_list(F.struct("keys", "often")).alias("parts")).join(held.select("node", "root", (F.length("shingles") / 8).cast("long").alias("size")), "node")
    rare = staged(parts.select("node", "root", "size", "parts").mapInArrow(first, "node binary, root binary, key long"))
    drop_staged(met, held)
    least = rare.groupBy("key").agg(F.min("root").alias("v"), F.max("root").alias("w")).where("v < w").select("key", "v")
    joined = components(rare.sparkSession, rare.select("root", "key").distinct().join(least, "key").where("root <> v").select("root", "v"), "root", "v")
    named = joined.select(F.col("node").alias("member"), F.col("root").alias("group"))
    out = staged(rare.select("node", "root").distinct().join(named, F.col("root") == F.col("member")).select("node", "group"))
    drop_staged(rare, joined)
    return out


def similar_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, prints: int = PRINTS, radius: int = PRINT_RADIUS, slices: int = SLICES) -> DataFrame:
    """id, node, root and component_id, where a link is a Jaccard similarity of ``similarity`` or more.

    Candidates are texts of which any of the ``prints`` word fingerprints lie
    within ``radius``; every link is then checked on the whole texts' shingles
    of ``shingle`` words. Texts equal but for case and white space are one
    node, named by 128 bits; ``root`` is the least node of a component and
    ``component_id`` the least id in it. The result is exact in what it links;
    near copies whose fingerprints all differ by more than ``radius`` stay
    apart, unless other candidates join them.

    The candidates come as stars, whose least text need not be alike to texts
    that are alike to each other. So a group of candidates that its verified
    stars leave in several components is gone through again: it is divided by
    the rare shingles that alike texts must share, large groups go by stars around the text nearest to their majority, as long as these link at
    least half of what is loose, and what is then in several components by
    comparing all its texts in blocks.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["id"], *struct_of(node=T.BinaryType(), prints=T.ArrayType(T.LongType()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 4 << 20):
            found = word_fingerprints(batch.column("text"), prints).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * prints), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text_nodes(batch.column("text").to_pylist()), pa.binary()), lists], names=schema.names)

    own = staged(slim.mapInArrow(compute, schema))
    nodes = staged(own.groupBy("node").agg(F.min("id").alias("least"), F.first("prints").alias("prints")))
    each = nodes.select("node", F.explode("prints").alias("fp"))
    least = staged(each.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    inside = each.join(least.where("n > 1"), "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    met = links(least.select("fp"), radius, slices, WIDTH)
    across = met.join(least.select("fp", F.col("first").alias("u")), "fp").join(least.select(F.col("fp").alias("to"), F.col("first").alias("v")), "to").select("u", "v")
    edges = staged(inside.unionByName(across).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    drop_staged(least, met)
    # The texts of the nodes that have links, one of each, and their sets of shingles.
    wanted = staged(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "least"), "node"))
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 4 << 20):
            values, named = batch.column("text").to_pylist(), batch.column("node").to_pylist()
            right = [i for i, x in enumerate(text_nodes(values)) if x == named[i]]  # an id may stand for several texts
            found = [np.unique(np.asarray(shingle_hashes(values[i], shingle), np.uint64)).tobytes() for i in right]
            yield pa.RecordBatch.from_arrays([pa.array([named[i] for i in right], pa.binary()), pa.array(found, pa.binary())], names=["node", "shingles"])

    found = []
    for k in range(TEXT_PARTS):
        mine = F.pmod(F.xxhash64("id"), F.lit(TEXT_PARTS)) == k
        sought = wanted.where(F.pmod(F.xxhash64("least"), F.lit(TEXT_PARTS)) == k)
        texts = slim.where(mine).join(sought, F.col("id").eqNullSafe(F.col("least"))).select("node", "text")
        found.append(staged(texts.mapInArrow(hashes, "node binary, shingles binary").dropDuplicates(["node"])))
    drop_staged(wanted)
    sets = reduce(DataFrame.unionByName, found)
    sizes = staged(sets.select("node", F.length("shingles").alias("size")))
    held_bytes = sizes.agg(F.sum("size")).first()[0]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 8 << 20):
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("a", "b"))
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.float64)
            total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64) - shared
            good = pa.array(shared >= similarity * total)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good)], names=["u", "v"])

    def verified(candidates: DataFrame) -> DataFrame:
        """The pairs that are alike, in as many rounds as keep the disk in use at a few times that of the sets. Those whose sizes alone are too unlike need no look."""
        known = candidates.join(sizes.select(F.col("node").alias("u"), F.col("size").alias("n")), "u").join(sizes.select(F.col("node").alias("v"), F.col("size").alias("m")), "v")
        some = staged(known.where(F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - 1e-6).select("u", "v", "n"))
        rounds = rounds_for(some.agg(F.sum("n")).first()[0], held_bytes)
        out = []
        for k in range(rounds):
            mine = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == k  # noqa: E731, B023
            pairs = some.where(mine("u")).join(sets.where(mine("node")).select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
            out.append(staged(pairs.select("u", "v", "a", "b").mapInArrow(check, "u binary, v binary")))
        drop_staged(some)
        return reduce(DataFrame.unionByName, out)

    groups = staged(components(spark, edges, "u", "v").withColumnRenamed("root", "group"))

    def placed(good: DataFrame) -> DataFrame:
        """``groups`` with the ``root`` of each text's component."""
        joined = components(spark, good, "u", "v")
        member = joined.withColumnRenamed("node", "member")
        out = staged(groups.join(member, groups["node"] == member["member"], "left").select("node", "group", F.coalesce("root", "node").alias("root")))
        drop_staged(joined)
        return out

    def open_groups(at: DataFrame) -> DataFrame:
        """node, group, root, loose (in a component under TILE), ``of`` (the component, empty if loose) and the group's loose texts, of groups in several components."""
        size = at.groupBy("group", "root").agg(F.count("*").alias("n"))
        several = size.groupBy("group").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("n") < TILE, F.col("n")).otherwise(0)).alias("n_loose")).where("roots > 1")
        some = at.join(several.select("group", "n_loose"), "group").join(size, ["group", "root"])
        return staged(some.select("node", "group", "root", (F.col("n") < TILE).alias("loose"), F.when(F.col("n") >= TILE, F.col("root")).otherwise(F.lit(b"")).alias("of"), "n_loose"))

    good = verified(edges)
    at = placed(good)
    whole_groups, rest = groups, open_groups(at)
    groups = sharing(rest, sets, similarity)
    drop_staged(whole_groups, rest)
    rest = open_groups(at.drop("group").join(groups, "node"))
    drop_staged(at)
    large = lambda: rest.where(F.col("loose") & (F.col("n_loose") > TILE))
    count = large().count()
    while count:
        centring = min(prints, CENTRE_PRINTS)
        named = [F.col("prints")[k].alias(f"fp{k}") for k in range(centring)]
        around = staged(large().select("node", "group").join(nodes.select("node", *named), "node"))
        bits = [(k, b) for k in range(centring) for b in range(WIDTH)]
        votes = staged(around.groupBy("group").agg(F.count("*").alias("n"), *(F.sum(F.shiftright(f"fp{k}", b).bitwiseAND(F.lit(1))).alias(f"b{k}_{b}") for k, b in bits)))
        most = [reduce(lambda x, y: x + y, (F.when(F.col(f"b{k}_{b}") * 2 > F.col("n"), F.lit(1 << b)).otherwise(F.lit(0)) for b in range(WIDTH))).cast("long").alias(f"most{k}") for k in range(centring)]
        off = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"fp{k}").bitwiseAND(F.lit((1 << WIDTH) - 1)).bitwiseXOR(F.col(f"most{k}"))) for k in range(centring)))
        centres = staged(around.join(votes.select("group", *most), "group").groupBy("group").agg(F.min_by("node", F.struct(off, "node")).alias("centre")))
        good = good.unionByName(verified(around.join(centres, "group").where("node != centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))))
        drop_staged(around, votes, centres, rest)
        at = placed(good)
        rest = open_groups(at)
        drop_staged(at)
        before, count = count, large().count()
        if count * 2 > before:
            break
    more = tile_links(rest, sets, similarity)
    good = staged(good.unionByName(more))
    drop_staged(more)
    joined = components(spark, good, "u", "v")
    member = joined.withColumnRenamed("node", "member")
    rooted = nodes.join(member, nodes["node"] == member["member"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = staged(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id"))
    drop_staged(nodes, edges, *found, sizes, groups, rest, good, joined)
    return own.join(named, "node").select(F.col("id").alias(id_column), "node", "root", "component_id")


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay if of every component of ``similar_texts`` one row does.

    That is the row with the least id, null ids last; of several texts with that
    id the one with the least node, and of repeated rows any one.
    """
    found = staged(similar_texts(docs, id_column, text, **how))
    place = F.struct(F.col(id_column).isNull().alias("unnamed"), F.col(id_column).alias("id"), "node")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    chosen = found.groupBy("node", F.col(id_column).alias("id")).agg(F.count("*").alias("times"))
    chosen = chosen.join(first.select(F.col("first.node").alias("node"), F.col("first.id").alias("first_id")), "node").where(F.col("id").eqNullSafe(F.col("first_id"))).select("node", "id", "times")
    chosen = staged(chosen)
    drop_staged(found)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_column).alias("row_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["row_id"], T.StructField("row_node", T.BinaryType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row_id"), pa.array(text_nodes(batch.column("text").to_pylist()), pa.binary())], names=schema.names)

    named = rows.mapInArrow(name, schema)
    kept = named.join(chosen, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_node") == F.col("node")))
    once = kept.where("times > 1").dropDuplicates(["row_node"])
    return kept.where("times = 1").select("row.*").unionByName(once.select("row.*"))
