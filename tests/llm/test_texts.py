"""Substring dedup, SimHash, mixing, sharding, packing, language and quality on awkward and small random tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import words  # noqa: F401  (pytest puts this folder on the path)
from pyspark.sql import functions as F

from siteloom.llm import language, mixing, packing, quality, sharding, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


# --- substring dedup


def brute_removed(texts, length):
    count = Counter(tuple(w[i : i + length]) for w in map(split, texts) for i in range(len(w) - length + 1))
    out = []
    for w in map(split, texts):
        gone = {j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substring_equals_brute_force_on_awkward_rows(awkward):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(awkward).collect())
    rows = awkward.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_removed([r["text"] for r in rows], 35), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_substring_equals_brute_force_on_tiny_vocabulary(spark, seed):
    rng = random.Random(seed)
    shared = [words(rng, 12, 3) for _ in range(4)]
    texts = [" ".join(x for _ in range(rng.randrange(0, 8)) for x in (rng.choice(shared) if rng.random() < 0.6 else words(rng, rng.randrange(1, 9), 3))) for _ in range(60)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(docs_of(spark, texts), length=9, gram=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 9)


def test_cut_keeps_clean_texts_and_cuts_the_rest(awkward):
    before = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    after = {r["doc_id"]: r["text"] for r in substring.cut(awkward).where("doc_id >= 4").collect()}
    assert after[11] == next(t for i, t in before if i == 11) and after[7] == "one" and after[4] is None
    assert after[8].endswith("tail") and len(split(after[8])) == 41 and len(split(after[9])) == 30 and after[10] == ""


def test_substring_of_nothing(empty):
    assert substring.digest(empty).count() == 0 and substring.cut(empty).count() == 0


# --- SimHash


def brute_print(text, size=4):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(text)]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    label = list(range(len(ids)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)].append(x)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_simhash_equals_brute_force(awkward):
    rows = awkward.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(awkward).collect())
    assert got == Counter(zip([r["doc_id"] for r in rows], prints, brute_components([r["doc_id"] for r in rows], prints, 4), strict=True))


def test_every_value_is_made_in_one_slice_and_costs_ten_bytes():
    rng = np.random.default_rng(3)
    prints, masks = rng.integers(0, 1 << 63, 300, dtype=np.uint64), simhash.ball(2)
    made = [simhash.slice_values(prints, masks, part, 8) for part in range(8)]
    assert len(masks) == 2081 and all(0.7 < len(v) * 8 / (300 * 2081) < 1.3 for v, _ in made)
    values, numbers = (np.concatenate(x) for x in zip(*made, strict=True))
    want = (prints[:, None] ^ masks[None, :]).ravel()
    assert (np.sort(values) == np.sort(want)).all() and Counter((values ^ masks[numbers]).tolist()) == {x: 2081 for x in prints.tolist()}
    for bits in (0, 3, 9, 17):
        names, blocks, of = simhash.value_blocks(values, numbers, bits)
        assert sum(map(len, blocks)) == 8 * len(values) and sum(map(len, of)) == 2 * len(values) and len(names) <= 1 << bits
    low = simhash.ball(1, 48)
    assert len(low) == 49 and low.max() == 1 << 47


@pytest.mark.parametrize(("per_bucket", "slices"), [(1 << 20, 8), (1 << 12, 2)])
def test_links_connect_all_within_the_radius(spark, monkeypatch, per_bucket, slices):
    monkeypatch.setattr(simhash, "PER_BUCKET", per_bucket)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        for _ in range(3):
            x ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))})
            prints.add(x)
    prints = sorted(prints)
    fps = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp long")
    found = simhash.links(fps, slices=slices).collect()
    assert all(bin((r["fp"] ^ r["to"]) % 2**64).count("1") <= 4 for r in found)
    at = {x: i for i, x in enumerate(prints)}
    label = list(range(len(prints)))
    find = lambda x: x if label[x] == x else find(label[x])
    for r in found:
        a, b = find(at[r["fp"] % 2**64]), find(at[r["to"] % 2**64])
        label[max(a, b)] = min(a, b)
    want = brute_components(list(range(len(prints))), prints, 4)
    assert [find(i) for i in range(len(prints))] == want and len(set(want)) < len(want)


def test_similar_texts_finds_near_copies_and_spares_the_rest(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(60, 400))) for _ in range(60)]
    for i in range(30):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w).upper() if i % 5 == 0 else " ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs_of(spark, texts)).collect()}
    truth = [i for i in range(30) if simhash.jaccard(texts[i], texts[60 + i], 5) >= 0.8]
    assert len(truth) > 20 and sum(got[60 + i] == i for i in truth) >= 0.95 * len(truth)
    assert all(got[i] == i for i in range(60))
    assert all(got[60 + i] in (i, 60 + i) for i in range(30))


def test_similar_texts_on_awkward_rows(awkward, empty):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_texts(awkward).collect())
    assert got[(2, 1)] == 2 and got[(5, 4)] == 1 and got[(6, 4)] == 1 and got[(7, 7)] == 1 and got[(None, None)] == 1 and got[(None, 4)] == 1
    assert simhash.similar_texts(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [16, 1024])
def test_similar_texts_holds_all_links_inside_the_radius(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(9)
    base = words(rng, 400)
    texts = []
    for i in range(240):  # copies alike to the base, but not to each other
        w = list(base)
        for at in range(rng.randrange(20), 400, 57):
            w[at] = f"own{i}x{at}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    for _ in range(12):  # one bag of words in three orders, two of them alike
        w = words(rng, 100)
        other = rng.sample(w, 100)
        texts += [" ".join(x) for x in (w, other, [*other[:-2], other[-1], other[-2]])]
    prints = simhash.word_fingerprints(pa.array(texts))
    sets = [set(simhash.shingle_hashes(x, 5)) for x in texts]
    inside, alike = list(range(len(texts))), list(range(len(texts)))
    find = lambda label, x: x if label[x] == x else find(label, label[x])
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                for label in (alike, inside) if np.bitwise_count(prints[i] ^ prints[j]).min() <= simhash.PRINT_RADIUS else (alike,):
                    low, high = sorted((find(label, i), find(label, j)))
                    label[high] = low
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs_of(spark, texts)).collect()}
    assert all(got[i] == got[find(inside, i)] and find(alike, i) == find(alike, got[i]) for i in got) and len(got) == len(texts)
    assert sum(find(inside, i) == find(inside, 240) for i in range(240)) > 100
    assert all(got[k + 1] == got[k + 2] == k + 1 and got[k] == k for k in range(241, 277, 3))


def test_copies_alike_to_each_other_but_not_to_the_least_are_linked(spark):
    """The least text of a group of candidates may be alike to none of them (A-L and B-L fail, A-B holds)."""
    rng = random.Random(21)
    base = words(rng, 300)

    def changed(w, places, mark):
        out = list(w)
        for at in places:
            out[at] = f"{mark}{at}"
        return out

    least = changed(base, range(0, 300, 33), "l")
    a, b = changed(base, range(5, 300, 33), "a"), None
    b = changed(a, [150], "b")
    texts = [" ".join(x) for x in (least, a, b)]
    assert simhash.jaccard(texts[0], texts[1], 5) < 0.8 and simhash.jaccard(texts[0], texts[2], 5) < 0.8 <= simhash.jaccard(texts[1], texts[2], 5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_candidates_catch_nearly_all_pairs_at_the_threshold(spark):
    rng = random.Random(22)
    a, b = [], []
    while len(a) < 300:
        w = words(rng, rng.randrange(60, 500), 900)
        other = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) // 52)):
            other[at] = f"new{rng.randrange(10**6)}"
        if 0.8 <= simhash.jaccard(" ".join(w), " ".join(other), 5) < 0.86:
            a.append(" ".join(w))
            b.append(" ".join(other))
    x, y = (simhash.word_fingerprints(pa.array(t)) for t in (a, b))
    assert (np.bitwise_count(x ^ y).min(axis=1) <= simhash.PRINT_RADIUS).mean() >= 0.95


def test_first_of_each_keeps_one_row(awkward, empty):
    out = simhash.first_of_each(awkward)
    assert out.columns == awkward.columns
    got = Counter(r["doc_id"] for r in out.collect())
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    apart = {3} if simhash.jaccard(texts[1], texts[3], 5) < 0.8 else set()
    assert got == Counter({1, 4, 7, 8, 9, 10, 11, 12, 13, None} | apart)
    assert simhash.first_of_each(empty).count() == 0


# --- mixing


def test_targets_share_out_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # Weights 3, 1, 2, 3 (z), 1 (null); a and null are held at twice their words, c too.
    assert got["a"] == 20 and got["z"] == 0 and got[None] == 180 and got["c"] == 1000
    assert sum(got.values()) == pytest.approx(1.5 * 1600)


def test_mix_takes_near_the_targets(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(600)]
    mixed = mixing.mix(docs_of(spark, texts)).toPandas()
    again = mixing.mix(docs_of(spark, texts)).toPandas()
    assert mixed.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert mixed["copies"].between(0, 2).all()
    for _, own in mixed.groupby("source"):
        assert abs((own["copies"] * own["size"]).sum() - own["target"].iloc[0]) <= 2 * own["size"].max()


def test_mix_and_emit_on_awkward_rows(awkward, empty):
    mixed = mixing.mix(awkward)
    assert mixed.count() == awkward.count()
    sizes = Counter((r["doc_id"], r["size"]) for r in mixed.collect())
    assert sizes == Counter((r["doc_id"], len(split(r["text"]))) for r in awkward.collect())
    out = mixing.emit(awkward, mixed)
    assert out.columns == awkward.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty, mixing.mix(empty)).count() == 0


# --- sharding


def test_shards_equal_plain_python(awkward, empty):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 8) for r in awkward.collect()))
    total, before, want, slots = sum(r[3] for r in rows), 0, Counter(), Counter()
    for known, doc, crc, size in rows:
        shard = min(4, (2 * before + size) * 5 // (2 * total))
        want[(doc if known else None, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        before += size
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shards(awkward, n_shards=5).collect())
    assert got == want
    assert sharding.shards(empty).count() == 0


def test_shards_are_balanced_and_written_whole(spark, tmp_path):
    rng = random.Random(4)
    docs = docs_of(spark, [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(500)]).repartition(7)
    placed = sharding.shards(docs).toPandas()
    by = placed.groupby("shard")["size"].sum()
    assert len(by) == 24 and by.max() - by.min() <= 2 * placed["size"].max()
    assert (placed.groupby("shard")["slot"].max() + 1 == placed.groupby("shard").size()).all()
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}


def test_repeated_rows_are_written_to_slots_of_their_own(spark, awkward, tmp_path):
    docs = awkward.unionByName(awkward).unionByName(awkward.where("doc_id = 2").withColumn("lang", F.lit("zz"))).withColumn("shard", F.lit(9))
    sharding.write_shards(docs, str(tmp_path / "out"), n_shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard", "slot").distinct().count() == docs.count()
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in back.collect()) == Counter((r["doc_id"], r["text"], r["lang"]) for r in docs.collect())
    assert Counter((r["shard"], r["slot"]) for r in back.collect()) == Counter((r["shard"], r["slot"]) for r in sharding.shards(docs, n_shards=5).collect())


def test_a_context_whose_text_has_many_copies_is_extended_once(spark):
    rng = random.Random(17)
    shared, other = words(rng, 60), words(rng, 45)
    # One anchor in two contexts: the copies' own, and one that stands alone.
    rows = [" ".join(words(random.Random(18), 20) + shared)] * 40 + [" ".join(other + shared[:40] + words(rng, 30))]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.digest(docs).collect()}
    assert all(got[i] == (80, 80) for i in range(40)) and got[40] == (115, 40)


# --- packing


def test_packing_round_trip(awkward, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in awkward.select("doc_id", "text").collect())
    found = packing.pack(awkward, with_ids=True).toPandas()
    assert all(zlib.crc32(t) == c and len(t) == 4 * n for t, c, n in zip(found["tokens"], found["ids_crc32"], found["length"], strict=True))
    ids = found["tokens"].map(lambda t: tuple(np.frombuffer(t, "<u4").tolist()))
    for (doc, whole), n in want.items():
        own = found[(found["doc_id"] == doc) if doc is not None else found["doc_id"].isna()]
        cuts = [(s, s + 2048) for s in range(0, len(whole), 2048)]
        for a, b in cuts:
            same = (own["start"] == a) & (own["doc_tokens"] == len(whole)) & (ids[own.index] == whole[a:b])
            assert same.sum() >= n
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        ends = own["offset"] + own["length"]
        assert own["offset"].iloc[0] == 0 and (own["offset"].iloc[1:].to_numpy() == ends.iloc[:-1].to_numpy()).all() and ends.iloc[-1] <= 2048
    assert packing.pack(empty).count() == 0


def test_packing_is_the_same_on_any_layout_and_deals_pieces_singly(spark):
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(60)] + [" ".join(words(rng, 9000))] * 3
    docs = docs_of(spark, texts).withColumn("doc_id", F.least("doc_id", F.lit(60)))
    one, other = (packing.pack(d, group_pieces=8, with_copy=True).toPandas().sort_values(["doc_id", "document", "start", "copy"]).reset_index(drop=True) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.equals(other)
    assert one.groupby(one["sequence_id"] // 2**32).size().max() < 30
    copies = one[one["doc_id"] == 60]
    assert set(copies["copy"]) == {1, 2, 3} and (copies.groupby("copy")["length"].sum() == copies["doc_tokens"].iloc[0]).all()


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(0)
    lengths = sorted((rng.randrange(1, 2048) for _ in range(700)), reverse=True)
    free, want = [], []
    for n in lengths:
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(2048)
        want.append((at, 2048 - free[at]))
        free[at] -= n
    assert list(zip(*packing.first_fit_decreasing(lengths, 2048), strict=True)) == want
    assert packing.first_fit_decreasing([], 2048) == ([], [])


# --- language and quality


SPEECH = {"en": "the and of thing with hand", "fr": "le une être château garçon où", "de": "der und straße über mädchen nicht"}


def spoken(spark, n=120):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SPEECH))
        stems = SPEECH[lang].split()
        rows.append((i, " ".join(rng.choice(stems) + rng.choice(stems) if rng.random() < 0.6 else rng.choice(stems) for _ in range(80)), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_held_out_accuracy(spark):
    docs = spoken(spark)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out("doc_id")).toPandas()
    assert len(got) > 15 and (got["lang"] == got["lang_pred"]).mean() >= 0.95
    assert got["lang_score"].between(0, 1).all()


FIXTURES = "/root/testdata/sf0.01"
on_fixtures = pytest.mark.skipif(not os.path.isdir(FIXTURES), reason="test tables are not here")


@on_fixtures
def test_language_accuracy_on_the_fixture_tables(spark):
    docs = spark.read.parquet(f"{FIXTURES}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out("doc_id") & F.col("lang").isNotNull()).toPandas()
    base = got["lang"].value_counts(normalize=True).iloc[0]
    assert len(got) > 200 and base < 0.8 and (got["lang"] == got["lang_pred"]).mean() >= 0.97


def test_dictionaries_hold_whole_texts_within_the_bound(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(words(rng, rng.randrange(20, 1500))) + " é", "en", "s", 1) for i in range(200)] + [(1000 + i, "ß" * (60000 + i), "de", "s", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = language.learn(docs)
    texts = {t.lower().encode() for _, t, *_ in rows}
    assert set(found) == {"de", "en"} and all(x in texts for d in found.values() for x in d.split(b"\n"))
    assert 90 << 10 < len(found["en"]) <= language.MOST_BYTES + language.DOCS_PER_LANGUAGE and found["de"].decode().strip("ß\n") == ""
    assert all(len(d.split(b"\n")) <= language.DOCS_PER_LANGUAGE for d in found.values())
    long = spark.createDataFrame([(2000, "ñ" * language.MOST_BYTES, "es")], "doc_id long, text string, lang string")
    assert set(language.learn(docs.select("doc_id", "text", "lang").unionByName(long))) == {"de", "en"}  # too long to be broadcast
    assert language.learn(docs.repartition(5)) == found


@on_fixtures
def test_language_rejects_long_texts_of_no_language(spark):
    rng = random.Random(15)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(6000))
    docs = spark.read.parquet(f"{FIXTURES}/documents.parquet")
    learned = language.learn(docs)
    clean = " ".join(r["text"] for r in docs.where("lang = 'de'").limit(40).collect())
    got = {r["doc_id"]: r for r in language.predict(docs_of(spark, [junk, clean]), learned).collect()}
    assert got[0]["lang_rejected"] and not got[1]["lang_rejected"] and got[1]["lang_pred"] == "de"


def plain_verdict(dictionaries, text):
    """Language, score and rejection of one text, by the law written out."""
    import zstandard

    if text is None or not any(c.isalpha() for c in text) or not dictionaries:
        return "und", 0.0, True
    found = {}
    for lang, content in dictionaries.items():
        data, total = text.lower().encode(), 0
        while data:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=12)
            total += len(zstandard.ZstdCompressor(level=12, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[:16384]))
            data = data[16384:]
        found[lang] = total
    first = min(found.values())
    near = sorted(found.values())
    score = 1 / sum(math.exp((first - v) / 6) for v in found.values())
    return min(k for k, v in found.items() if v == first), score, len(near) > 1 and near[1] - first < max(2, 0.01 * first)


def test_language_equals_a_plain_loop(spark, awkward):
    docs = spoken(spark, 60)
    learned = language.learn(docs)
    learned["aa"] = learned["de"]  # equal sizes always: the first one wins, and is rejected
    learned = dict(sorted(learned.items()))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = Counter((r["doc_id"], r["lang_pred"], round(r["lang_score"], 9), r["lang_rejected"]) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), learned, carry=["doc_id"]).collect())
    want = Counter((i, p, round(s, 9), r) for i, t in rows for p, s, r in [plain_verdict(learned, t)])
    assert got == want
    assert any(k[1] == "aa" for k in got) and all(k[3] for k in got if k[1] == "aa") and not any(k[1] == "de" for k in got)


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="test tables are not here")
def test_language_accuracy_of_short_texts_too(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("chars")), "doc_id").where(language.held_out("doc_id") & F.col("lang").isNotNull()).toPandas()
    right = got["lang"] == got["lang_pred"]
    assert len(got) > 2000 and right.mean() >= 0.994
    assert right[got["chars"] < 400].mean() >= 0.95


def test_language_on_awkward_rows(spark, awkward, empty):
    learned = language.learn(spoken(spark))
    got = language.predict(awkward, learned)
    assert got.columns == [*awkward.columns, "lang_pred", "lang_score", "lang_rejected"] and got.count() == awkward.count()
    none = got.where("lang_pred = 'und'").select("doc_id", "lang_score", "lang_rejected").collect()
    assert {r["doc_id"] for r in none} == {None, 4, 5, 6, 13} and all(r["lang_score"] == 0 and r["lang_rejected"] for r in none)
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.predict(awkward, {}).collect()} == {"und"}


def test_language_does_not_read_the_answers(spark):
    docs = spoken(spark)
    held = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert language.learn(docs) == language.learn(held)


def test_quality_held_out_accuracy(spark, awkward, empty):
    rng = random.Random(6)
    rows = [(i, " ".join((w.upper() + "!!" if i % 3 == 0 else w) for w in words(rng, 80)), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)] + [(5, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).join(labels.where("quality IS NOT NULL"), "doc_id").where(quality.held_out("doc_id")).toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() >= 0.95
    scores = quality.score(awkward, model).toPandas()
    assert len(scores) == awkward.count() and scores["score"].between(0, 1).all()
    assert quality.score(empty, model).count() == 0
    assert quality.learn(empty, labels) is None and set(quality.score(docs, None).toPandas()["score"]) == {0.5}


@on_fixtures
def test_quality_beats_the_base_rate_on_the_fixture_labels(spark):
    docs, labels = (spark.read.parquet(f"{FIXTURES}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.score(docs, quality.learn(docs, labels)).join(labels.where("quality IS NOT NULL"), "doc_id").where(quality.held_out("doc_id")).toPandas()
    right = (found["score"] >= 0.5) == (found["quality"] == 1)
    base = max(found["quality"].mean(), 1 - found["quality"].mean())
    assert len(found) > 100 and right.mean() >= base + 0.06 and right[found["quality"] == 0].mean() >= 0.8


def plain_score(model, text, chars):
    """A document's score from its text, one feature and one pair at a time."""
    data, ws = (text or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = Counter(zlib.crc32(w.lower().encode()) % quality.WORD_BUCKETS for w in ws)
    weights = {i: 1 + math.log(n) for i, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in weights.values()))
    features = [(i, x / max(norm, 1e-9)) for i, x in weights.items()]
    size, n = max(1, len(data)), max(1, len(ws))
    marks = "!#$%&*|{}[]<>=_/@\"',.;:-"
    kinds = [*[lambda b, m=m: b == ord(m) for m in marks], lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in (10, 11, 12, 13), lambda b: b in (9, 32), lambda b: b >= 128]
    shares = [math.sqrt(sum(map(k, data)) / size) for k in kinds]
    shares.append(math.sqrt(sum(not any(k(b) for k in kinds) for b in data) / size))
    more = [math.log1p(len(data)) / 14, math.log1p(len(ws)) / 12, math.log1p(len(data) / n) / 4, len(set(ws)) / n, sum(a == b for a, b in zip(ws, ws[1:])) / n]
    stats = [*(shares + more)[: quality.STATS], math.log1p(max(chars or 0, 0)) / 14]
    for j, v in enumerate(stats):
        features.append((quality.WORD_BUCKETS + j * quality.BINS + int(np.searchsorted(model["cuts"][j], v, side="right")), 1 / math.sqrt(len(stats))))
    z = model["b"] + sum(model["w"][i] * x for i, x in features)
    for a, (i, x) in enumerate(features):
        for j, y in features[:a]:
            z += float(model["v"][i].astype(float) @ model["v"][j].astype(float)) * x * y
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_scores_equal_a_plain_scorer(spark, awkward):
    rng = random.Random(16)
    rows = [(i, " ".join((w.upper() + "!!" if i % 3 == 0 else w) for w in words(rng, 60, 300)), rng.randrange(500)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    model = quality.learn(docs, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(120)], "doc_id long, quality int"))
    both = docs.where("doc_id < 20").unionByName(awkward.where("doc_id <> 11 OR doc_id IS NULL").select("doc_id", "text", "n_chars"))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, round(r["score"], 4)) for r in quality.score(both, model).collect()))
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, round(plain_score(model, r["text"], r["n_chars"]), 4)) for r in both.collect()))
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 for a, b in zip(got, want, strict=True))


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = quality.WORD_BUCKETS
    model = {"b": 0.3, "w": rng.normal(size=size), "v": rng.normal(size=(size, quality.FACTORS)).astype(np.float32)}
    at, ids, x = np.array([0, 5, 9]), rng.integers(0, size, 9), rng.random(9)
    z, _ = quality.raw_scores(model, at, ids, x)
    for d, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        pairs = sum(float(model["v"][ids[i]] @ model["v"][ids[j]]) * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert z[d] == pytest.approx(0.3 + model["w"][ids[a:b]] @ x[a:b] + pairs, rel=1e-4)
