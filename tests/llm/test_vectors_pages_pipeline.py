"""Vector operators, WARC and the pipeline on awkward and small random tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DOCS, words
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import neardup_vectors, simhash, topk, warc
from siteloom.llm.common import components, staged

VECTORS = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def awkward_vectors():
    rng = random.Random(8)
    rows = []
    for i in range(150):
        base = [rng.gauss(0, 1) for _ in range(12)]
        rows.append((i * 10, base, i % 3))
        for j in range(rng.randrange(0, 4)):
            rows.append((i * 10 + j + 1, [x + rng.gauss(0, 0.12) for x in base], i % 3))
    rows += [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [NAN] + [1.0] * 11, 1), (5003, [None] + [1.0] * 11, 1), (5004, [INF] + [1.0] * 11, 1), (5100, rows[0][1], None), (5200, rows[0][1], 0), (5200, rows[0][1], 0), (None, rows[0][1], 0), (5300, [1.0, 2.0], 0), (5301, [1.0, 2.1], 0), (5302, [], 0), (5303, [-0.0, 1.0], 2), (5304, [0.0, 1.0], 2)]
    return rows


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(awkward_vectors(), VECTORS).withColumns({"id": F.lit("x"), "row": F.lit(1), "dim": F.lit(0), "cls": F.lit("c"), "n": F.lit(2)})


@pytest.mark.parametrize("tile", [16, 1024])
def test_near_vectors_equal_brute_force(vectors, tile):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    n = len(rows)
    links, label = Counter(), list(range(n))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b) or not any(a) or not any(b):
                continue
            x, y = np.array(a, float), np.array(b, float)
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)].append(rows[i][0])
    want = Counter((rows[i][0], links[i], min(least[find(i)], default=None)) for i in range(n))
    got = neardup_vectors.near_duplicates(vectors, tile=tile)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == want
    assert got.where("kept <> (vec_id <=> component_id)").count() == 0


def test_top_k_equals_brute_force(vectors):
    rows = [(i, r["vec_id"], r["embedding"]) for i, r in enumerate(vectors.collect()) if usable(r["embedding"])]
    whole = {i: [math.floor(1024 * x) for x in v] for i, _, v in rows}
    want = set()
    for i, q, v in rows:
        if q is not None and q % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), c is None, c or 0) for j, c, w in rows if j != i and len(w) == len(v)))
            want |= {(q, k + 1, None if none else c, -s) for k, (s, none, c) in enumerate(found[:10])}
    got = topk.top_k(vectors).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want


def test_lists_are_read_in_part_and_the_result_is_exact():
    rng = np.random.default_rng(2)
    v = (rng.gamma(0.3, 300, (4000, 6)) * rng.choice([-1, 1], (4000, 6))).astype(np.int64)
    lists, read, skipped = topk.Lists(v), 0, 0
    for q in rng.integers(-300, 300, (20, 6)):
        want = np.sort(v @ q)[::-1][:5]
        at, scores, n = topk.read_lists(q, lists, -1, 5, None)
        assert (np.sort(scores)[::-1][:5] == want).all() and (v[at] @ q == scores).all()
        read += n
        # With a floor that others have reached less is read, and nothing where no candidate can reach it.
        at, scores, less = topk.read_lists(q, lists, -1, 5, int(want[2]))
        assert less <= n and set(want[:3].tolist()) <= set(scores.tolist())
        skipped += topk.read_lists(q, lists, -1, 5, int(np.abs(q) @ np.abs(v).max(axis=0)) + 1)[2]
    assert read < 20 * v.size / 2 and skipped == 0
    with pytest.raises(ArithmeticError):
        topk.read_lists(np.array([1 << 40]), topk.Lists(np.array([[1 << 40]])), -1, 1, None)


@pytest.mark.parametrize(("candidates", "strip"), [(16, 2), (8192, 8)])
def test_top_k_of_many_equal_vectors(spark, monkeypatch, candidates, strip):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "STRIP", strip)
    table = spark.createDataFrame([(i, [1.0, -0.5] if i % 2 else [0.25, 0.5], 0) for i in range(150)], VECTORS)
    got = topk.top_k(table, k=3).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {(0, 1, 2), (0, 2, 4), (0, 3, 6), (100, 1, 0), (100, 2, 2), (100, 3, 4)}


def test_empty_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none).count() == 0 and neardup_vectors.near_duplicates(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 90)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 90))


PAGES = [
    (3, "http://a.example/x?y=1", "<p>same</p>"), (1, "http://b.example/", "<p>same</p>"), (2, None, None), (4, "http://c.example/\r\nX: y", ""), (5, "no address", "WARC/1.1\r\n\r\nfake\r\n\r\n"),
    (6, "http://[bad", "é€\x00"), (7, "http://d.example/é z", "<p>same</p>"), (7, "http://d.example/é z", "<p>same</p>"), (1, "http://b.example/", "<p>same</p>"), (None, "u", "<p>same</p>"), (8, "u", "x" * 300000),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"row": F.lit("r"), "digest": F.lit(0), "first": F.lit(1)})
    first = {}
    for page, _, html in PAGES:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        own = first[html or ""]
        kind = "response" if page == own else "revisit"
        want[(page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else own)] += 1
    got = Counter(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want
    small = warc.round_trip(pages, min_bytes=100)
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ids_of_any_text_and_repeated_rows(spark):
    rows = [("a\r\nb: c", "u", "x"), ("a\r\nb: c", "u", "x"), ("a\r\nb: c", "u", "x"), ("", "u", "x"), ("é %2B +", None, "y"), (None, "u", "y"), (None, "u", "y")]
    got = Counter(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).select("page_id", "record_type", "refers_to").collect())
    assert got == {("", "response", None): 1, ("a\r\nb: c", "revisit", ""): 3, ("é %2B +", "response", None): 1, (None, "revisit", "é %2B +"): 2}


def test_archives_are_bounded_and_say_what_they_are(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", "x" * 3000 + str(i)) for i in range(200)], "page_id long, url string, html string").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=50_000)
    files = list((tmp_path / "w").glob("part-*"))
    data = [warc._plain(f.read_bytes()) for f in files]
    assert len(files) > 10 and all(len(d) < 52_000 for d in data)
    kinds = [[h["warc-type"] for h, _ in warc.parse(d)] for d in data]
    assert all(k[0] == "warcinfo" and k.count("warcinfo") == 1 for k in kinds) and sum(k.count("response") for k in kinds) == 200
    ids = [h["warc-record-id"] for d in data for h, _ in warc.parse(d)]
    assert len(set(ids)) == len(ids)


def test_captures_are_nested_and_hold_the_payload(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=2000)
    found = warc.captures(warc.read_records(spark, str(tmp_path / "w"), with_payload=True)).collect()
    assert len(found) == len(PAGES) and all(r["request"] is not None and r["metadata"] is not None for r in found)
    assert {bytes(r["response"]["payload"]).decode() for r in found if r["response"]["kind"] == "response"} == {h or "" for _, _, h in PAGES}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    passage = " ".join(words(rng, 55))
    rows = [(i, " ".join(words(rng, 120)), "en", f"s{i % 4}", 1) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)]
    rows += [(200 + i, rows[20 + i][1].replace(" ", " changed ", 1), "en", "s1", 1) for i in range(10)]
    rows += [(300 + i, " ".join(words(rng, 70)) + " " + passage + " " + " ".join(words(rng, 70)), "en", "s2", 1) for i in range(6)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "123 !!", "en", "s", 0), (403, rows[0][1], "en", "s0", 1), (403, rows[0][1], "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == corpus.columns
    ids = {k: Counter(r["doc_id"] for r in v.select("doc_id").collect()) for k, v in seen.items()}
    assert not {400, 401, 402} & set(ids["language ID"]) and set(range(80)) <= set(ids["language ID"])
    near = ids["SimHash near-dedup"]
    assert not {*range(100, 110), *range(200, 210), 403} & set(near) and set(range(80)) | set(range(300, 306)) == set(near) and max(near.values()) == 1
    cut = {r["doc_id"]: r["text"] for r in seen["substring dedup"].collect()}
    assert all(len(cut[i].split()) == 140 for i in range(300, 306)) and set(cut) == set(near)
    before = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert all(cut[i] == before[i] for i in range(80))
    mixed = ids["mixing sources"]
    assert set(mixed) <= set(cut) and max(mixed.values()) <= 2
    packed = seen["packing"].toPandas()
    assert (packed.groupby("doc_id")["length"].sum() == packed.drop_duplicates("doc_id").set_index("doc_id")["doc_tokens"].mul(packed.groupby("doc_id").apply(lambda g: (g["start"] == 0).sum(), include_groups=False))).all()


#: Names that the operators use inside, among others.
CLASHING = (
    "id", "row", "row_id", "row_node", "row_hash", "node", "root", "member", "group", "component_id", "rows", "kept_id", "stays", "least", "prints", "fp", "first", "first_id", "times", "n", "u", "v",
    "lang_letters", "letters", "lang_pred", "lang_score", "lang_rejected", "h", "bytes", "total", "k1", "k2", "text_key_1", "text_key_2", "spans", "repeated", "none", "c0", "c1", "anchor", "context", "todo", "at",
    "copy", "copies", "copy_of", "copies_of_all", "rows_alike", "alike", "text_hash", "mixed_hash", "mixed_id", "size", "named", "position", "before", "part", "all_rows", "document", "tokens", "start", "length", "sequence_id", "offset", "bucket", "values", "masks", "value", "dotted.name",
)


def test_stages_leave_columns_of_any_name_alone(spark, corpus):
    docs = corpus.where("doc_id < 30 OR doc_id BETWEEN 100 AND 105 OR doc_id >= 300")
    docs = docs.select("*", *(F.concat(F.lit(f"{name}="), F.col("doc_id")).alias(name) for name in CLASHING))
    given = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""))
        if name == "packing":
            break
        out = docs.collect()
        assert docs.columns == [*DOCS.names, *CLASHING] and out
        assert all(r[c] == given[r["doc_id"]][c] for r in out for c in (*CLASHING, "source"))
    assert docs.count()


def test_packing_stage_emits_sequences_that_can_be_rebuilt(spark):
    rng = random.Random(4)
    texts = {1: " ".join(words(rng, 3000)), 2: "one two", 3: None}
    docs = spark.createDataFrame([(i, texts[i], "en", "s", 1) for i in (1, 1, 2, 2, 3)], DOCS)
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    copies, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        copies[(r["doc_id"], r["document"], r["copy"])].append((r["start"], bytes(r["tokens"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["tokens"]) == 4 * r["length"] and zlib.crc32(bytes(r["tokens"])) == r["ids_crc32"]
    assert Counter(i for i, *_ in copies) == {1: 2, 2: 2, 3: 1}
    whole = defaultdict(set)
    for (i, *_), own in copies.items():
        data = b"".join(x for _, x, _ in sorted(own))
        assert len(data) == 4 * own[0][2]
        whole[i].add(data)
    assert all(len(x) == 1 for x in whole.values())
    for own in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))


def test_jaccard():
    assert simhash.jaccard("a b c d e f", "A B C D E F", 5) == 1 and simhash.jaccard(None, "", 5) == 1 and simhash.jaccard("a", "b", 5) == 0


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
