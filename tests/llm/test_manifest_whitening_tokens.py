"""Merkle manifests, whitening and token counts on awkward and small random tables, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import DOCS, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteloom.llm import merkle, tokencount, whitening
from siteloom.llm.packing import tokenizer_path

FAR = float("inf")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root of a list of digests and each one's siblings, left and right, level by level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
    root, above = tree([sha(*r) for r in runs])
    return root, [[("".join(r[:i]), "".join(r[i + 1 :])), *above[k]] for k, r in enumerate(runs) for i in range(len(r))]


def brute_manifest(rows, tamper):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"], leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], tamper(r["doc_id"], r["text"]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        own[g] = tree([x[1] for x in groups[g]])
    if not names:
        return Counter()
    root, tops = tree([own[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (name, first, seen), path in zip(groups[g], own[g][1], strict=True):
            steps = path + top
            now = seen
            for left, right in steps:
                now = sha(left, now, right)
            out.append((name, first, own[g][0], root, sha(*(left + right for left, right in steps)), now, now == root))
    return Counter(out)


def got_manifest(frame, tampered=None):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r[n] for n in names) for r in merkle.manifest(frame, tampered=tampered).select(*names).collect())


def test_manifest_equals_brute_force_on_awkward_rows(awkward):
    cut = {"text": F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    tamper = lambda i, t: t.replace("\n", "") if t is not None and i is not None and i % 2 == 0 else t
    want = brute_manifest(awkward.collect(), tamper)
    assert got_manifest(awkward, cut) == want
    assert {False, True} == {k[-1] for k in want}


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1, 1], [2, 9, 10, 28, 1], [82, 1]])
def test_manifest_of_trees_of_all_shapes(spark, sizes):
    rows = [(i * 100 + g, f"t{i}", "en", None if g == 0 else f"s{g}", i) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    got = got_manifest(docs)
    assert got == brute_manifest(docs.collect(), lambda i, t: t)
    assert all(k[-1] for k in got)


def test_manifest_of_no_rows(empty):
    assert merkle.manifest(empty).collect() == []


def test_a_changed_row_of_any_column_fails_alone(spark):
    rows = [(i, f"text {i}", "en", "ab"[i % 2], i) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    for column, other in (("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1), ("source", F.lit("a:"))):
        seen = {column: F.when(F.col("doc_id") == 7, other).otherwise(F.col(column))}
        assert [r["doc_id"] for r in merkle.manifest(docs, tampered=seen).where("NOT verified").collect()] == [7]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_whitening(rows):
    """(id, n, deviation, whitened up to sign, explained) by component, by length."""
    xs = [(name, tuple(math.floor(64 * float(c)) + 1000000 for c in v)) for name, v in rows if usable(v)]
    out = defaultdict(list)
    for dim in {len(x) for _, x in xs}:
        fit = list({x for _, x in xs if len(x) == dim})
        n, total = len(fit), [sum(x[j] for x in fit) for j in range(dim)]
        away = [[x[j] * n - total[j] for j in range(dim)] for x in fit]
        cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(dim)] for i in range(dim)])
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
        for name, x in xs:
            if len(x) == dim:
                d = [x[j] * n - total[j] for j in range(dim)]
                for k, value in enumerate(values):
                    zero = value <= values[0] * dim * 2.3e-16
                    out[(name, k + 1, n)].append((sum(v * v for v in d), None if zero else abs(float(np.array(d, float) / n @ axes[:, k])) / math.sqrt(value), float(value) / np.trace(cov) if np.trace(cov) else None))
    return out


def close(a, b):
    return a is b is None or (a is not None and b is not None and abs(a - b) < 1e-6 * max(1, abs(a)))


def compare(frame, rows):
    want, got = brute_whitening(rows), defaultdict(list)
    for r in whitening.whiten(frame).collect():
        got[(r["vec_id"], r["component"], r["n"])].append((r["deviation"], None if r["whitened"] is None else abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] is None or r["identity_error"] < 1e-4
    assert got.keys() == want.keys()
    order = lambda x: tuple(-1 if v is None else round(v, 6) for v in x)
    for key, own in want.items():
        assert len(own) == len(got[key])
        for (a, b, c), (x, y, z) in zip(sorted(own, key=order), sorted(got[key], key=order), strict=True):
            assert a == x and close(b, y) and close(c, z)


def test_whitening_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(20)]) for i in range(300)]
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1]), (901, None), (902, [float("nan")] + [0.0] * 19), (903, [None] + [0.0] * 19), (904, [FAR] + [0.0] * 19), (905, [])]
    rows += [(1000 + i, [rng.gauss(0, 1), 5.0, rng.gauss(0, 9)]) for i in range(40)]  # another length, one component without variance
    rows += [(2000, [1.0] * 4), (2001, [1.0] * 4)]  # one distinct vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "x": F.lit(1), "component": F.lit(2), "n": F.lit("n")})
    compare(frame, [(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert whitening.whiten(frame.where("false")).collect() == []


def test_whitening_of_far_and_long_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.randrange(0, 9) for _ in range(5)]) for i in range(200)] + [(500 + i, [rng.gauss(0, 1) for _ in range(300)]) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(frame)
    found = {(r["vec_id"], r["component"]): r for r in out.collect()}
    x = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in rows if i < 500}
    total = [sum(v[j] for v in x.values()) for j in range(5)]
    for i, v in x.items():
        square = sum((200 * v[j] - total[j]) ** 2 for j in range(5))
        assert found[(i, 1)]["deviation"] == (square if square < 1 << 63 else None)
    assert max(r["identity_error"] for r in found.values() if r["vec_id"] < 500) < 1e-4
    assert {r["whitened"] for r in found.values() if r["vec_id"] >= 500 and r["component"] > 2} == {None}  # three vectors span two components
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(huge).count() == 6


def test_scatter_is_exact_for_numbers_beyond_doubles(spark):
    rng = random.Random(6)
    rows = [[rng.randrange(-(1 << 45), 1 << 45) for _ in range(4)] for _ in range(500)]
    fit = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3)
    primes = whitening.primes_for(2 * 500 * (1 << 45) ** 2 + 1)
    parts = defaultdict(lambda: np.zeros((4, 4), np.int64))
    for r in whitening.residue_scatter(fit, {4: [0] * 4}, {4: primes}).collect():
        parts[r["prime"]][r["i"], r["j"]] = r["residue"] % r["prime"]
    got = whitening.remaindered(parts)
    assert all(got[i, j] == sum(r[i] * r[j] for r in rows) for i in range(4) for j in range(i, 4))
    assert all(got[i, j] > 1 << 53 or got[i, j] < -(1 << 53) for i in range(4) for j in range(i, 4))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path(tokencount.TOKENIZER))
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, awkward, library):
    rng = random.Random(7)
    odd = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 5000, " " * 999 + "a", "\n\n a\t\tb \r\n", "don't DON'T 'tis''s 's 'S", "naïve straße 12,5 €", "你好 мир ３４ ²¾", "a b　c\xa0d\x85e\x1cf\x1fg", "​‍👩‍👩‍👧 ok", "\x00\x01"]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(100 + i, t) for i, t in enumerate(odd)] + [(200 + i, " ".join(words(rng, 50))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "n_bytes": F.lit(1), "n_tokens": F.lit("t"), "pretoken": F.lit(3)})
    want = Counter((i, len((t or "").encode()), library(t), library(t) > 1024) for i, t in rows)
    assert any(k[3] for k in want)
    for frequent in (None, tokencount.frequent_pretokens(docs, rows=5), tokencount.frequent_pretokens(docs.where("false"))):
        assert Counter(tuple(r) for r in tokencount.token_counts(docs, frequent=frequent).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_counts_of_no_rows(empty):
    assert tokencount.token_counts(empty).collect() == []


def test_the_frequent_table_is_bounded_and_serves_most(spark):
    docs = spark.createDataFrame([(i, " ".join(words(random.Random(i), 80, 300))) for i in range(200)], "doc_id long, text string")
    held = tokencount._opened(tokencount.frequent_pretokens(docs, most=250))
    assert len(held) == 250
    own = tokencount.Encoder(tokenizer_path(tokencount.TOKENIZER))
    found = [p in held for r in docs.collect() for p in own.pretokens(r["text"])]
    assert sum(found) > 0.6 * len(found)


def test_settled_characters_are_cut_as_the_library_cuts_them():
    own = tokencount.Encoder(tokenizer_path(tokencount.TOKENIZER))
    settled = [chr(c) for c in range(0x2100) if own.other.search(chr(c)) is None]
    assert len(settled) > 600
    for c in settled:
        for text in (c, f"a{c}b", f"1{c} {c}{c}  {c}", f" {c}'s{c}\n{c}", f"!{c}?", f"{c}  x"):
            assert own.cut(text) == [text[a:b] for _, (a, b) in own.tokenizer.pre_tokenizer.pre_tokenize_str(text)], repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'stremdvl.,!12abé中　\x1c|<>endoftx", max_size=80))
def test_any_text_counts_as_the_library_counts_it(text):
    own = tokencount._encoder(tokenizer_path(tokencount.TOKENIZER))
    assert own.count(text, {}) == len(own.tokenizer.encode(text, add_special_tokens=False).ids)


def test_a_full_cache_changes_no_count(monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT", 5)
    own = tokencount.Encoder(tokenizer_path(tokencount.TOKENIZER))
    for seed in range(5):
        text = " ".join(words(random.Random(seed), 100))
        assert own.count(text, {}) == len(own.tokenizer.encode(text, add_special_tokens=False).ids)
        assert len(own.cache) <= 105
