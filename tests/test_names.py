"""The join of misspelt names against difflib on all pairs."""

import difflib
import random

import pytest

from siteloom.operators import names


def plain_best(text, known, cutoff):
    found = difflib.get_close_matches(text, known, n=1, cutoff=cutoff)
    return found[0] if found else None


@pytest.mark.parametrize(("cutoff", "alphabet"), [(0.9, "abcdefgh"), (0.9, "ab"), (0.75, "abcd"), (1.0, "ab")])
def test_best_names_equal_difflib(spark, cutoff, alphabet):
    rng = random.Random(len(alphabet))
    known = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 24))) for _ in range(150)} | {"a", "ab"})
    typed = set(known[:20]) | {"", "a", "z"}
    for _ in range(250):
        text = list(rng.choice(known))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(text) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                text.insert(at, rng.choice(alphabet))
            elif text and at < len(text):
                text[at : at + 1] = [] if kind == 1 else [rng.choice(alphabet)]
        typed.add("".join(text))
    got = {r["typed"]: r["name"] for r in names.alike(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(k,) for k in known], "name string"), cutoff).collect()}
    want = {t: plain_best(t, known, cutoff) for t in typed if plain_best(t, known, cutoff)}
    assert got == want and len(want) > 20


def test_few_pairs_meet(spark):
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(400)]
    typed = [k[:5] + k[6:] for k in known]
    tokens = names.alike(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(k,) for k in known], "name string"))
    assert tokens.count() == 400
    assert names.pairs_needed(12, 0.9) >= 6  # of 11 pairs: a name emits its rarest five


def test_long_names(spark):
    known = ["a" * 70 + "b" * 70, "c" * 100]
    typed = ["a" * 70 + "b" * 69, "c" * 95]
    got = {r["typed"]: r["name"] for r in names.alike(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(k,) for k in known], "name string")).collect()}
    assert got == dict(zip(typed, known, strict=True))


def test_aliases_combinations_and_empties(spark):
    rows = [(1, "Kutch"), (2, "Kachchh"), (3, "Kachchhh"), (4, "A & B"), (5, "12"), (6, None), (7, "Xyzzy"), (8, "North and South")]
    got = {r["id"]: (r["name"], r["how"]) for r in names.resolved(spark.createDataFrame(rows, "id int, district string"), spark.createDataFrame([("kachchh",), ("jamnagar",)], "name string"), {"kutch": "kachchh"}, r"[&/,]| and |\+").collect()}
    assert got == {1: ("kachchh", "alias"), 2: ("kachchh", "exact"), 3: ("kachchh", "fuzzy"), 4: (None, "combo"), 5: (None, "empty"), 6: (None, "empty"), 7: (None, "unmatched"), 8: (None, "combo")}
