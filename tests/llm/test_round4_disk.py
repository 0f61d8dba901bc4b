"""The pipeline's disk follows its texts: the fourth round's finding."""

import os
import random
from urllib.parse import urlparse

import corpus_pipeline
import numpy as np
import pytest

from siteloom.llm import simhash
from siteloom.operators.staging import shared_dir, staged
from tests.llm.test_texts import docs_of, words


def tables(spark) -> set[str]:
    folder = f"{urlparse(shared_dir(spark)).path}/siteloom"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_stage_leaves_only_what_the_next_one_reads(spark, tmp_path, monkeypatch):
    docs_of(spark, ["a", "b", "c"]).write.parquet(str(tmp_path / "documents.parquet"))
    before, seen = tables(spark), []

    def stage(spark, docs, sf_dir):
        seen.append(tables(spark) - before)
        aside = staged(docs.select("doc_id"))  # a stage's result may read it until it is written
        return docs.join(aside, "doc_id")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage) for k in range(4)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert [len(x) for x in seen] == [0, 1, 1, 1]


def test_alike_sets_share_one_of_their_rarest():
    rng = np.random.default_rng(8)
    sets = [rng.choice(400, rng.integers(1, 40), replace=False).astype(np.uint64) for _ in range(60)]
    for _ in range(300):
        own = sets[rng.integers(60)]
        sets.append(np.unique(np.concatenate((own[rng.random(len(own)) < rng.choice([1, 0.95, 0.85])], rng.choice(400, rng.integers(0, 5), replace=False).astype(np.uint64)))))
    values, times = np.unique(np.concatenate(sets), return_counts=True)
    often = dict(zip(values.tolist(), times.tolist(), strict=True))
    for similarity in (0.5, 0.8, 1.0):
        rare = []
        for x in sets:
            kept = x[[often[v] > 1 for v in x.tolist()]] if len(x) else x
            rare.append(set(simhash.rarest(kept, np.array([often[v] for v in kept.tolist()], np.uint32), len(x), similarity).tolist()))
        full, found = [set(x.tolist()) for x in sets], 0
        for i, a in enumerate(full):
            for j, b in enumerate(full[:i]):
                if a and b and len(a & b) >= similarity * len(a | b):
                    found += 1
                    assert rare[i] & rare[j]
        assert found > 20


@pytest.fixture
def compared(monkeypatch):
    """The texts that go into blocks."""
    seen = []

    def tile_links(groups, sets, similarity, links=simhash.tile_links):
        seen.append({bytes(r["node"]) for r in groups.collect()})
        return links(groups, sets, similarity)

    monkeypatch.setattr(simhash, "tile_links", tile_links)
    return seen


def test_only_texts_that_share_rare_shingles_go_into_blocks(spark, compared):
    """One bag of words in many orders is a group of candidates without a link, but for two texts that the least one hides from each other."""
    rng = random.Random(5)
    bag = words(rng, 100)
    orders = [rng.sample(bag, 100) for _ in range(40)]
    near = [*orders[7][:-2], orders[7][-1], orders[7][-2]]
    texts = [" ".join(x) for x in (*orders, near)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs_of(spark, texts)).collect()}
    assert got == {**{i: i for i in range(40)}, 40: 7}
    assert len(compared) == 1 and compared[0] <= {simhash.text_nodes([texts[i]])[0] for i in (7, 40)}


def test_pairs_of_blocks_go_in_rounds(spark, monkeypatch):
    """A group whose blocks meet in many pairs sends no more at once than the blocks hold, and connects the same texts."""
    rng = random.Random(6)
    texts = []
    for _ in range(2):  # two chains: each text alike to the next few
        base = words(rng, 200)
        for i in range(30):
            base[(i * 3) % 200] = f"own{i}"
            texts.append(" ".join(base))
    sets = [(simhash.text_nodes([x])[0], np.unique(np.asarray(simhash.shingle_hashes(x, 5), np.uint64)).tobytes()) for x in texts]
    frame = spark.createDataFrame(sets, "node binary, shingles binary")
    groups = spark.createDataFrame([(n, b"g", True, b"") for n, _ in sets], "node binary, group binary, loose boolean, of binary")
    monkeypatch.setattr(simhash, "TILE", 4)
    rounds = []
    monkeypatch.setattr(simhash, "rounds_for", lambda sent, held, f=simhash.rounds_for: rounds.append(f(sent, held)) or rounds[-1])
    found = {(bytes(r["u"]), bytes(r["v"])) for r in simhash.tile_links(groups, frame, 0.8).collect()}
    assert rounds[0] > 4
    place, label = {n: i for i, (n, _) in enumerate(sets)}, list(range(60))
    find = lambda x: x if label[x] == x else find(label[x])
    for u, v in found:
        label[find(place[u])] = find(place[v])
    roots = [find(i) for i in range(60)]
    assert len(set(roots[:30])) == len(set(roots[30:])) == 1 and roots[0] != roots[30]
