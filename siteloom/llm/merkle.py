"""Merkle manifest of a table: a tree for each group of rows, and a tree over the groups' roots.

A row's leaf is the hash of its columns, each as ``length:value``. The leaves of
a group stand by id, and every ``FANOUT`` consecutive nodes become their hash
until one is left, the group's subroot; the subroots by group become the root
in the same way. Hashes are sha256 over hex text.

The tree is built from below, a job a level: nodes are grouped by group and
place divided by ``FANOUT``, so the largest group is spread over all tasks, and
a level is staged as runs (place, digest, the digests it was made of). Proofs
are pushed from the top down: a level's rows join the runs above by that same
place, and each puts its own siblings before the proof it inherits. So a proof
is written once for each node, never looked up level by level for each row,
and no task holds a group.

Null groups are a group of their own, which comes first; an empty group is
another. Null ids come first. Rows alike in id are put in order by their leaf;
repeated rows get a leaf and a proof each. Null columns count as ``-``. A null
id counts as not tampered. Texts are hashed whole. An empty table gives no
rows. Columns that are not named play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import drop_staged, staged
from siteloom.llm.ranks import ranked

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def leaf_of(columns: list[Column]) -> Column:
    """The hash of the columns: a null as ``-``, a value as its UTF-8 bytes' number, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, id, leaf and more) with each one's ``place`` in its tree, from 0."""
    slim = staged(leaves.withColumn("none", F.lit(0).cast("long")))
    out = ranked(slim, "tree", ["id", "leaf"], "none").drop("none", "before").withColumnRenamed("position", "place")
    drop_staged(slim)
    return out


def runs_of(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, place, digest), each staged: tree, place, kids, digest, finished.

    A tree that has come down to one node is finished: that node stands once
    more, alone and with its own digest, and then no more.
    """
    most = nodes.agg(F.max("place")).first()[0]
    below, out, width = nodes, [], (most or 0) + 1
    while True:
        alone = (F.col("place") == 0) & (F.size("kids") == 1)
        runs = below.groupBy("tree", F.floor(F.col("place") / FANOUT).alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("kids"))
        runs = runs.withColumn("finished", alone).withColumn("digest", F.when(F.col("finished"), F.col("kids")[0]).otherwise(F.sha2(F.array_join("kids", ""), 256)))
        out.append(staged(runs))
        if width == 1:
            return out
        width = -(-width // FANOUT)
        below = out[-1].where("NOT finished")


def pushed(nodes: DataFrame, runs: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """``nodes`` with ``subroot``, their tree's, and ``proof``: their siblings left and right at each level, then what ``inherited`` (tree, proof) has for the tree."""
    above: DataFrame | None = None
    for level in [*reversed(runs), nodes]:
        lowest = level is nodes
        own = level if lowest else level.where("NOT finished")
        if above is None:
            own = own.withColumns({"subroot": F.lit(None).cast("string"), "proof": F.lit(None).cast(PROOF)}).where(F.lit(False))
        else:
            up = above.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), F.col("kids").alias("up_kids"), F.col("finished").alias("up_finished"), "subroot", F.col("proof").alias("up_proof"))
            at = F.pmod("place", F.lit(FANOUT)).cast("int")
            siblings = F.struct(F.array_join(F.slice("up_kids", F.lit(1), at), "").alias("left"), F.array_join(F.slice("up_kids", at + 2, F.lit(FANOUT)), "").alias("right"))
            own = own.join(up, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("place") / FANOUT) == F.col("up_place")))
            own = own.withColumn("proof", F.when(F.col("up_finished"), F.col("up_proof")).otherwise(F.concat(F.array(siblings), "up_proof"))).drop("up_tree", "up_place", "up_kids", "up_finished", "up_proof")
        if lowest:
            return own
        ended = level.where("finished").join(inherited.select("tree", "proof"), "tree").withColumn("subroot", F.col("digest"))
        now = staged(own.drop("digest").unionByName(ended.drop("digest")))
        if above is not None:
            drop_staged(above)
        above = now
    raise ValueError("no level")


def prove(leaves: DataFrame) -> tuple[str | None, DataFrame]:
    """The root, and ``leaves`` (tree, id, leaf and more) with place, subroot and proof."""
    nodes = placed(leaves).withColumn("digest", F.col("leaf"))
    runs = runs_of(nodes)
    ends = runs[0].where("finished").select("tree", "digest")
    for level in runs[1:]:
        ends = ends.unionByName(level.where("finished").select("tree", "digest"))
    # The tree of the subroots: a row for each group.
    tops = ranked(ends.select(F.col("tree").alias("of"), "digest", F.lit(0).cast("long").alias("none")), None, ["of"], "none").select("of", "digest", F.col("position").alias("place"), F.lit("").alias("tree"))
    top_runs = runs_of(tops)
    found = top_runs[-1].select("digest").first()
    start = top_runs[-1].select("tree").distinct().withColumn("proof", F.array().cast(PROOF))
    suffixes = staged(pushed(tops, top_runs, start).select(F.col("of").alias("tree"), "proof"))
    out = pushed(nodes, runs, suffixes).drop("digest")
    drop_staged(*top_runs, *runs, suffixes)
    return found[0] if found else None, out


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, F.col(leaf), lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(proof: str = "proof") -> Column:
    """The hash of all siblings of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_column: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof, proof_sha256, folded_root and verified of every row.

    ``tampered`` gives for some of the columns what stands there when the row is
    verified; without it every row is verified as it is.
    """
    tampered = tampered or {}
    seen = [tampered.get(c, F.col(c)) for c in columns]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # nulls first, then bytewise
    leaves = docs.select(tree.alias("tree"), F.col(id_column).alias("id"), leaf_of([F.col(c) for c in columns]).alias("leaf"), leaf_of(seen).alias("seen"))
    root, proven = prove(leaves)
    out = proven.select(F.col("id").alias(id_column), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", proof_digest().alias("proof_sha256"), folded("seen").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
