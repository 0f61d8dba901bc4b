"""The training-data queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.substring import digest

    return digest(table(spark, sf_dir, "documents"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.quality import held_out, learn, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.language import held_out, identify

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.neardup_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.sharding import shards

    placed = shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.common import id_crc
    from siteloom.llm.merkle import manifest

    chosen = F.col("doc_id").isNotNull() & (F.pmod(id_crc("doc_id"), F.lit(2)) == 0)
    without = F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(table(spark, sf_dir, "documents"), tampered={"text": without})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 34)) AS u(i)
), r AS (
  SELECT g FROM g GROUP BY g HAVING count(*) > 1
), c AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM g JOIN r USING (g)) GROUP BY doc_id
), k AS (
  SELECT doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][CAST((source_rank - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, cap / weight AS ratio, sum(cap) OVER o AS capped, sum(weight) OVER o AS capped_weight, sum(source_size) OVER () AS words, sum(weight) OVER () AS all_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, source_rank ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT *, (1.5::DOUBLE * words::DOUBLE - (capped - cap)::DOUBLE) / (all_weight - (capped_weight - weight))::DOUBLE AS own_level FROM r
), x AS (
  SELECT *, (SELECT own_level FROM l l2 WHERE l2.ratio >= l2.own_level ORDER BY ratio, source_rank LIMIT 1) AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN cap::DOUBLE ELSE weight * level END AS target,
         CAST(('0x' || substr(md5('siteloom-mix-1' || coalesce('=' || source, '-')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS off
  FROM x
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor((i + 1) * rate + off) - floor(i * rate + off)) AS BIGINT) * size AS taken,
       CAST((floor((i + 1) * rate + off) - floor(i * rate + off)) AS BIGINT) AS copies, source
FROM p
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST(('0x' || substr(hex, CAST(i // 4 AS INT) * 5 + 1, 5)) AS BIGINT) >> CAST(15 - (i % 4) * 5 AS INT)) & 31) + 1 AS INT), 1)), '') AS digest FROM p
), f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY digest)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (digest)
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


#: crc32 is not in DuckDB: its bits are shifted in one by one. A tree is kept as its levels, and a leaf's proof is what each level has beside its place.
OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, replace(text, chr(10), '') AS plain,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc
  FROM documents
), h AS (
  SELECT doc_id, source,
    sha256(array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS leaf,
    sha256(array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN plain ELSE text END], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS seen
  FROM c
), leaves AS (
  SELECT *, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM h
), up AS (
  SELECT tree, 0::BIGINT AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, level, place // 3
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 1000::BIGINT AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 3
), step AS (
  SELECT tree, level, place, concat(lag(digest, 2) OVER r, lag(digest) OVER r) AS l, concat(lead(digest) OVER r, lead(digest, 2) OVER r) AS r FROM up WHERE n > 1 WINDOW r AS (PARTITION BY tree, level, place // 3 ORDER BY place)
), top_step AS (
  SELECT level, place, concat(lag(digest, 2) OVER r, lag(digest) OVER r) AS l, concat(lead(digest) OVER r, lead(digest, 2) OVER r) AS r FROM top WHERE n > 1 WINDOW r AS (PARTITION BY level, place // 3 ORDER BY place)
), path AS (
  SELECT x.tree, x.place, s.level, s.l, s.r FROM leaves x JOIN step s ON s.tree = x.tree AND s.place = x.place // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT x.tree, x.place, s.level, s.l, s.r FROM leaves x JOIN subroots b ON b.tree = x.tree JOIN top_step s ON s.place = b.place // CAST(pow(3, s.level - 1000) AS BIGINT)
), proof AS (
  SELECT tree, place, list({'l': l, 'r': r} ORDER BY level) AS steps, string_agg(concat(l, r), '' ORDER BY level) AS siblings FROM path GROUP BY tree, place
), folded AS (
  SELECT x.*, b.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend({'l': seen, 'r': ''}, coalesce(steps, [])), lambda a, s: {'l': sha256(concat(s.l, a.l, s.r)), 'r': ''}).l AS folded_root
  FROM leaves x JOIN subroots b USING (tree) LEFT JOIN proof p ON p.tree = x.tree AND p.place = x.place
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_fm, op3_simhash_near_dedup, op4_mixing, op5_warc, op6_exact_topk, op7_language_id, op8_embedding_near_dedup, op9_sharding, op10_packing, op11_merkle_manifest, op12_whitening, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_mixing": OP4_SQL, "op5_warc": OP5_SQL, "op6_exact_topk": OP6_SQL, "op8_embedding_near_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL}
