"""Registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatguard.llm import anchors, dartminhash, decontam, maintext, mixing, orchard, packing, pii, prefixtrie, reshard, toxicity, urlrules, vafile
from chatguard.llm.store import keep, new_folder

# A public rank file that every worker holds; CHATGUARD_VOCABULARY names another.
VOCABULARY = os.environ.get("CHATGUARD_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", vafile.scaled("embedding").alias("vec"))
    return vafile.exact_top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(50)) == 0), k=5)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicate_classes(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_hits").alias("hits"))


def op6_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = _table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(16))
    slim, plan = reshard.plan_reshard(docs, old, old_shards=16, new_shards=24)
    path = new_folder(spark, "resharded")
    shard, slot = reshard.rewrite_affected(docs, old, plan, path)
    # Rows of rewritten shards are read from their files, the others stand where the plan says they stay.
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    written = spark.read.parquet(path).select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.col(shard).cast("int").alias("shard"), F.col(slot).alias("slot"), F.coalesce(old, F.lit(0)).cast("int").alias("old_shard"))
    stays = reshard.assigned(slim, plan).filter(~F.col("shard").isin(plan.changed)).select(*written.columns)
    rows = written.unionByName(stays)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_personal_data(docs, pii.train(docs))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), "rule", "verdict")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = maintext.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = keep(_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size")), "mix-sizes")
    mixed = mixing.mix_to_targets(sized)
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))


def op11_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = anchors.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "removed")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = orchard.cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    components = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(components, 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_packing": op3_token_packing,
    "op4_dart_minhash": op4_dart_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_flow_reshard": op6_flow_reshard,
    "op7_personal_data": op7_personal_data,
    "op8_url_filter": op8_url_filter,
    "op9_main_text": op9_main_text,
    "op10_mix_sources": op10_mix_sources,
    "op11_block_anchors": op11_block_anchors,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_orchard_clusters": op13_orchard_clusters,
}

def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd rounds as one chain of tables: c0, then a<i> (assignment to c<i>) and c<i + 1> (its means)."""
    parts = ["""WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, vec) - 1 AS c, vec FROM (
            SELECT sha256('2:' || vec_id) AS h, vec FROM v WHERE vec_id IS NOT NULL ORDER BY h, vec LIMIT {k}))"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT n, c, CAST(list_sum(list_transform(list_zip(v.vec, c{i}.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i}),
        a{i} AS (SELECT n, c, d FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, c) AS r FROM d{i}) WHERE r = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a{i}.c, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM a{i} JOIN v USING (n)) GROUP BY c, i),
        c{i + 1} AS (SELECT c, coalesce(m.vec, c{i}.vec) AS vec FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY i) AS vec FROM s{i} GROUP BY c) m USING (c))""")
    parts.append(f"""t AS (SELECT c, CAST(sum(d) AS BIGINT) AS spread FROM a{rounds} GROUP BY c)""")
    return ",\n        ".join(parts) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, spread AS cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia,
               sha256(array_to_string(center, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (n) JOIN t USING (c) JOIN (SELECT c, vec AS center FROM c{rounds}) m USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
            WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_url_filter": r"""
        WITH p AS (
            SELECT page_id, lower(coalesce(url, '')) AS whole,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        f AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
            FROM p)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(whole, '[/.-]cheap-pills[.-]|[/.-]casino[/.-]|[/.-]torrents[/.-]|[/.-]porn[/.-]|://ads\.|/login([/?#.]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM f""",
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, h) AS r FROM t),
        ids AS (
            SELECT c, c - c % 20 AS base, (4294967295 - list_reduce(
                [4294967295] || list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT)),
                lambda x, b: list_reduce([xor(x, b)] || [CAST(0 AS BIGINT) for z in range(8)], lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS take
            FROM (SELECT DISTINCT c FROM t)),
        s AS (
            SELECT ids.c, o.r AS d, o.h, o.words FROM ids JOIN o ON o.c = ids.base AND o.r <= take
            UNION ALL
            SELECT ids.c, least(take, coalesce(b.n, 0)) + o.r - take, o.h, o.words
            FROM ids JOIN o ON o.c = ids.c AND o.r > take LEFT JOIN (SELECT c, count(*) AS n FROM o GROUP BY c) b ON b.c = ids.base),
        p AS (
            SELECT c, d, words, md5(string_agg(h, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM s
            UNION ALL SELECT c, 0, 0, 'root' FROM ids),
        n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, k),
        up AS (SELECT DISTINCT p.d, p.k, q.k AS pk FROM p JOIN p q ON q.c = p.c AND q.d = p.d - 1),
        kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM up GROUP BY ALL),
        facts AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
        below AS (
            SELECT p.d, p.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
            FROM facts f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY ALL),
        ends AS (
            SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha
            FROM (SELECT c, arg_max(k, d) AS k, max(d) AS d FROM p GROUP BY c) GROUP BY d, k)
        SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
        FROM facts f JOIN below USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN n a ON a.d = f.d - 1 AND a.k = up.pk LEFT JOIN ends USING (d, k)""",
    "op13_orchard_clusters": _clusters_sql(),
}
