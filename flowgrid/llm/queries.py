"""The registered queries of the llm operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, conversations, htmltext, media, ordermin, packing, pii, quality, repeats, secrets, simhash, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_after_damage(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_digests(clusters.clustered(table(spark, sf_dir, "embeddings")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_order_minhash": op1_order_minhash, "op2_secrets": op2_secrets, "op3_pii": op3_pii, "op4_html_text": op4_html_text, "op5_jpeg": op5_jpeg, "op6_quality": op6_quality, "op7_bpe": op7_bpe, "op8_token_counts": op8_token_counts, "op9_packing": op9_packing, "op10_simhash": op10_simhash, "op11_conversation_repair": op11_conversation_repair, "op12_centroids": op12_centroids, "op13_substring_dedup": op13_substring_dedup}


def centroid_sql(k: int = clusters.K, rounds: int = clusters.ROUNDS, dim: int = clusters.DIM) -> str:
    """The rounds written out, one after another, on single components."""
    finite = "x IS NOT NULL AND isfinite(x) AND abs(x) < 131072"
    sql = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, embedding FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: {finite})) = {dim}),
    parts AS MATERIALIZED (SELECT i, d, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dim + 1}) AS t(d)),
    first AS (SELECT i, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS j FROM kept QUALIFY j < {k}),
    c0 AS MATERIALIZED (SELECT j, d, x FROM first JOIN parts USING (i))"""
    for n in range(rounds + 1):
        sql += f""", a{n} AS MATERIALIZED (SELECT i, CAST(arg_min(j, far * {k} + j) AS INTEGER) AS j, min(far) AS far FROM (SELECT i, j, sum((p.x - c.x) * (p.x - c.x)) AS far FROM parts p JOIN c{n} c USING (d) GROUP BY i, j) GROUP BY i)"""
        if n < rounds:
            sql += f""", m{n} AS (SELECT j, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN parts USING (i) GROUP BY j, d),
    c{n + 1} AS MATERIALIZED (SELECT j, d, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{n} LEFT JOIN m{n} USING (j, d))"""
    return f"""{sql}, digest AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
    SELECT vec_id, j AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (i) JOIN digest USING (j)"""


def repeats_sql(width: int = repeats.WIDTH) -> str:
    """All windows of all documents, without anchors."""
    return f"""WITH docs AS (SELECT row_number() OVER () AS i, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
    windows AS (SELECT i, doc_id, p, list_aggregate(words[p:p + {width - 1}], 'string_agg', ' ') AS w FROM docs, range(1, len(words) - {width - 2}) AS t(p)),
    covered AS (SELECT DISTINCT i, p + k AS p FROM windows JOIN (SELECT w, min(doc_id) AS first FROM windows GROUP BY w) USING (w), range(0, {width}) AS t(k) WHERE first < doc_id),
    gone AS (SELECT i, list(p) AS places, count(*) AS n FROM covered GROUP BY i)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
        sha256(coalesce(list_aggregate(CASE WHEN n > 0 THEN list_filter(words, lambda w, k: NOT list_contains(places, k)) ELSE words END, 'string_agg', ' '), '')) AS kept_sha256 FROM docs LEFT JOIN gone USING (i)"""


def oracle_sql() -> dict[str, str]:
    return {"op12_centroids": centroid_sql(), "op13_substring_dedup": repeats_sql()}
