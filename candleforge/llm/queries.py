"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm import mixing, neighbours, packing, quality, secrets, sharding, simhash, substrings, suffixes, topk
from candleforge.llm.common import shared_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words and more that repeat earlier ones."""
    return suffixes.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_latent_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that earlier documents have."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and its place there, by the map stored for this table."""
    store = f"{shared_root(spark)}/slot-maps/{xxhash.xxh64_hexdigest(sf_dir)}"
    rows, _ = sharding.shard(_table(spark, sf_dir, "documents"), store=store)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, from the ledger in the shared folder, to which contents not seen before are added."""
    found = secrets.document_findings(_table(spark, sf_dir, "documents"), secrets.BlobLedger.shared(spark))
    text = secrets.span_text(F.col("spans"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth embedding."""
    return topk.search(_table(spark, sf_dir, "embeddings"))


_OP10_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


def _op9_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS k, t, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS m,
  regexp_extract_all(t, '{p}', {r.group}) AS g, {r.least} AS least FROM d""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({" UNION ALL ".join(parts)}),
each AS (SELECT doc_id, kind, k, gaps, m, g, least, unnest(range(1, len(m) + 1)) AS i FROM raw),
hit AS (SELECT doc_id, kind, k, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n FROM each WHERE length(g[i]) >= least),
found AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (doc_id)"""


_QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_simhash_dedup, op2_nn_descent, op3_sparse_suffixes, op4_latent_voting, op5_countmin_substrings, op6_virtual_slots, op7_certified_packing, op8_entropy_mix, op9_blob_ledger, op10_maxscore)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op9_blob_ledger": _op9_sql(), "op10_maxscore": _OP10_SQL}
