"""Queries of vectors, override audits and runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import editing, vectors
from tidewire.plans.registry import query
from tidewire.session import table

_STEPS = 16
_CHAIN = "SELECT doc_id, [sha256(lower(coalesce(text, '')))] AS h FROM documents"
for _ in range(_STEPS - 1):
    _CHAIN = f"SELECT doc_id, list_append(h, sha256(unhex(h[-1]))) AS h FROM ({_CHAIN})"


@query("hash_embeddings", f"""WITH chained AS ({_CHAIN}), digits AS (SELECT doc_id, array_to_string(h, '') AS x FROM chained),
bytes AS (SELECT doc_id, list_transform(range(0, 512), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)) AS b FROM digits)
SELECT doc_id, 512 AS dimensions, CAST(list_sum(b) AS BIGINT) AS total, CAST(b[1] AS BIGINT) AS first, CAST(b[512] AS BIGINT) AS last,
  CAST(list_sum(list_transform(range(1, 513), lambda i: i * b[i])) AS BIGINT) AS placed FROM bytes""", bound=False)
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", vectors.hash_embedding(F.col("text")).alias("v"))
    byte = F.transform("v", lambda x: F.round((x + 1) * 127.5).cast("long"))
    rows = rows.select("doc_id", "v", byte.alias("b"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", F.size("v").alias("dimensions"), F.aggregate("b", zero, lambda a, x: a + x).alias("total"), F.element_at("b", 1).alias("first"),
        F.element_at("b", -1).alias("last"), F.aggregate(F.transform("b", lambda x, i: x * (i + 1)), zero, lambda a, x: a + x).alias("placed"))


@query("vector_upsert", """WITH stored AS (SELECT vec_id, 'm1' AS model, label AS hash, CASE WHEN vec_id % 4 > 0 THEN vec_id END AS run_id FROM embeddings WHERE vec_id % 5 > 0),
fresh AS (SELECT e.vec_id, 'm2' AS model, label + 1 AS hash, coalesce(CASE WHEN e.vec_id % 2 = 0 THEN 7 END, s.run_id) AS run_id FROM embeddings e LEFT JOIN stored s USING (vec_id) WHERE e.vec_id % 3 = 0),
both_ AS (SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE vec_id % 3 > 0)
SELECT vec_id AS article_id, model, run_id FROM both_ JOIN (SELECT vec_id, label + CASE WHEN label % 2 = 0 AND vec_id % 3 = 0 THEN 1 ELSE 0 END AS now_ FROM embeddings) USING (vec_id) WHERE hash = now_ AND vec_id % 11 > 0""", bound=False)
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf, "embeddings")
    made = lambda model, source, run: [i.alias("article_id"), F.lit(model).alias("model"), F.col("embedding").alias("vector"), source.cast("string").alias("source_hash"), run.cast("long").alias("run_id")]
    stored = rows.where(i % 5 > 0).select(*made("m1", label, F.when(i % 4 > 0, i)))
    fresh = rows.where(i % 3 == 0).select(*made("m2", label + 1, F.when(i % 2 == 0, F.lit(7))))
    now = rows.select(i.alias("article_id"), (label + F.when((label % 2 == 0) & (i % 3 == 0), 1).otherwise(0)).cast("string").alias("source_hash"))
    kept = vectors.current_vectors(vectors.upsert_vectors(stored, fresh), now)
    return vectors.drop_vectors(kept, rows.where(i % 11 == 0).select(i.alias("article_id"))).select("article_id", "model", "run_id")


@query("override_audit", r"""WITH p AS (SELECT doc_id, CASE WHEN lang IS NULL OR length(text) % 7 = 0 THEN [] ELSE [lang] END AS tags FROM documents WHERE source IS NOT NULL AND doc_id % 10 > 0),
o AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 5 = 1 THEN ['x'] ELSE [] END AS tags FROM documents WHERE n_chars % 9 > 0),
s AS (SELECT doc_id, doc_id * 10 + k AS id, (doc_id * 7 + k * 3) % 5 AS made, CASE WHEN (doc_id + k) % 3 > 0 THEN 'ai' ELSE 'manual' END AS origin, (doc_id + k) % 4 AS manual
  FROM documents, range(0, 3) AS r(k) WHERE doc_id % 8 > 0),
latest AS (SELECT doc_id, arg_max(id, (made, id)) AS id, arg_max(origin, (made, id)) AS origin, arg_max(manual, (made, id)) AS manual FROM s GROUP BY doc_id)
SELECT d.doc_id AS article_id, CAST(l.id AS BIGINT) AS submission_id, CASE
  WHEN p.doc_id IS NULL OR o.doc_id IS NULL OR l.doc_id IS NULL THEN 'unexpected_missing_record' WHEN o.tags IS NULL THEN 'already_repaired'
  WHEN len(o.tags) > 0 THEN 'unexpected_nonempty_override' WHEN len(p.tags) = 0 THEN 'unexpected_empty_ai_tags' WHEN l.origin <> 'ai' THEN 'unexpected_non_ai_provenance'
  WHEN l.manual = 3 THEN 'unexpected_manual_tags' ELSE 'eligible' END AS status
FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN latest l USING (doc_id)""", bound=False)
def override_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    d, n, none = F.col("doc_id"), F.col("n_chars"), F.array().cast("array<string>")
    processed = docs.where(F.col("source").isNotNull() & (d % 10 > 0)).select(
        d.alias("article_id"), F.when(F.col("lang").isNull() | (F.length("text") % 7 == 0), none).otherwise(F.array("lang")).alias("tags"))
    overrides = docs.where(n % 9 > 0).select(d.alias("article_id"), F.when(n % 5 == 1, F.array(F.lit("x"))).when(n % 5 > 1, none).alias("tags"))
    k = F.col("k")
    manual = F.when((d + k) % 4 == 0, F.lit(None)).when((d + k) % 4 == 1, "{}").when((d + k) % 4 == 2, '{"tags": []}').otherwise('{"tags": ["y"]}')
    submissions = docs.where(d % 8 > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        d.alias("article_id"), (d * 10 + k).alias("submission_id"), ((d * 7 + k * 3) % 5).alias("created_at"),
        F.to_json(F.struct(F.when((d + k) % 3 > 0, "ai").otherwise("manual").alias("tags"))).alias("field_provenance"), manual.alias("manual_fields"))
    return editing.audit_tag_overrides(docs.select(d.alias("article_id")), processed, overrides, submissions).select("article_id", "submission_id", "status")


@query("run_states", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderkey % 4 > 0 THEN 'succeeded' ELSE 'running' END AS status,
  CASE WHEN o_orderkey % 4 > 0 AND o_orderstatus = 'F' THEN 'old' WHEN o_orderkey % 5 = 0 THEN 'scoring' WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'old' END AS phase,
  CASE WHEN o_orderkey % 3 = 0 THEN 9 WHEN o_orderkey % 5 = 0 AND NOT (o_orderkey % 4 > 0 AND o_orderstatus = 'F') THEN o_orderkey % 100 WHEN o_orderkey % 4 > 0 THEN 1 END AS raw_count,
  CASE WHEN o_orderkey % 6 = 0 THEN 5 WHEN o_orderkey % 3 = 0 THEN 77 END AS ended FROM orders""", bound=False)
def run_states(spark: SparkSession, sf: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    orders = table(spark, sf, "orders")
    long = lambda c: c.cast("long")
    runs = orders.where(k % 4 > 0).select(
        k.alias("id"), day.alias("started_at"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running").alias("status"), F.lit("old").alias("phase"),
        long(F.lit(1)).alias("raw_count"), F.lit(None).cast("timestamp").alias("finished_at"))
    runs = editing.start_runs(runs, orders.where(k % 4 == 0).select(k.alias("id"), day.alias("started_at"), F.lit(None).cast("string").alias("phase")))
    runs = editing.progress_runs(runs, orders.where(k % 5 == 0).select(k.alias("id"), F.lit("scoring").alias("phase"), long(k % 100).alias("raw_count")))
    results = orders.where(k % 3 == 0).select(k.alias("id"), F.lit("failed").alias("status"), long(F.lit(9)).alias("raw_count"),
                                              F.when(k % 2 == 0, F.timestamp_seconds(F.lit(5))).alias("finished_at"))
    runs = editing.finish_runs(runs, results, F.lit(datetime(1970, 1, 1, 0, 1, 17)))
    return runs.select("id", "status", "phase", "raw_count", F.unix_seconds("finished_at").alias("ended"))
