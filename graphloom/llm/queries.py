"""The operators of this subpackage over the driver's tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction, fim, langid, mixing, order_minhash, packing, sharding, simhash, substring, topk, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return got.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.classes(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compared(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return got.select("doc_id", (langid.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.cut(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "_cut.n_words", "_cut.n_removed", F.sha2("_cut.kept", 256).alias("kept_sha256"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extraction.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).taken.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = fim.restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c.cast("binary"), 256).alias(n) for n, c in (("output_sha256", F.col("output")), ("restored_sha256", whole))])


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    return got.select("doc_id", (toxicity.fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP5_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL}
