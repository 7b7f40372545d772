"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, merkle, mixing, neardup, warc


#: Vocabulary files of the tokenizers; never copied into the repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTES = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, linked from a similarity of 0.85 on."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    from strandline.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another conversation's last reply; spans as text."""
    from strandline.llm.chat import preference, spans_text, with_neighbour_replies

    turns = _table(spark, sf_dir, "conversations")
    out = preference(turns, with_neighbour_replies(turns), "conv_id")
    return out.withColumns({c: spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, checksum, shard (of 24) and slot; the law is that of rows, so grown_shard is null."""
    from strandline.llm.sharding import LAW, digest, shard

    out = shard(digest(_table(spark, sf_dir, "documents")), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its block, release time, deadline, slot and position in the mix of sources."""
    from strandline.llm.mixing import schedule

    return schedule(_table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


def op6_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every vector whose vec_id is divisible by 50."""
    from strandline.llm.ann import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer products of every vector whose vec_id is divisible by 100."""
    from strandline.llm.topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_sentencepiece(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back, of every whole text."""
    from strandline.llm.sentencepiece import encode, load

    return encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), load(pieces), check=True, carry=["doc_id"])


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    from strandline.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    from strandline.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, a: str = BYTES, b: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text."""
    from strandline.llm.crosstok import digests

    return digests(_table(spark, sf_dir, "documents"), a, b)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from WARC archives."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


LLM_QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity, op3_preference_format, op4_sharding, op5_source_mixing, op6_cross_polytope_ann, op7_exact_topk, op8_sentencepiece, op9_html_extraction, op10_language_id, op11_cross_tokenizer_alignment, op12_merkle_manifest, op13_warc)}
LLM_SQL = {
    "op1_minhash_near_dedup": neardup.SQL,
    "op3_preference_format": chat.SQL,
    "op5_source_mixing": mixing.SQL,
    "op12_merkle_manifest": merkle.sql(),
    "op13_warc": warc.SQL,
    "op7_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(v.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
