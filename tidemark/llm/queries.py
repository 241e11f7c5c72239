"""The ``opN_*`` queries over the driver's tables, and their DuckDB SQL where
SQL can express them on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, chat_format, embedding_dedup, exact_dedup, fingerprint, html_extract, near_dedup, packing, pii, quality, substring_dedup, token_alignment, va_clustering
from tidemark.llm.common import table, text_of

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, BYTE_BPE)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text and its successor."""
    out = fingerprint.compare_edited(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint.as_text(F.col("samples")).alias("fingerprint"),
                      fingerprint.as_text(F.col("edited_samples")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component at 85 % of three-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 200-byte strings."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", substring_dedup.removed_bytes(F.col("removed")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, count="n_entities")


def op6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, sample key and decision."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, with what is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text_of().alias("text"))
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    out = chat_format.format_conversations(turns)
    read = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                      chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: One more backslash in each control string, on top of the marks of each turn.
OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(role || chr(10) || text,
        '[<\[]\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>|/?INST\])')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + marks + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

def op11_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster after ten rounds of eight centroids."""
    out = va_clustering.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3:")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                      va_clustering.centroid_digest(F.col("centroid")).alias("centroid_sha256"))


def _op11_sql(rounds: int = 10) -> str:
    """The rounds one after another, each as an assignment and its means."""
    sql = ["""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM e ORDER BY 1, 2 LIMIT 8))"""]
    for i in range(rounds + 1):
        sql.append(f"""
a{i} AS MATERIALIZED (SELECT r, min(d * 16 + c) // 16 AS d, min(d * 16 + c) % 16 AS c
  FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, c{i}) GROUP BY r)""")
        if i < rounds:
            sql.append(f"""
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (
  SELECT c, list(q ORDER BY i) AS m FROM (
    SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS q FROM a{i} JOIN p USING (r) GROUP BY c, i) GROUP BY c) n ON o.c = n.c)""")
    return ",".join(sql) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN c{rounds} USING (c)"""


OP11_SQL = _op11_sql()

def op12_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component at a cosine of 0.93."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


OP12_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS MATERIALIZED (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)
                   AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS u, b.r AS w FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
                   WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.93),
reach(r, s) AS (SELECT r, r FROM e UNION SELECT reach.r, l.w FROM reach JOIN l ON reach.s = l.u),
c AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN e o ON reach.s = o.r GROUP BY reach.r)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.r) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c USING (r)
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its links between the tokens of two tokenizers."""
    documents, _ = token_alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE_JSON, PIECE_BPE)
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_weighted_sampling, op3_minhash_forest, op4_suffix_dedup, op5_surrogates, op6_style_tree, op7_importance_resampling, op8_pack_power_of_two, op9_exact_dedup, op10_chat_format, op11_va_file, op12_product_quantisation, op13_token_alignment)}
ORACLES = {"op9_exact_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_va_file": OP11_SQL, "op12_product_quantisation": OP12_SQL}
