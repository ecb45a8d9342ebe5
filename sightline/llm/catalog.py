"""Queries of the training-data operators over the given tables, and their DuckDB oracles where SQL can say it."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.archives import read_archives, write_archives
from sightline.llm.base import Shelf
from sightline.llm.byte_pairs import decode_content, encode_content
from sightline.llm.digests import byte_copies
from sightline.llm.fingerprints import near_copies
from sightline.llm.language import learn_languages, predict_languages
from sightline.llm.manifest import folded, item_digest, seal_manifest, siblings
from sightline.llm.manifest_sql import manifest_oracle
from sightline.llm.near_vectors import near_identity_vectors
from sightline.llm.packing import packed_sequences
from sightline.llm.passages import repeated_passages
from sightline.llm.periodic import periodic_runs
from sightline.llm.segmentations import sample_segmentations
from sightline.llm.token_counts import edit_trees, plant_trees, redactions
from sightline.llm.token_files import token_documents, write_token_files
from sightline.session import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as fetched content."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.col("text").alias("content"))


def held_out() -> Column:
    """Documents that no model learns from; one without an identifier is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    model = learn_languages(rows.where(~held_out()).select(F.col("text").alias("content"), F.col("lang").alias("language")))
    return predict_languages(documents(spark, sf_dir), model).withColumnRenamed("uri", "doc_id").select(
        "doc_id", held_out().alias("held_out"), F.col("language").alias("lang_pred"), "score", "n_grams", "fit")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("vector"))
    return near_identity_vectors(rows).select(F.col("vec").alias("vec_id"), "n_links", F.col("group").alias("component_id"), "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir)).select(
        F.col("uri").alias("doc_id"), F.lower(F.lpad(F.hex("phash"), 16, "0")).alias("fingerprint"),
        F.col("group").alias("component_id"))


def op4_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(documents(spark, sf_dir), PIECE_VOCABULARY).select(
        F.col("uri").alias("doc_id"), "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Shelf(spark, "captures").path("archives")
    write_archives(table(spark, sf_dir, "pages").select(F.col("page_id").alias("uri"), "url", "html"), path)
    return read_archives(spark, path).select(
        F.col("uri").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_copies(documents(spark, sf_dir)).select(
        F.col("uri").alias("doc_id"), F.col("kept_uri").alias("keep_id"), F.col("copies").alias("group_size"), "kept",
        F.col("sha256").alias("text_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Shelf(spark, "ids").path("files")
    write_token_files(documents(spark, sf_dir), path, WORD_VOCABULARY)
    return token_documents(spark, path).withColumnRenamed("uri", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return edit_trees(plant_trees(rows, WORD_VOCABULARY), redactions(rows), WORD_VOCABULARY).select(
        F.col("uri").alias("doc_id"), "n_edits", "n_tokens_before", "n_tokens", "n_words", "n_words_encoded")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(documents(spark, sf_dir), WORD_VOCABULARY).withColumnRenamed("uri", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).select(
        F.col("uri").alias("doc_id"), "n_words", "n_removed", F.sha2("content", 256).alias("kept_sha256"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_content(encode_content(documents(spark, sf_dir), BYTE_VOCABULARY), BYTE_VOCABULARY)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(F.col("uri").alias("doc_id"), "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256"))


def with_planted_runs(rows: DataFrame) -> DataFrame:
    """``(uri, content)``: every tenth document, by its identifier's CRC-32, repeats itself from some word on."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    rows = rows.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    planted = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("bigint"))
    planted = planted.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> words[int(IF(i < a, i, a + (i - a) % p))]), ' ')")
    return planted.select(F.col("doc_id").alias("uri"), F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("content"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select(F.col("uri").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), longest.alias("r"), lines.alias("lines"), "content")
    return rows.select("doc_id", "n_runs", (-F.col("r.start")).alias("start"), "r.length", (-F.col("r.period")).alias("period"),
                       F.expr("(1000 * r.length) DIV (-r.period)").alias("exponent_milli"),
                       F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("content", 256).alias("collapsed_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("uri", F.col("doc_id"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, item_digest(*[F.col(f) for f in fields[:-1]], lowered))
    sealed = seal_manifest(rows.withColumn("tampered", tampered), fields, carried=["tampered"])
    proof = sealed.select(F.col("uri").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"),
                          folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"))
    return proof.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op1_language_id": op1_language_id, "op2_embedding_dedup": op2_embedding_dedup, "op3_simhash": op3_simhash, "op4_segmentations": op4_segmentations, "op5_warc": op5_warc, "op6_exact_dedup": op6_exact_dedup, "op7_token_files": op7_token_files,
           "op8_token_counts": op8_token_counts, "op9_packing": op9_packing, "op10_substring_dedup": op10_substring_dedup, "op11_byte_pairs": op11_byte_pairs, "op12_periodic_runs": op12_periodic_runs,
           "op13_manifest": op13_manifest}

ORACLES = {
    "op13_manifest": manifest_oracle(),
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
             p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id
                   AND list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))),
             r AS (SELECT vec_id, vec_id AS m FROM v UNION SELECT p.a, r.m FROM r JOIN p ON p.b = r.vec_id)
        SELECT vec_id, (SELECT count(*) FROM p WHERE a = vec_id) AS n_links, min(m) AS component_id, vec_id = min(m) AS kept FROM r GROUP BY vec_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS leader FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, ((i * 5) // 4 + 1)::INT, 2))::INT >> (3 - (i * 5) % 4)::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> leader THEN leader END AS refers_to FROM d""",
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM t""",
    "op10_substring_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
             w AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, words FROM d WHERE len(words) >= 35),
             c AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(words[i:i + 34], ' ')) AS n FROM w),
             gone AS (SELECT DISTINCT r, i + j AS p FROM c, (SELECT unnest(range(0, 35)) AS j) WHERE n > 1),
             g AS (SELECT r, count(*) AS n, list(p) AS places FROM gone GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(
                   list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(places, k)), lambda k: words[k]), ' ') END) AS kept_sha256
        FROM d LEFT JOIN g USING (r)""",
}
