"""Queries on origin: digests, hashes, attribution, logs, lineage, groups, leakage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import HASHES, assets, copies, planes
from sightline.functions import hashes as H
from sightline.functions.codes import code_collisions, issue_codes
from sightline.operators import attribution as A
from sightline.operators import lineage as L
from sightline.operators.matching import enroll_refusals
from sightline.session import shared_folder, table
from sightline.sources import manifests, registry
from sightline.sources.media import content_digest

r6 = lambda name: F.round(name, 6).alias(name)


def _document_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri"),
                       F.col("doc_id").alias("ord"), *content_digest(F.col("text")))


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return A.dedupe_by_content(_document_files(spark, sf))


def also_at(spark: SparkSession, sf: str) -> DataFrame:
    return A.also_at(_document_files(spark, sf))


def grid_hashes(spark: SparkSession, sf: str) -> DataFrame:
    plane = F.col("plane")
    wide = F.concat(plane, F.slice(plane, 1, 8))
    return planes(spark, sf).select("vec_id", H.average_hash(plane).alias("ahash"), H.difference_hash(wide).alias("dhash"),
                                    H.perceptual_hash(plane).alias("phash"))


def fingerprint_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy against the asset it was made from."""
    left = copies(spark, sf).select(F.col("content_id").alias("id"), F.col("sha256").alias("left_sha256"),
                                    F.col("phash").alias("left_phash"), F.col("phash").alias("left_dhash"),
                                    F.col("plane").alias("left_vector"))
    right = assets(spark, sf).select(F.col("asset_id").alias("id"), F.col("sha256").alias("right_sha256"),
                                     F.col("phash").alias("right_phash"), F.col("phash").alias("right_dhash"),
                                     F.col("plane").alias("right_vector"))
    return A.compare_fingerprints(left.join(right, "id")).select(
        "id", "sha256_match", F.col("phash_hamming").cast("bigint").alias("phash_hamming"), r6("phash_similarity"),
        r6("semantic_similarity"))


def perceptual_matches(spark: SparkSession, sf: str) -> DataFrame:
    out = A.join_perceptual(copies(spark, sf), assets(spark, sf))
    return out.select("content_id", F.col("by_hash.asset_id").alias("asset_id"), r6("best_similarity"))


def hash_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest registered hash of every file, always through the segment tables."""
    files = copies(spark, sf)
    near = A.closest_hashes(files, assets(spark, sf), cell_rows=0).select("phash", F.col("near")[0].alias("n"))
    return files.select("content_id", "phash").join(near, "phash").select("content_id", F.col("n.first_id").alias("asset_id"), "n.distance")


def closest_assets(spark: SparkSession, sf: str) -> DataFrame:
    return A.closest_assets(copies(spark, sf), assets(spark, sf)).select("content_id", "rank", "asset_id", r6("similarity"), "exact")


def source_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.attribute_source(copies(spark, sf), assets(spark, sf)).select(
        "content_id", "asset_id", "asset_owner", "distribution_id", "basis", "confidence", r6("perceptual_similarity"))


def restore_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return A.restore_sizes(copies(spark, sf), assets(spark, sf), floor=0.7)


def provenance_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as an append-only log of their customer's asset."""
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("ord"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    return registry.latest_entries(log)


def provenance_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same log as JSON lines, every seventh of them malformed."""
    body = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("asset_id"), F.col("o_orderstatus").alias("sha256"),
                              F.col("o_orderpriority").alias("watermark_id")))
    lines = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 7 == 3, F.concat(F.lit("{broken "), body)).otherwise(body).alias("line"))
    return registry.latest_entries(registry.parse_provenance(lines)).select("asset_id", "sha256", "watermark_id", "position")


def _customer_assets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("asset_id"), F.col("c_mktsegment").alias("user_id"),
        F.sha2("c_name", 256).alias("sha256"), F.sha2(F.concat("c_name", F.lit("-src")), 256).alias("source_sha256"),
        F.hex("c_custkey").alias("watermark_code"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))


def provenance_register(spark: SparkSession, sf: str) -> DataFrame:
    return registry.register_protected(_customer_assets(spark, sf))[0]


def code_collision_report(spark: SparkSession, sf: str) -> DataFrame:
    """Codes cut to 12 bits, so that collisions occur."""
    return code_collisions(issue_codes(_customer_assets(spark, sf).drop("watermark_code"), bits=12))


def code_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What issued codes must satisfy: eight hex digits each, the same asset always the same code, every one of them counted once."""
    rows = _customer_assets(spark, sf).drop("watermark_code")
    codes, again = issue_codes(rows), issue_codes(rows.repartition(5))
    same = codes.select("asset_id", "watermark_code").join(again.select("asset_id", F.col("watermark_code").alias("again")), "asset_id")
    return same.agg(F.count("*").alias("assets"), F.count_if(F.col("watermark_code").rlike("^[0-9a-f]{8}$")).alias("well_formed"),
                    F.count_if(F.col("watermark_code") == F.col("again")).alias("stable"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    node = lambda turn: F.concat(F.col("conv_id"), F.lit(":"), turn)
    return table(spark, sf, "conversations").select(
        node(F.col("turn")).alias("asset_id"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent_asset"))


def lineage_roots(spark: SparkSession, sf: str) -> DataFrame:
    return L.lineage_roots(_turns(spark, sf))


def lineage_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of all leaves."""
    nodes = _turns(spark, sf)
    leaves = nodes.select("asset_id").join(
        nodes.select(F.col("parent_asset").alias("asset_id")), "asset_id", "left_anti")
    return L.lineage_chain(nodes, leaves)


def deep_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as versions of one another, in chains of two thousand."""
    key = F.col("o_orderkey")
    nodes = table(spark, sf, "orders").select(key.alias("asset_id"), F.when(key % 2000 > 0, key - 1).alias("parent_asset"))
    leaves = nodes.select("asset_id").join(nodes.select(F.col("parent_asset").alias("asset_id")), "asset_id", "left_anti")
    return L.lineage_chain(nodes, leaves)


def provenance_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of different size, the smaller one last: the newer line wins wherever its file sorts."""
    path = f"{shared_folder(spark)}/provenance-{uuid.uuid4().hex}"
    orders, none = table(spark, sf, "orders"), F.lit(None).cast("string")
    node = lambda mark: [F.col("o_custkey").cast("string").alias("asset_id"), F.lit(mark).alias("sha256"), F.col("o_orderdate").cast("string").alias("created_at"),
                         none.alias("parent_asset"), none.alias("watermark_id")]
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("o_orderdate"))
    registry.append_provenance(first.select(*node("first")), path)
    registry.append_provenance(first.where("o_custkey % 5 = 0").select(*node("second")), path)
    return registry.read_provenance(spark, path).select("asset_id", "sha256")


def identity_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents joined by equal text, or by equal language and length."""
    docs = table(spark, sf, "documents")
    def stars(*by) -> DataFrame:
        keyed = docs.select("doc_id", F.xxhash64(*by).alias("k"))
        heads = keyed.groupBy("k").agg(F.min("doc_id").alias("b"))
        return keyed.join(heads, "k").select(F.col("doc_id").alias("a"), "b")
    return L.identity_groups(stars("text").unionByName(stars("lang", "n_chars")))


def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as detectors trained on their documents; benchmark items and first copies evaluated."""
    training = _document_files(spark, sf).select(
        F.col("source").alias("detector"), "sha256", F.concat(F.lit("data/"), "lang", F.lit("/"), F.col("doc_id")).alias("path"))
    bench = table(spark, sf, "benchmark")
    manifest = bench.select(F.concat(F.lit("bench-"), F.col("item_id")).alias("item"), F.sha2("text", 256).alias("sha256"),
                            F.concat(F.lit("eval/en/"), F.col("item_id")).alias("path"))
    return A.leakage_check(training, manifest)


def genuine_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items of several manifests; clean ones are genuine and may be shared."""
    files = _document_files(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    items = files.select(
        F.col("doc_id").alias("item"), "sha256", F.col("source").alias("source_name"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, "genuine").otherwise("fake").alias("label"),
        F.substring("source", 4, 2).cast("int").alias("manifest_ord"))
    return manifests.dedupe_genuine(items).select("item", "source_name", "label", "manifest_ord")


def clip_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a download: the language gives the method, the source the compression; some are frames, masks or strangers."""
    n = F.col("doc_id")
    method = F.element_at(F.create_map(*[F.lit(x) for p in {"en": "Deepfakes", "fr": "Face2Face", "de": "original_sequences", "es": "other"}.items() for x in p]), F.col("lang"))
    level = F.element_at(F.array(F.lit("c23"), F.lit("raw"), F.lit("plain"), F.lit("c40")), (n % 4 + 1).cast("int"))
    clip = F.lpad((n % 150).cast("string"), 3, "0")
    path = F.when(n % 3 == 0, F.concat_ws("/", F.lit("mirror"), method, level, clip, F.concat(F.lit("f"), n, F.lit(".png")))).when(
        n % 17 == 1, F.concat_ws("/", method, F.lit("masks"), F.concat(clip, F.lit(".mp4")))).otherwise(
        F.concat_ws("/", F.lit("mirror"), method, level, F.concat(clip, F.lit("_"), F.lpad((n % 7).cast("string"), 3, "0"), F.lit(".mp4"))))
    return manifests.clip_inventory(table(spark, sf, "documents").select(path.alias("path")))


def enrollment_refusals(spark: SparkSession, sf: str) -> DataFrame:
    shielded = assets(spark, sf).where("shielded").select("sha256", "watermark_code")
    candidates = copies(spark, sf).select(F.col("content_id").alias("image_id"), "sha256", F.col("code").alias("watermark_code"))
    return enroll_refusals(candidates, shielded)


QUERIES = {f.__name__: f for f in (
    exact_duplicates, also_at, grid_hashes, fingerprint_comparison, perceptual_matches, hash_neighbours, closest_assets, source_attribution,
    restore_sizes, provenance_latest, provenance_lines, provenance_register, code_collision_report, code_checks, lineage_roots,
    lineage_chain, deep_lineage, provenance_log_files, identity_components, leakage_check, genuine_dedupe, clip_inventory, enrollment_refusals)}

_NIBBLES = """hexed AS (SELECT vec_id, name, i // 4 AS j, sum(bit::INT * (8 >> (i % 4)::INT))::INT AS n FROM marked GROUP BY ALL),
  digits AS (SELECT vec_id, name, string_agg(format('{:x}', n), '' ORDER BY j) AS code FROM hexed GROUP BY ALL)"""
_MATCH = f"""{HASHES}, d AS (SELECT a.vec_id AS content_id, b.vec_id AS asset_id, bit_count(xor(a.bits, b.bits)) AS dist,
  'user-' || b.label AS owner FROM h a JOIN h b ON a.kind = 'copy' AND b.kind = 'asset')"""
_BEST = f"""{_MATCH}, best AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY dist, asset_id) AS rk FROM d)"""

ORACLES = {
    "code_checks": "SELECT count(*) AS assets, count(*) AS well_formed, count(*) AS stable FROM customer",
    "exact_duplicates": """SELECT sha256(text) AS sha256, arg_min('doc/' || doc_id, doc_id) AS uri, count(*) AS copies
      FROM documents GROUP BY 1""",
    "also_at": """WITH k AS (SELECT sha256(text) AS sha256, 'doc/' || doc_id AS uri, doc_id AS ord,
      row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
      SELECT sha256, uri, ord FROM k WHERE rn > 1""",
    "grid_hashes": f"""WITH {HASHES}, mean AS (SELECT vec_id, avg(val) AS m FROM cells GROUP BY 1),
      wide AS (SELECT vec_id, i, val FROM cells UNION ALL SELECT vec_id, i + 64, val FROM cells WHERE i < 8),
      marked AS (SELECT vec_id, 'ahash' AS name, i, val > m AS bit FROM cells JOIN mean USING (vec_id) UNION ALL
      SELECT a.vec_id, 'dhash', (a.i // 9) * 8 + a.i % 9, b.val > a.val FROM wide a JOIN wide b ON a.vec_id = b.vec_id
      AND b.i = a.i + 1 WHERE a.i % 9 < 8), {_NIBBLES}
      SELECT vec_id, max(CASE WHEN name = 'ahash' THEN code END) AS ahash, max(CASE WHEN name = 'dhash' THEN code END) AS dhash,
      any_value(phash) AS phash FROM digits JOIN (SELECT vec_id, phash FROM h WHERE kind = 'asset') USING (vec_id) GROUP BY vec_id""",
    "fingerprint_comparison": f"""WITH {HASHES}, dots AS (SELECT a.vec_id, sum(a.val * b.val) / (sqrt(sum(a.val * a.val))
      * sqrt(sum(b.val * b.val))) AS c FROM both_kinds a JOIN both_kinds b ON a.vec_id = b.vec_id AND a.i = b.i
      AND a.kind = 'copy' AND b.kind = 'asset' GROUP BY 1)
      SELECT a.vec_id AS id, (a.vec_id % 4 = 0)::INT::DOUBLE AS sha256_match, bit_count(xor(a.bits, b.bits))::BIGINT AS phash_hamming,
      round(1.0 - bit_count(xor(a.bits, b.bits)) / 64, 6) AS phash_similarity, round(c, 6) AS semantic_similarity
      FROM h a JOIN h b ON a.vec_id = b.vec_id AND a.kind = 'copy' AND b.kind = 'asset' JOIN dots ON dots.vec_id = a.vec_id""",
    "hash_neighbours": f"WITH {_BEST} SELECT content_id, asset_id, dist::INTEGER AS distance FROM best WHERE rk = 1",
    "perceptual_matches": f"""WITH {_BEST} SELECT content_id, asset_id, round(1.0 - dist / 64, 6) AS best_similarity
      FROM best WHERE rk = 1""",
    "closest_assets": f"""WITH {_BEST} SELECT content_id, rk AS rank, asset_id, round(1.0 - dist / 64, 6) AS similarity,
      content_id = asset_id AND content_id % 4 = 0 AS exact FROM best WHERE rk <= 5""",
    "source_attribution": f"""WITH {_BEST}, r AS (SELECT content_id, CASE WHEN content_id % 4 < 2 THEN content_id
      WHEN 1.0 - dist / 64 >= 0.8125 THEN asset_id END AS asset_id, CASE content_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'code'
      ELSE CASE WHEN 1.0 - dist / 64 >= 0.8125 THEN 'perceptual' END END AS basis,
      round(1.0 - dist / 64, 6) AS perceptual_similarity FROM best WHERE rk = 1)
      SELECT content_id, asset_id, 'user-' || e.label AS asset_owner, 'channel-' || (asset_id % 3) AS distribution_id, basis,
      CASE basis WHEN 'exact' THEN 1.0::DOUBLE WHEN 'code' THEN 0.8 WHEN 'perceptual' THEN 0.4 END AS confidence,
      perceptual_similarity FROM r LEFT JOIN embeddings e ON e.vec_id = r.asset_id""",
    "restore_sizes": f"""WITH {_MATCH}, s AS (SELECT content_id, 200 + (asset_id % 5) * 40 AS asset_width,
      150 + (asset_id % 5) * 30 AS asset_height, min(dist * 1000000 + asset_id) AS ord FROM d
      WHERE 1.0 - dist / 64 >= 0.7 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY ord) AS rank
      FROM s) SELECT content_id, rank, asset_width, asset_height FROM k WHERE rank <= 3""",
    "provenance_latest": """SELECT o_custkey AS asset_id, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus,
      arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority,
      min(o_orderkey) AS position FROM orders GROUP BY 1""",
    "provenance_lines": """SELECT o_custkey::VARCHAR AS asset_id, arg_max(o_orderstatus, o_orderkey) AS sha256,
      arg_max(o_orderpriority, o_orderkey) AS watermark_id, min(o_orderkey) AS position FROM orders
      WHERE o_orderkey % 7 <> 3 GROUP BY 1""",
    "provenance_register": """SELECT c_custkey || ':source' AS asset_id, sha256(c_name || '-src') AS sha256,
      '2024-01-01T00:00:00Z' AS created_at, NULL::VARCHAR AS parent_asset, NULL::VARCHAR AS watermark_id FROM customer UNION ALL
      SELECT c_custkey::VARCHAR, sha256(c_name), '2024-01-01T00:00:00Z', c_custkey || ':source', to_hex(c_custkey) FROM customer""",
    "lineage_roots": """SELECT conv_id || ':' || turn AS asset_id, conv_id || ':' || min(turn) OVER (PARTITION BY conv_id) AS root,
      turn - min(turn) OVER (PARTITION BY conv_id) AS depth FROM conversations""",
    "lineage_chain": """WITH RECURSIVE leaves AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1),
      walk AS (SELECT conv_id, turn AS start_turn, turn, 0 AS depth FROM leaves UNION ALL
      SELECT w.conv_id, w.start_turn, c.turn, depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id
      AND c.turn = w.turn - 1) SELECT conv_id || ':' || start_turn AS start, depth, conv_id || ':' || turn AS asset_id FROM walk""",
    "deep_lineage": """WITH c AS (SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_orderkey // 2000) AS start FROM orders)
      SELECT start, (start - o_orderkey)::INT AS depth, o_orderkey AS asset_id FROM c""",
    "provenance_log_files": """SELECT DISTINCT o_custkey::VARCHAR AS asset_id, CASE WHEN o_custkey % 5 = 0 THEN 'second' ELSE 'first' END AS sha256 FROM orders""",
    "identity_components": """WITH RECURSIVE e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents UNION
      SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, n_chars) FROM documents),
      s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN s ON r.b = s.a)
      SELECT a AS id, min(b) AS "group" FROM reach GROUP BY a""",
    "leakage_check": """WITH t AS (SELECT source AS detector, sha256(text) AS sha, lang || '/' || doc_id AS tail FROM documents),
      m AS (SELECT 'bench-' || item_id AS item, sha256(text) AS sha, 'en/' || item_id AS tail FROM benchmark)
      SELECT detector, item, CASE WHEN bool_or(t.sha = m.sha) THEN 'content' ELSE 'path' END AS basis
      FROM t JOIN m ON t.sha = m.sha OR t.tail = m.tail GROUP BY ALL""",
    "genuine_dedupe": """WITH i AS (SELECT d.doc_id AS item, text, source AS source_name,
      CASE WHEN coalesce(toxic, 0) = 0 THEN 'genuine' ELSE 'fake' END AS label, substr(source, 4, 2)::INT AS manifest_ord
      FROM documents d LEFT JOIN labels l USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY label, text
      ORDER BY manifest_ord, item) AS rn FROM i) SELECT item, source_name, label, manifest_ord FROM r WHERE label = 'fake' OR rn = 1""",
    "clip_inventory": """WITH d AS (SELECT doc_id AS n, lang, ['c23', 'raw', 'plain', 'c40'][doc_id % 4 + 1] AS level, lpad((doc_id % 150)::VARCHAR, 3, '0') AS clip,
      CASE lang WHEN 'en' THEN 'Deepfakes' WHEN 'fr' THEN 'Face2Face' WHEN 'de' THEN 'original_sequences' END AS method,
      CASE lang WHEN 'en' THEN 'deepfakes' WHEN 'fr' THEN 'face2face' WHEN 'de' THEN 'real' END AS kind FROM documents WHERE lang IN ('en', 'fr', 'de')),
      c AS (SELECT kind, n % 3 > 0 AS is_video, CASE WHEN n % 3 = 0 THEN clip ELSE clip || '_' || lpad((n % 7)::VARCHAR, 3, '0') END AS video_id,
        'mirror/' || method || '/' || level || '/' || CASE WHEN n % 3 = 0 THEN clip ELSE clip || '_' || lpad((n % 7)::VARCHAR, 3, '0') || '.mp4' END AS path,
        CASE level WHEN 'c23' THEN 0 ELSE 4 END AS rank FROM d WHERE level IN ('c23', 'plain') AND (n % 3 = 0 OR n % 17 <> 1)),
      g AS (SELECT kind, video_id, is_video, path, min(rank) AS rank, count(*) AS members FROM c GROUP BY ALL)
      SELECT kind, video_id, arg_min(path, (NOT is_video, rank, path)) AS path, bool_or(is_video) AS is_video, arg_min(members, (NOT is_video, rank, path)) AS members FROM g GROUP BY 1, 2""",
    "enrollment_refusals": """SELECT vec_id AS image_id, CASE vec_id % 4 WHEN 0 THEN 'shielded file'
      ELSE 'mark of a shielded asset' END AS reason FROM embeddings WHERE vec_id % 11 = 0 AND vec_id % 4 < 2""",
}
