"""Queries on marks: order lines as blocks, embeddings as learned-mark logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import planes
from sightline.functions.codes import message_bits
from sightline.operators import marks as K
from sightline.session import table

r6 = lambda name: F.round(name, 6).alias(name)


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as block readings of the picture their supplier names."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("row"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("col"),
        F.lit(0).alias("carrier"), (F.col("l_quantity") - 25.5).alias("reading"))


def vote_tally(spark: SparkSession, sf: str) -> DataFrame:
    return K.vote_tally(blocks(spark, sf), K.plain_schedule(spark)).select("image_id", "bit", "votes", "n", r6("ratio"))


def vote_agreement(spark: SparkSession, sf: str) -> DataFrame:
    tally = K.vote_tally(blocks(spark, sf), K.plain_schedule(spark))
    return K.agreement(tally, ["image_id"]).select("image_id", F.round("agreement", 9).alias("agreement"), F.round("confidence", 9).alias("confidence"))


def phase_tally(spark: SparkSession, sf: str) -> DataFrame:
    return K.phase_tally(blocks(spark, sf), K.plain_schedule(spark)).select("image_id", "phase", "bit", "votes", "n", r6("ratio"))


def phase_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as pictures whose tile starts anywhere: every alignment is tallied, and the valid codes decide."""
    key, phase = F.col("s_suppkey"), F.col("image_id") % 64
    bits = table(spark, sf, "supplier").select(key.alias("image_id"), F.posexplode(
        message_bits(F.lower(F.lpad(F.hex(key * 2654435 + 97), 8, "0")))).alias("bit", "one"))
    cells = bits.select("image_id", ((F.floor(F.col("bit") / 8) + 8 - F.floor(phase / 8)) % 8).alias("row"), ((F.col("bit") % 8 + 8 - phase % 8) % 8).alias("col"),
                        F.lit(0).alias("carrier"), F.when(F.col("one") == 1, 1.0).otherwise(-1.0).alias("reading"))
    read = K.phase_tally(cells, K.plain_schedule(spark)).withColumns({"grid": F.lit(0), "grid_confidence": F.lit(1.0)})
    whole = K.decode_candidates(read)
    own = K.chase_decode(read.where("phase = image_id % 64"), ["image_id", "grid", "phase"], 0)
    # Checksums survive some shifts of a tile, so a picture in a few hundred has a second valid code, which then means none.
    return whole.join(own.select("image_id", F.col("code").alias("own_code")), "image_id").select(
        "image_id", F.col("own_code").alias("code"), (F.col("valid_codes") >= 1).alias("any_valid"), (F.col("detected") == (F.col("valid_codes") == 1)).alias("decided"))


def keyed_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as pictures, marked by spread carriers under a key; read with the key and without."""
    lines = table(spark, sf, "lineitem")
    image = F.col("l_linenumber")
    payloads = lines.select(image.alias("image_id"), F.lower(F.lpad(F.hex(image * 77777 + 5), 8, "0")).alias("code")).distinct()
    schedule = K.keyed_schedule(spark, "secret")
    blocks_ = lines.select(image.alias("image_id"), F.col("l_partkey").alias("row"), F.col("l_orderkey").alias("col"), (F.col("l_quantity") - 25.5).alias("reading"))
    marked = K.mark_spread(blocks_, payloads, schedule, 12.0, 6)
    with_key = K.detect_marks(K.vote_tally(marked, schedule), width=0).select("image_id", "detected", "code", r6("confidence"))
    blind = K.detect_marks(K.vote_tally(marked.withColumn("carrier", F.lit(0)), K.plain_schedule(spark)), width=0)
    return with_key.join(blind.select("image_id", F.col("detected").alias("without_key")), "image_id")


def grid_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Return flag and line status name a candidate grid; all its lines are its readings."""
    grids = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.ascii("l_returnflag") * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("grid"),
        F.lit(50).alias("rows"), F.lit(40).alias("cols"), (F.col("l_partkey") % 60).alias("row"), (F.col("l_orderkey") % 40).alias("col"),
        F.lit(0).alias("carrier"), (F.col("l_quantity") - 25.5).alias("reading"))
    return K.rank_grids(grids, K.plain_schedule(spark)).select("image_id", "grid", "rank", F.round("agreement", 9).alias("agreement"))


def _noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of a marked picture per customer: 0 to 3 wrong bits, the wrong ones least certain."""
    image = F.col("image_id")
    code = F.lower(F.lpad(F.hex(image * 2654435 + 97), 8, "0"))
    # A customer becomes 64 rows; a file of few bytes is one task, and AQE, which sees the small rows, would make it one again.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id")).repartition(tasks, "image_id")
    bits = spread.select("image_id", F.posexplode(message_bits(code)).alias("bit", "one"))
    wrong = F.lit(False)
    for i, step in enumerate((7, 29, 53)):
        wrong = wrong | ((F.col("bit") == (F.col("image_id") * step + i) % 64) & (F.col("image_id") % 4 > i))
    sure = F.when(wrong, 0.02 + F.col("bit") / 10000.0).otherwise(0.2 + (F.col("bit") * 7 % 29) / 100.0)
    up = (F.col("one") == 1) != wrong
    return bits.select("image_id", "bit", F.when(up, 0.5 + sure).otherwise(0.5 - sure).alias("ratio"))


def chase_decode(spark: SparkSession, sf: str) -> DataFrame:
    return K.detect_marks(_noisy(spark, sf), width=6).select("image_id", "detected", "code", F.col("flips").cast("int").alias("flips"), r6("confidence"))


def mark_bit_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    truth = table(spark, sf, "customer").select(key.alias("image_id"), F.lower(F.lpad(F.hex(key * 2654435 + 97), 8, "0")).alias("code"))
    return K.bit_accuracy(_noisy(spark, sf), truth).select("image_id", r6("bit_accuracy"))


def marked_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every line number as one large picture: its block pairs are marked with its code, then read again."""
    lines = table(spark, sf, "lineitem")
    coefficients = lines.select(
        F.col("l_linenumber").alias("image_id"), F.col("l_partkey").alias("row"), F.col("l_orderkey").alias("col"),
        (F.col("l_quantity") - 25.5).alias("first"), (F.col("l_partkey") % 17).cast("double").alias("second"))
    image = F.col("l_linenumber")
    payloads = lines.select(image.alias("image_id"), F.lower(F.lpad(F.hex(image * 77777 + 5), 8, "0")).alias("code")).distinct()
    schedule = K.plain_schedule(spark)
    marked = K.mark_blocks(coefficients, payloads, schedule, 12.0)
    tally = K.vote_tally(marked.select("image_id", "row", "col", F.lit(0).alias("carrier"), (F.col("first") - F.col("second")).alias("reading")), schedule)
    return K.detect_marks(tally, width=0).select("image_id", "detected", "code", r6("confidence"))


def _logits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The signs of every plane are a code; its disturbed values are the logits read back."""
    vec = F.col("vec_id")
    book = planes(spark, sf).select(vec.alias("code_id"), F.transform("plane", lambda x: (x > 0).cast("int")).alias("bits"))
    logits = planes(spark, sf).select(vec.alias("image_id"), F.transform(
        "plane", lambda x, i: x + (vec % 4) * 0.08 * ((i * (vec + 3)) % 5 - 2)).alias("logits"), F.when(vec % 7 > 0, vec).alias("truth"))
    return logits, book


def codebook_top1(spark: SparkSession, sf: str) -> DataFrame:
    logits, book = _logits(spark, sf)
    out = K.codebook_attribution(logits, book)
    return out.select("image_id", "code_id", r6("score"), "blockers", F.col("others").alias("others"))


def closed_set_top1(spark: SparkSession, sf: str) -> DataFrame:
    logits, book = _logits(spark, sf)
    named = K.codebook_attribution(logits.where("truth IS NOT NULL"), book)
    return K.closed_set_top1(named, 10).select("image_id", r6("top1"))


QUERIES = {f.__name__: f for f in (
    vote_tally, vote_agreement, phase_tally, phase_decode, keyed_marks, grid_ranking, chase_decode, mark_bit_accuracy, marked_blocks, codebook_top1, closed_set_top1)}

_VOTES = """v AS (SELECT l_suppkey AS image_id, (l_partkey % 8) * 8 + (l_orderkey + l_linenumber) % 8 AS bit, count(*) AS n,
    count(*) FILTER (WHERE l_quantity > 25.5) AS votes FROM lineitem GROUP BY ALL),
  t AS (SELECT i.image_id, b.bit, coalesce(votes, 0) AS votes, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN votes / n ELSE 0.5 END AS ratio
    FROM (SELECT DISTINCT l_suppkey AS image_id FROM lineitem) i CROSS JOIN range(64) b(bit) LEFT JOIN v ON v.image_id = i.image_id AND v.bit = b.bit)"""
_BOOK = """x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS e FROM embeddings),
  l AS (SELECT vec_id, i, e + (vec_id % 4) * 0.08 * ((i * (vec_id + 3)) % 5 - 2) AS g, CASE WHEN e > 0 THEN 1.0 ELSE -1.0 END AS sg FROM x),
  ll AS (SELECT vec_id, list(g ORDER BY i)::DOUBLE[] AS g, list(sg ORDER BY i)::DOUBLE[] AS sg FROM l GROUP BY 1),
  s AS (SELECT a.vec_id AS image_id, b.vec_id AS code_id, list_dot_product(a.g, b.sg) AS c FROM ll a, ll b),
  truth AS (SELECT image_id, c AS t FROM s WHERE image_id = code_id AND image_id % 7 > 0),
  w AS (SELECT s.image_id, arg_max(s.code_id, round(c, 9) * 1000000 - s.code_id * 1e-6) AS code_id, max(c) AS score,
    count(*) FILTER (WHERE code_id <> s.image_id AND c >= t - 1e-9 AND t IS NOT NULL) AS blockers,
    count(*) FILTER (WHERE t IS NULL OR code_id <> s.image_id) AS others, bool_or(t IS NOT NULL) AS known
    FROM s LEFT JOIN truth ON truth.image_id = s.image_id GROUP BY 1)"""

ORACLES = {
    "vote_tally": f"WITH {_VOTES} SELECT image_id, bit, votes, n, round(ratio, 6) AS ratio FROM t",
    "vote_agreement": f"""WITH {_VOTES} SELECT image_id, round(avg(greatest(ratio, 1 - ratio)), 9) AS agreement,
      round(least(1, greatest(0, (avg(greatest(ratio, 1 - ratio)) - 0.5) * 2)), 9) AS confidence FROM t GROUP BY 1""",
    "phase_tally": """WITH b AS (SELECT l_suppkey AS image_id, l_partkey % 8 AS r, (l_orderkey + l_linenumber) % 8 AS c,
      count(*) FILTER (WHERE l_quantity > 25.5) AS votes, count(*) AS n FROM lineitem GROUP BY ALL)
      SELECT i.image_id, phase, bit, coalesce(votes, 0)::BIGINT AS votes, coalesce(n, 0)::BIGINT AS n, round(coalesce(votes / n, 0.5), 6) AS ratio
      FROM (SELECT DISTINCT l_suppkey AS image_id FROM lineitem) i CROSS JOIN range(64) p(phase) CROSS JOIN range(64) q(bit)
      LEFT JOIN b ON b.image_id = i.image_id AND ((r + phase // 8) % 8) * 8 + (c + phase % 8) % 8 = bit""",
    "phase_decode": """SELECT s_suppkey AS image_id, lower(lpad(to_hex(s_suppkey * 2654435 + 97), 8, '0')) AS code, true AS any_valid,
      true AS decided FROM supplier""",
    "keyed_marks": """SELECT DISTINCT l_linenumber AS image_id, true AS detected, lower(lpad(to_hex(l_linenumber * 77777 + 5), 8, '0')) AS code,
      1.0::DOUBLE AS confidence, false AS without_key FROM lineitem""",
    "grid_ranking": """WITH b AS (SELECT l_suppkey AS image_id, ascii(l_returnflag) * 2 + (l_linestatus = 'O')::INT AS grid, l_partkey % 60 AS r,
      l_orderkey % 40 AS c, l_quantity > 25.5 AS up FROM lineitem), v AS (SELECT image_id, grid, (r % 8) * 8 + c % 8 AS bit,
      count(*) FILTER (WHERE up) / count(*) AS q FROM b GROUP BY ALL),
      a AS (SELECT image_id, grid, (sum(greatest(q, 1 - q)) + 0.5 * (64 - count(*))) / 64 AS agreement FROM v GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(agreement, 12) DESC, grid) AS rank FROM a)
      SELECT image_id, grid, rank, round(agreement, 9) AS agreement FROM k WHERE rank <= 4""",
    "chase_decode": """WITH b AS (SELECT c_custkey AS k, bit, CASE WHEN (bit = (c_custkey * 7) % 64 AND c_custkey % 4 > 0) OR
      (bit = (c_custkey * 29 + 1) % 64 AND c_custkey % 4 > 1) OR (bit = (c_custkey * 53 + 2) % 64 AND c_custkey % 4 > 2) THEN 1 ELSE 0 END AS wrong
      FROM customer, range(64) t(bit)), s AS (SELECT k, wrong, 0.5 + CASE WHEN wrong = 1 THEN 0.02 + bit / 10000 ELSE 0.2 + (bit * 7 % 29) / 100 END AS r
      FROM b) SELECT k AS image_id, true AS detected, lower(lpad(to_hex(k * 2654435 + 97), 8, '0')) AS code, sum(wrong)::INT AS flips,
      round(least(1, (avg(r) - 0.5) * 2) / (1 + sum(wrong)), 6) AS confidence FROM s GROUP BY k""",
    "mark_bit_accuracy": """WITH b AS (SELECT c_custkey AS k, count(DISTINCT bit) AS bad FROM customer, LATERAL (SELECT unnest(
      list_slice([(c_custkey * 7) % 64, (c_custkey * 29 + 1) % 64, (c_custkey * 53 + 2) % 64], 1, c_custkey % 4)) AS bit) GROUP BY 1)
      SELECT c_custkey AS image_id, round((64 - coalesce(bad, 0)) / 64, 6) AS bit_accuracy FROM customer LEFT JOIN b ON k = c_custkey""",
    "marked_blocks": """SELECT DISTINCT l_linenumber AS image_id, true AS detected,
      lower(lpad(to_hex(l_linenumber * 77777 + 5), 8, '0')) AS code, 1.0::DOUBLE AS confidence FROM lineitem""",
    "codebook_top1": f"WITH {_BOOK} SELECT image_id, code_id, round(score, 6) AS score, CASE WHEN known THEN blockers ELSE 0 END AS blockers, others FROM w",
    "closed_set_top1": f"""WITH {_BOOK} SELECT image_id, round(greatest(0.0, list_product(list_transform(range(9),
      lambda i: greatest(0.0, (others - blockers - i) / (others - i))))), 6) AS top1 FROM w WHERE known""",
}
