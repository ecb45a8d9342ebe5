"""Invisible marks as vote tables: every 8x8 block votes for one bit of a 64-bit message.

``blocks(image_id, row, col, carrier, reading)`` holds one row per block and distinct carrier, a
``schedule(slot, bit, carrier)`` the 64 slots of a tile. Votes are whole numbers, so folding first is
exact.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.codes import crc_of_word, message_bits, message_words_of, word_hex
from sightline.operators.blocks import block_join, stripes

TILE, SLOTS, MESSAGE_BITS = 8, 64, 64
MIN_BLOCKS = 3 * MESSAGE_BITS
WORD = (1 << 32) - 1


def plain_schedule(spark: SparkSession) -> DataFrame:
    """Layout without a key: slot = bit, one carrier."""
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.col("id").cast("int").alias("bit"), F.lit(0).alias("carrier"))


def keyed_schedule(spark: SparkSession, key: str, carriers: int = 5) -> DataFrame:
    """Layout from a secret: which bit each slot carries, and on which of ``carriers`` carriers, by SHA-256 of key and slot.

    Bits follow the slots' digests in order, so the layout is a permutation. It is this library's own keyed layout: what
    was marked with another one needs that one's table.
    """
    digest = lambda purpose: F.sha2(F.concat(F.lit(f"{key}|{purpose}|"), F.col("id")), 256)
    slots = spark.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("slot"), digest("bit").alias("d"), digest("carrier").alias("c"))
    carrier = (F.conv(F.substring("c", 1, 8), 16, 10).cast("bigint") % carriers).cast("int")
    return slots.select("slot", (F.row_number().over(Window.orderBy("d")) - 1).cast("int").alias("bit"), carrier.alias("carrier"))


def _slot(row: Column, col: Column) -> Column:
    return (row % TILE * TILE + col % TILE).cast("int")


def vote_tally(blocks: DataFrame, schedule: DataFrame) -> DataFrame:
    """Votes and counts per (image, bit), with the share of ones (0.5 for an unread bit)."""
    folded = blocks.groupBy("image_id", _slot(F.col("row"), F.col("col")).alias("slot"), "carrier").agg(
        F.count_if(F.col("reading") > 0).alias("ones"), F.count("*").alias("n"))
    read = folded.join(F.broadcast(schedule), ["slot", "carrier"]).groupBy("image_id", "bit").agg(F.sum("ones").alias("votes"), F.sum("n").alias("n"))
    every = folded.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(MESSAGE_BITS - 1))).alias("bit"))
    full = every.join(read, ["image_id", "bit"], "left")
    votes, n = F.coalesce("votes", F.lit(0)), F.coalesce("n", F.lit(0))
    return full.select("image_id", "bit", votes.alias("votes"), n.alias("n"), F.when(n > 0, votes / n).otherwise(0.5).alias("ratio"))


def agreement(tally: DataFrame, keys: list[str]) -> DataFrame:
    """Mean agreement with the majority over all bits, and the confidence it gives."""
    r = F.col("ratio")
    out = tally.groupBy(*keys).agg(F.avg(F.greatest(r, 1.0 - r)).alias("agreement"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("agreement") - 0.5) * 2.0)))


def phase_tally(blocks: DataFrame, schedule: DataFrame) -> DataFrame:
    """Tallies under all 64 tile alignments, one row per (image, phase, bit), also where no block voted (ratio 0.5).

    Blocks fold to their 64 cells once, and an image's cells (at most 64 per carrier) become two dense arrays. Which cell lies under a bit's
    slot is the schedule's alone: a table of 4,096 places, broadcast as one row. It is gone along for each image's one row, so
    nothing is shuffled for the 4,096 rows of an image; only bits that several slots carry are added up.
    """
    cells = blocks.groupBy("image_id", _slot(F.col("row"), F.col("col")).alias("cell"), "carrier").agg(
        F.count_if(F.col("reading") > 0).alias("ones"), F.count("*").alias("n"))
    place = (F.col("carrier") * SLOTS + F.col("cell")).cast("int")
    held = cells.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("place"), F.struct("ones", "n").alias("vote")))).alias("votes"))
    read = held.withColumn("one", F.lit(1)).join(F.broadcast(_phase_places(schedule)), "one")
    zero = F.lit(0).cast("bigint")
    dense = lambda field: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("votes", i)[field], zero)).alias(field)
    # An image's row is small but grows to thousands; AQE, which sees the small rows, would leave them to one task.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = read.select("image_id", "places", dense("ones"), dense("n")).repartition(tasks, "image_id")
    single = F.transform("places", lambda p: F.struct(p["phase"].alias("phase"), p["bit"].alias("bit"), F.get("ones", p["place"]).alias("ones"), F.get("n", p["place"]).alias("n")))
    rows = read.select("image_id", F.inline(single))
    if schedule.groupBy("bit").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("image_id", "phase", "bit").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    votes, n = F.coalesce("ones", zero), F.coalesce("n", zero)
    return rows.select("image_id", "phase", "bit", votes.alias("votes"), n.alias("n"), F.when(n > 0, votes / n).otherwise(0.5).alias("ratio"))


def _phase_places(schedule: DataFrame) -> DataFrame:
    """One row ``(one, width, places ARRAY<STRUCT<phase, bit, place>>)``: the cell, on its carrier, under every slot in every alignment.

    A bit without a slot keeps a row whose place is NULL. A schedule has 64 slots, so this is a few thousand entries.
    """
    bits = schedule.sparkSession.range(MESSAGE_BITS).select(F.col("id").cast("int").alias("bit")).join(F.broadcast(schedule.select("bit", "slot", "carrier")), "bit", "left")
    every = bits.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    row, col = F.floor(F.col("phase") / TILE), F.col("phase") % TILE
    under = F.pmod(F.floor(F.col("slot") / TILE) - row, F.lit(TILE)) * TILE + F.pmod(F.col("slot") % TILE - col, F.lit(TILE))
    entry = F.struct("phase", "bit", (F.col("carrier") * SLOTS + under).cast("int").alias("place"))
    return every.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("places"), ((F.coalesce(F.max("carrier"), F.lit(0)) + 1) * SLOTS).cast("int").alias("width")).withColumn("one", F.lit(1))


def rank_grids(candidates: DataFrame, schedule: DataFrame, keep: int = 4) -> DataFrame:
    """Best reading grids per image by vote agreement.

    ``candidates(image_id, grid, cols, rows, row, col, carrier, reading)`` are readings under candidate
    scales and offsets, ``grid`` their order. Grids with fewer than 192 blocks are not read; all blocks of the others are.
    """
    enough = candidates.where(F.col("rows") * F.col("cols") >= MIN_BLOCKS)
    keyed = enough.withColumn("image_id", F.struct("image_id", "grid"))
    scored = agreement(vote_tally(keyed, schedule), ["image_id"]).select("image_id.*", "agreement", "confidence")
    order = Window.partitionBy("image_id").orderBy(F.round("agreement", 12).desc(), "grid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def message_words(tally: DataFrame, keys: list[str]) -> DataFrame:
    """Hard decision of each reading as code and checksum words, plus its bits by rising reliability.

    A word is the sum of its bits' values, so an unread bit is a zero at its own place and moves no other.
    """
    value = lambda low: F.sum(F.when((F.col("ratio") > 0.5) & F.col("bit").between(low, low + 31), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (F.lit(low + 31) - F.col("bit")).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    sure = F.sort_array(F.collect_list(F.struct(F.abs(F.col("ratio") - 0.5).alias("sure"), "bit")))
    return tally.groupBy(*keys).agg(value(0).alias("code_word"), value(32).alias("check_word"), F.transform(sure, lambda e: e["bit"]).alias("weak"))


def chase_decode(tally: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Code of each reading whose checksum holds, flipping as few of its ``width`` weakest bits as needed.

    CRC-32 is affine over bits: flipping a bit changes the syndrome, the checksum of the code word against the read one, by a word of
    its own, whatever the others are. So the flips wanted are those whose words add up to the syndrome. The weak bits are parted in two
    halves; a half has at most 2^(width / 2) sums, and a sum of the lower half is looked up among those of the upper half. No pattern becomes a row.
    Equal flip counts take the first pattern (weakest bit lowest). A reading that is valid as it is flips nothing.
    """
    words = message_words(tally, keys)
    effects = ", ".join(f"{_flip_effect(bit)}L" for bit in range(MESSAGE_BITS))
    syndrome = crc_of_word(F.col("code_word")).bitwiseXOR(F.col("check_word"))
    low = width // 2
    # (sum of effects, flipped bits as a pattern) of every subset of some weak bits, empty one first.
    sums = lambda first, count: f"""aggregate(sequence({first}, {first + count - 1}), array(struct(0L AS sum, 0L AS pattern)), (held, i) -> concat(held,
        transform(held, s -> struct(s.sum ^ get(array({effects}), get(weak, i)) AS sum, s.pattern | shiftleft(1L, i) AS pattern))))""" if count else "array(struct(0L AS sum, 0L AS pattern))"
    # Of subsets with one sum, the one with fewer flips, then the lower pattern, is the one that an answer can hold.
    best = "map_from_entries(transform(aggregate(array_sort(transform(upper, s -> struct(s.sum AS sum, bit_count(s.pattern) AS flips, s.pattern AS pattern))), CAST(array() AS ARRAY<STRUCT<sum: BIGINT, flips: INT, pattern: BIGINT>>), "\
           "(held, s) -> IF(size(held) > 0 AND element_at(held, -1).sum = s.sum, held, concat(held, array(s)))), s -> struct(s.sum, s)))"
    found = "array_min(filter(transform(lower, s -> struct(bit_count(s.pattern) + try_element_at(best, syndrome ^ s.sum).flips AS flips, s.pattern | try_element_at(best, syndrome ^ s.sum).pattern AS pattern)), a -> a.flips IS NOT NULL))"
    decoded = words.withColumn("syndrome", syndrome)
    plain = decoded.where("syndrome = 0").select(*keys, "code_word", F.lit(0).alias("flips"))
    if width > 0:
        tried = decoded.where("syndrome <> 0").withColumns({"lower": F.expr(sums(0, low)), "upper": F.expr(sums(low, width - low))})
        tried = tried.withColumn("best", F.expr(best)).withColumn("a", F.expr(found)).where("a IS NOT NULL")
        # Bits from 32 on belong to the checksum word; the others are flipped in the code word.
        flipped = F.expr(f"aggregate(sequence(0, {width - 1}), code_word, (w, i) -> IF(getbit(a.pattern, i) = 1 AND get(weak, i) < 32, w ^ shiftleft(1L, 31 - get(weak, i)), w))")
        plain = plain.unionByName(tried.select(*keys, flipped.alias("code_word"), F.col("a.flips").cast("int").alias("flips")))
    return plain.select(*keys, word_hex(F.col("code_word")).alias("code"), "flips")


def _flip_effect(bit: int) -> int:
    """How a flip of a message bit changes the syndrome: a bit of the checksum word itself, or CRC-32's answer to one bit of the code word."""
    if bit >= 32:
        return 1 << (63 - bit)
    return zlib.crc32((1 << (31 - bit)).to_bytes(4, "big")) ^ zlib.crc32(bytes(4))


def detect_marks(tally: DataFrame, width: int = 12) -> DataFrame:
    """Detection per image from its own grid: code, flips, confidence / (1 + flips)."""
    sure = agreement(tally, ["image_id"])
    found = chase_decode(tally, ["image_id"], width)
    out = sure.join(found, "image_id", "left")
    return out.select("image_id", F.col("code").isNotNull().alias("detected"), "code", "flips",
                      (F.col("confidence") / (1.0 + F.coalesce("flips", F.lit(0)))).alias("confidence"))


def decode_candidates(readings: DataFrame, min_confidence: float = 0.15, width: int = 0) -> DataFrame:
    """Detection from searched grids: every valid code of every phase counts, two different ones mean none.

    ``readings(image_id, grid, phase, bit, ratio, grid_confidence)``; weak grids are not decoded.
    """
    keys = ["image_id", "grid", "phase"]
    strong = readings.where(F.col("grid_confidence") >= min_confidence)
    found = chase_decode(strong, keys, width).join(strong.select(*keys, "grid_confidence").distinct(), keys)
    best = readings.groupBy("image_id").agg(F.max("grid_confidence").alias("best"))
    codes = found.groupBy("image_id", "code").agg(F.min(F.struct("grid", "phase", "flips", "grid_confidence")).alias("m"))
    named = codes.groupBy("image_id").agg(F.count("*").alias("codes"), F.first("code").alias("code"),
                                          F.first("m.flips").alias("flips"), F.first("m.grid_confidence").alias("c"))
    single = F.col("codes").eqNullSafe(F.lit(1))
    return best.join(named, "image_id", "left").select(
        "image_id", single.alias("detected"), F.when(single, F.col("code")).alias("code"), F.when(single, F.col("flips")).alias("flips"),
        F.when(single, F.col("c") / (1.0 + F.col("flips"))).otherwise(F.col("best")).alias("confidence"),
        F.coalesce("codes", F.lit(0)).alias("valid_codes"))


def mark_blocks(coefficients: DataFrame, payloads: DataFrame, schedule: DataFrame, margin: float) -> DataFrame:
    """Write each image's code into its blocks' coefficient pair: mean +/- half the margin.

    ``coefficients(image_id, row, col, first, second)``, ``payloads(image_id, code)``. Images with fewer
    than 192 blocks cannot carry the message and come back unchanged with a ``reason``.
    """
    capacity = coefficients.groupBy("image_id").agg(F.count("*").alias("blocks"))
    bits = payloads.select("image_id", F.posexplode(message_bits(F.col("code"))).alias("bit", "one"))
    slots = bits.join(F.broadcast(schedule), "bit").select("image_id", "slot", "one")
    placed = coefficients.withColumn("slot", _slot(F.col("row"), F.col("col"))).join(slots, ["image_id", "slot"], "left").join(capacity, "image_id")
    mean, half = (F.col("first") + F.col("second")) / 2.0, F.when(F.col("one") == 1, margin / 2.0).otherwise(-margin / 2.0)
    fits = (F.col("blocks") >= MIN_BLOCKS) & F.col("one").isNotNull()
    reason = F.when(F.col("blocks") < MIN_BLOCKS, "too small to carry the message").when(F.col("one").isNull(), "no payload")
    return placed.select("image_id", "row", "col", F.when(fits, mean + half).otherwise(F.col("first")).alias("first"),
                         F.when(fits, mean - half).otherwise(F.col("second")).alias("second"), reason.alias("reason"))


def spread_shift(reading: Column, one: Column, margin: float, carrier_size: int) -> Column:
    """How far to move each coefficient along a spread carrier, so that its reading becomes +/- margin."""
    target = F.when(one == 1, F.lit(margin)).otherwise(F.lit(-margin))
    return (target - reading) / F.lit(float(carrier_size))


def mark_spread(blocks: DataFrame, payloads: DataFrame, schedule: DataFrame, margin: float, carrier_size: int) -> DataFrame:
    """Mark ``blocks(image_id, row, col, reading)`` with ``payloads(image_id, code)`` along spread carriers.

    Adds each block's ``carrier``, the ``shift`` of its coefficients, and the ``reading`` they give then. Images without a payload
    stay as they are.
    """
    bits = payloads.select("image_id", F.posexplode(message_bits(F.col("code"))).alias("bit", "one"))
    slots = bits.join(F.broadcast(schedule), "bit").select("image_id", "slot", "one")
    placed = blocks.withColumn("slot", _slot(F.col("row"), F.col("col"))).join(F.broadcast(schedule.select("slot", "carrier")), "slot").join(slots, ["image_id", "slot"], "left")
    shift = F.coalesce(spread_shift(F.col("reading"), F.col("one"), margin, carrier_size), F.lit(0.0))
    return placed.withColumn("shift", F.when(F.col("one").isNotNull(), shift).otherwise(0.0)).select(
        "image_id", "row", "col", "carrier", "shift", (F.col("reading") + F.col("shift") * carrier_size).alias("reading"))


def bit_accuracy(tally: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of message bits read right; ``truth(image_id, code)``.

    A code goes along as its two words, and each reading looks up its own bit in them, so the truth stays one row per image. It is
    hashed task by task: files that hold few bytes for many images would otherwise be taken for a table small enough to broadcast.
    """
    words = truth.select("image_id", *[word.alias(name) for word, name in zip(message_words_of(F.col("code")), ("code_word", "check_word"))])
    read = tally.where(F.col("bit").between(0, MESSAGE_BITS - 1)).join(words.hint("shuffle_hash"), "image_id")
    one = F.getbit(F.when(F.col("bit") < 32, F.col("code_word")).otherwise(F.col("check_word")), (31 - F.col("bit") % 32).cast("int"))
    return read.groupBy("image_id").agg(F.avg(((F.col("ratio") > 0.5).cast("int") == one.cast("int")).cast("double")).alias("bit_accuracy"))


def _codebook(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    right = right.sort_values("code_id")
    signs = 2.0 * np.vstack(right["bits"].to_numpy()).astype(np.float64) - 1.0
    logits = np.vstack(left["logits"].to_numpy()).astype(np.float64)
    ids, names, out = right["code_id"].to_numpy(), left["image_id"].to_numpy(), []
    for part in stripes(len(left)):
        scores = logits[part] @ signs.T
        lead = scores.argmax(1)
        truth = left["truth_score"].to_numpy()[part]
        other = ids[None, :] != left["truth"].to_numpy()[part][:, None]
        out.append(pd.DataFrame({"image_id": names[part], "code_id": ids[lead], "score": scores[np.arange(len(lead)), lead],
                                 "blockers": ((scores >= truth[:, None] - 1e-9) & other).sum(1), "others": other.sum(1)}))
    return pd.concat(out)


def codebook_attribution(logits: DataFrame, codebook: DataFrame) -> DataFrame:
    """Best codebook entry per image by soft correlation, and how many entries rival the true one.

    ``logits(image_id, logits, truth)`` with ``truth`` NULL for unmarked images; the smallest code id
    wins ties.
    """
    id_type, code_type = dict(logits.dtypes)["image_id"], dict(codebook.dtypes)["code_id"]
    true_bits = codebook.select(F.col("code_id").alias("truth"), F.col("bits").alias("true_bits"))
    signed = F.zip_with("logits", "true_bits", lambda x, b: x * (2.0 * b - 1.0))
    known = logits.join(true_bits, "truth", "left").select(
        "image_id", "logits", F.coalesce("truth", F.lit(-1)).cast(code_type).alias("truth"),
        F.coalesce(F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x), F.lit(float("inf"))).alias("truth_score"))
    cells = block_join(known, codebook, ["image_id"], ["code_id"], _codebook,
                       f"image_id {id_type}, code_id {code_type}, score double, blockers bigint, others bigint")
    out = cells.groupBy("image_id").agg(
        F.min(F.struct((-F.col("score")).alias("loss"), "code_id")).alias("m"), F.sum("blockers").alias("blockers"),
        F.sum("others").alias("others"))
    return out.select("image_id", F.col("m.code_id").alias("code_id"), (-F.col("m.loss")).alias("score"), "blockers", "others")


def closed_set_top1(attribution: DataFrame, size: int) -> DataFrame:
    """How often the true code beats ``size - 1`` other codes drawn at random.

    Instead of drawing, the exact expectation: no drawn code may be one of the ``blockers``.
    """
    n, b = F.col("others"), F.col("blockers")
    chance = F.aggregate(F.sequence(F.lit(0), F.lit(size - 2)), F.lit(1.0),
                         lambda acc, i: acc * F.greatest(F.lit(0.0), (n - b - i) / (n - i)))
    return attribution.select("image_id", F.when(n <= size - 1, (b == 0).cast("double")).otherwise(chance).alias("top1"))
